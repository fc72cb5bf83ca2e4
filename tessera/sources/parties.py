"""Party tables: CSV scans, keys, samples of reference values, and fixtures over the given tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.strings import clean_cell
from tessera.operators.ranking import ranked
from tessera.session import materialise

ATTRIBUTES = ("a1", "a2", "a3", "a4")


def load_party(spark: SparkSession, path: str, columns: Sequence[str], rec_id: str | None = None, ent_id: str | None = None, header: bool = True) -> DataFrame:
    """A CSV (plain or ``.gz``) as strings: split at every comma, lower-cased, stripped.

    ``columns`` names the positions. Without ``rec_id`` rows are numbered from 0 in file order; ids
    that repeat are refused.
    """
    raw = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    if header:
        first = raw.groupBy(F.input_file_name().alias("_file")).agg(F.min("_at").alias("_at"))
        raw = raw.join(first.select("_at"), "_at", "left_anti")
    cells = F.split(F.col("value"), ",")
    out = raw.select("_at", *[clean_cell(F.get(cells, F.lit(k))).alias(c) for k, c in enumerate(columns)])
    if rec_id is None:
        out = number_rows(out, "_at")
    else:
        out = out.withColumn("rec_id", F.col(rec_id))
    out = out.withColumn("ent_id", F.col(ent_id) if ent_id else F.col("rec_id")).drop("_at")
    return without_repeated_ids(out) if rec_id else out


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """``rec_id`` = position from 0 by ``order``."""
    return ranked(df, [order], "rec_id").withColumn("rec_id", (F.col("rec_id") - 1).cast("string"))


def repeated_ids(party: DataFrame) -> DataFrame:
    """Record ids that occur more than once: an empty frame means that the party is sound."""
    return party.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def without_repeated_ids(party: DataFrame) -> DataFrame:
    """The party; a ValueError that names some of them if ids occur more than once."""
    if found := [r["rec_id"] for r in repeated_ids(party).orderBy("rec_id").limit(5).collect()]:
        raise ValueError(f"record ids that occur more than once: {found}")
    return party


def load_parties(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], rec_id: str) -> DataFrame:
    """Parties out of one CSV each, by the column that holds their ids, as one table with ``party`` from 0."""
    parts = [load_party(spark, path, columns, rec_id).withColumn("party", F.lit(k)) for k, path in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table: CSV with a header, types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True)


def key_of(attributes: Sequence[str]) -> Column:
    """The blocking or sorting key: the attributes joined without a separator."""
    return F.concat(*[F.col(a) for a in attributes])


def sample_values(keys: DataFrame, n: int, seed: int = 0) -> list[str]:
    """``n`` distinct values of ``keys(key)``, drawn in proportion to how often each occurs.

    Each value waits for a time that is exponential at the rate of its frequency, by a seeded hash; the
    first ``n`` to come are the draws without repeats. Only they reach the driver.
    """
    u = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", (-F.log(u) / F.col("n")).alias("wait"))
    out = [r["key"] for r in drawn.orderBy("wait", "key").limit(n).collect()]
    if len(out) < n:
        raise ValueError(f"{n} distinct values wanted, {len(out)} there")
    return out


def hashed_values(keys: DataFrame, n: int, salt: str = "") -> DataFrame:
    """``n`` distinct values of ``keys(key)`` by the order of their salted md5, as (pos, ref): a sample that SQL can repeat."""
    values = keys.select("key").distinct().select(F.col("key").alias("ref"), F.md5(F.concat(F.lit(salt), F.col("key"))).alias("_hash"))
    placed = ranked(values, ["_hash", "ref"], "pos")
    return placed.filter(F.col("pos") <= n).select((F.col("pos") - 1).cast("int").alias("pos"), "ref")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person-like rows out of ``documents``: two words, a place and a code.

    Written, since most plans read the parties many times: the texts are read once.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the first two runs of letters; no text is searched further
    word = lambda p: F.lower(F.coalesce(F.regexp_extract("text", p, 1), F.lit("")))
    first, second = r"^[^A-Za-z]*+([A-Za-z]++)", r"^[^A-Za-z]*+[A-Za-z]++[^A-Za-z]++([A-Za-z]++)"
    return materialise(docs.select("doc_id", word(first).alias("a1"), word(second).alias("a2"), F.coalesce("lang", F.lit("")).alias("a3"), F.coalesce("source", F.lit("")).alias("a4")), "people")


def _party(rows: DataFrame) -> DataFrame:
    rec = F.col("doc_id").cast("string")
    return rows.select(rec.alias("rec_id"), rec.alias("ent_id"), *ATTRIBUTES)


def two_parties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parties_of(people(spark, sf_dir))


def parties_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alice and Bob share a third of the people; Bob has lost a letter in some first words."""
    short = F.concat(F.substring("a1", 1, 1), F.substr(F.col("a1"), F.lit(3)))
    worn = F.when((F.col("doc_id") % 5 == 0) & (F.length("a1") > 2), short).otherwise(F.col("a1"))
    return _party(rows.filter("doc_id % 3 in (0, 1)")), _party(rows.filter("doc_id % 3 in (1, 2)").withColumn("a1", worn))


def many_parties(spark: SparkSession, sf_dir: str, parties: int = 5) -> DataFrame:
    """Every person in all parties but one, with a column ``party``."""
    each = F.explode(F.sequence(F.lit(0), F.lit(parties - 1)))
    rows = people(spark, sf_dir).withColumn("party", each).filter(f"(doc_id + party) % {parties} <> 0")
    return rows.select("party", F.col("doc_id").cast("string").alias("rec_id"), *ATTRIBUTES)


def reference_keys(rows: DataFrame) -> DataFrame:
    """Keys of all people, to draw reference values from."""
    return rows.select(key_of(["a1", "a2"]).alias("key"))


#: Of each experiment mode the records a party, the overlap in per cent, the modifications of
#: Bob's records (0: none), the ending and the folder of its files.
MODES = {
    "ex": ((10,), (25,), (0,), ".csv", "datasets/example"),
    "no": ((46116, 4611676), (50,), (0,), ".csv", "datasets"),
    "mod": ((1730,), (50,), (1,), ".csv.gz", "datasets"),
    "lno": ((1729379,), (50,), (0,), ".csv.gz", "datasets"),
    "lmod": ((1729379,), (50,), (1,), ".csv.gz", "datasets"),
    "syn": ((4611, 46116, 461167), (50,), (0,), ".csv", "datasets"),
    "syn_mod": ((4611, 46116, 461167), (50,), (1, 2, 4), ".csv", "datasets"),
    "nc_syn": ((5488, 54886, 548860), (50,), (0,), ".csv", "datasets"),
    "nc_syn_mod": ((5488, 54886, 548860), (50,), (1, 2, 4), ".csv", "datasets"),
}


def dataset_catalogue(mode: str, sizes: Sequence[int] | None = None, overlaps: Sequence[int] | None = None) -> list[tuple[str, str]]:
    """File pairs (Alice's, Bob's) of an experiment mode, ``nc`` or one of ``MODES``; other sizes and overlaps may be named."""
    if mode == "nc":
        return [("datasets/ncvoter-temporal-1.csv", "datasets/ncvoter-temporal-2.csv")]
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    known, shared, mods, ending, folder = MODES[mode]
    name = lambda n, o, kind: f"{folder}/{n}_{o}_overlap_{kind}{ending}"
    return [(name(n, o, "no_mod_alice"), name(n, o, f"with_mod_bob_{m}" if m else "no_mod_bob")) for n in sizes or known for o in overlaps or shared for m in mods]

"""Registered queries of the blocking engine over the party fixture, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import strings
from tessera.operators import clustering, hlsh, metrics, multiparty, psig
from tessera.operators import sorted_neighbourhood as sn
from tessera.operators.blocks import candidate_pairs, frequency_filter, shared_blocks
from tessera.operators.ranking import ranked
from tessera.plans import fixture_sql as S
from tessera.plans import experiments, reports
from tessera.session import materialise
from tessera.sources import parties, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOW = 1
#: Upper limits of a block as shares of Alice's records: one, and those of the sweep.
SHARE, SHARES = 0.05, (0.02, 0.03, 0.04, 0.05, 0.06, 0.07)
HIGH = S.share_of(SHARE)
#: Least records of a block; a reference value for as many records; least similarity in a cluster.
K, MIN_SIM = 10, 0.8
BITS, LENGTH, HASHES = 12, 97, 5
#: Of Hamming LSH: hashes, sampled shares of the attributes' filters, bits of a key, iterations, seed.
H_HASHES, H_SAMPLE, H_BITS, H_ITERATIONS, H_SEED = 30, (60, 40), 45, 40, 42
FOLD = hlsh.LambdaFoldLsh(("a1", "a2"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _keys(party: DataFrame) -> DataFrame:
    return party.select("rec_id", parties.key_of(["a1", "a2"]).alias("key"))


def _n_refs(*both: DataFrame) -> int:
    return -(-max(p.count() for p in both) // K)


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, ref), written: it is read for indexes, clusters and assignments."""
    rows = parties.people(spark, sf_dir)
    return materialise(parties.hashed_values(parties.reference_keys(rows), _n_refs(*parties.parties_of(rows))), "references")


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    a, b = parties.two_parties(spark, sf_dir)
    method = psig.PSignature(S.SIGNATURES, LOW, int(SHARE * a.count()))
    return a, b, method.index(a), method.index(b)


# ---------------------------------------------------------------- scans and scalar functions


@query(with_(S.PARTIES) + "SELECT 'alice' AS party, rec_id, ent_id, a1, a2, a3, a4 FROM alice UNION ALL SELECT 'bob', rec_id, ent_id, a1, a2, a3, a4 FROM bob")
def party_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    return a.withColumn("party", F.lit("alice")).unionByName(b.withColumn("party", F.lit("bob")))


@query(with_(S.PARTIES) + f"SELECT rec_id, i AS at, q[i] AS gram FROM (SELECT rec_id, {S.grams('a1')} AS q FROM alice), unnest(range(1, len(q) + 1)) AS t(i)")
def qgram_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = parties.two_parties(spark, sf_dir)
    return a.select("rec_id", F.posexplode(strings.qgrams(F.col("a1"))).alias("at", "gram")).withColumn("at", (F.col("at") + 1).cast("long"))


_SAME = with_(S.PARTIES, "same AS (SELECT a.rec_id, a.key AS x, b.key AS y, a.a1 AS x1, b.a1 AS y1 FROM alice a JOIN bob b ON a.a2 = b.a2 AND a.a3 = b.a3)")


def _same(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    a, b = a.withColumn("x", parties.key_of(["a1", "a2"])), b.withColumn("y", parties.key_of(["a1", "a2"]))
    return a.join(b.select("y", "a2", "a3", F.col("a1").alias("y1")), ["a2", "a3"]).select("rec_id", "x", "y", F.col("a1").alias("x1"), "y1")


@query(_SAME + f"SELECT rec_id, x, y, round({S.dice('x', 'y')}, 6) AS sim FROM same")
def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(spark, sf_dir).select("rec_id", "x", "y", F.round(strings.dice(F.col("x"), F.col("y")), 6).alias("sim"))


@query(_SAME + f"SELECT rec_id, x1, y1, round({S.edit('x1', 'y1')}, 6) AS sim FROM same")
def editdist_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(spark, sf_dir).select("rec_id", "x1", "y1", F.round(strings.edit_similarity(F.col("x1"), F.col("y1")), 6).alias("sim"))


@query(
    _SAME
    + """SELECT rec_id, x1, y1, round(CASE WHEN x1 = '' OR y1 = '' THEN 0.0 WHEN x1 = y1 THEN 1.0
       WHEN 1.0::DOUBLE - abs(length(x1) - length(y1))::DOUBLE / m < 0.7 THEN 0.0 WHEN levenshtein(x1, y1) > (1.0::DOUBLE - 0.7::DOUBLE) * m THEN 1.0::DOUBLE - ((1.0::DOUBLE - 0.7::DOUBLE) * m + 1) / m
       ELSE 1.0::DOUBLE - levenshtein(x1, y1)::DOUBLE / m END, 6) AS sim FROM (SELECT *, greatest(length(x1), length(y1)) AS m FROM same)"""
)
def editdist_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(spark, sf_dir).select("rec_id", "x1", "y1", F.round(strings.edit_similarity_at_least(F.col("x1"), F.col("y1"), 0.7), 6).alias("sim"))


@query(with_(S.PARTIES) + f"SELECT a1, unnest({S.filter_bits('a1', HASHES, LENGTH)}) AS bit FROM (SELECT DISTINCT a1 FROM alice)")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = parties.two_parties(spark, sf_dir)
    return a.select("a1").distinct().select("a1", F.explode(strings.bloom_filter(F.col("a1"), HASHES, LENGTH)).alias("bit")).withColumn("bit", F.col("bit").cast("long"))


@query(
    _SAME
    + f"""SELECT x1, y1, round(2.0::DOUBLE * len(list_intersect(p, q)) / (len(p) + len(q)), 6) AS sim
       FROM (SELECT x1, y1, {S.filter_bits("x1", HASHES, LENGTH)} AS p, {S.filter_bits("y1", HASHES, LENGTH)} AS q FROM (SELECT DISTINCT x1, y1 FROM same))"""
)
def bloom_dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bf = lambda c: strings.bloom_filter(F.col(c), HASHES, LENGTH)
    return _same(spark, sf_dir).select("x1", "y1").distinct().select("x1", "y1", F.round(strings.bloom_dice(bf("x1"), bf("y1")), 6).alias("sim"))


@query(
    with_(S.PARTIES)
    + """, firsts AS ((SELECT a1, a2 FROM alice ORDER BY rec_id::BIGINT LIMIT 10000) UNION ALL (SELECT a1, a2 FROM bob ORDER BY rec_id::BIGINT LIMIT 10000))
       SELECT floor(sum(length(a1))::DOUBLE / count(*))::BIGINT AS a1, floor(sum(length(a2))::DOUBLE / count(*))::BIGINT AS a2 FROM firsts"""
)
def attr_avg_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hlsh.mean_lengths(*parties.two_parties(spark, sf_dir), ["a1", "a2"])


@query(
    ORACLES["attr_avg_len"].replace("SELECT floor(sum(length(a1))", "SELECT ceil(1.0::DOUBLE / (1.0::DOUBLE - pow(0.5::DOUBLE, 1.0::DOUBLE / (30 * (a1 + 1)))))::BIGINT AS a1, ceil(1.0::DOUBLE / (1.0::DOUBLE - pow(0.5::DOUBLE, 1.0::DOUBLE / (30 * (a2 + 1)))))::BIGINT AS a2 FROM (SELECT floor(sum(length(a1))")
    + ")"
)
def bf_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = hlsh.mean_lengths(*parties.two_parties(spark, sf_dir), ["a1", "a2"])
    size = lambda c: F.ceil(F.lit(1.0) / (F.lit(1.0) - F.pow(F.lit(0.5), F.lit(1.0) / (30 * (F.col(c) + 1))))).alias(c)
    return means.select(size("a1"), size("a2"))


@query()
def metaphone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.phonetic import metaphone

    a, _ = parties.two_parties(spark, sf_dir)
    return a.select("a1").distinct().select("a1", metaphone(F.col("a1")).alias("sound"))


# ---------------------------------------------------------------- probability signatures

_SIGNED = with_(S.PARTIES, S.signed(S.SIGNATURES, LOW, HIGH))
_PAIRS = "pairs AS (SELECT DISTINCT ka.rec_id AS a, kb.rec_id AS b FROM ka JOIN kb USING (block))"
_GRAMMAR = ("0,q3", "1,*:0,0", "0,1:1,30")


@query(
    with_(S.PARTIES)
    + f"""SELECT block, rec_id FROM (
        SELECT unnest(CASE WHEN length(a1) < 3 THEN [a1] ELSE list_transform(range(1, length(a1) - 1), lambda i: substr(a1, i, 3) || '_0') END) AS block, rec_id FROM alice
        UNION ALL SELECT {S.signature(_GRAMMAR[1])}, rec_id FROM alice UNION ALL SELECT {S.signature(_GRAMMAR[2])}, rec_id FROM alice) WHERE block <> ''"""
)
def psig_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = parties.two_parties(spark, sf_dir)
    return psig.signatures(a, _GRAMMAR).filter("block <> ''")


@query(_SIGNED + "SELECT block, rec_id FROM ka")
def psig_freq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)[2]


@query(
    _SIGNED
    + f""", ba AS (SELECT DISTINCT block, unnest({S.bits("block", HASHES, 509)}) AS bit FROM sa), bb AS (SELECT DISTINCT unnest({S.bits("block", HASHES, 509)}) AS bit FROM sb),
       common AS (SELECT DISTINCT bit FROM ba WHERE bit IN (SELECT bit FROM bb))
       SELECT block, rec_id FROM sa WHERE block NOT IN (SELECT block FROM ba WHERE bit NOT IN (SELECT bit FROM common))"""
)
def psig_common_bf(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (psig.signatures(p, S.SIGNATURES) for p in parties.two_parties(spark, sf_dir))
    return psig.in_common_filter(a, psig.common_bits(a, b, HASHES, 509), HASHES, 509)


@query(_SIGNED + "SELECT block, na, nb FROM (SELECT block, count(*) AS na FROM ka GROUP BY block) JOIN (SELECT block, count(*) AS nb FROM kb GROUP BY block) USING (block)")
def psig_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ma, mb = _members(spark, sf_dir)
    return shared_blocks(ma, mb)


@query(_SIGNED + ", " + _PAIRS + " " + S.assessment("pairs"))
def psig_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, ma, mb = _members(spark, sf_dir)
    return metrics.assess_blocks(a, b, ma, mb)


@query(_SIGNED + "SELECT min(n) AS min_bpr, max(n) AS max_bpr, avg(n) AS avg_bpr FROM (SELECT rec_id, count(*) AS n FROM ka GROUP BY rec_id)")
def psig_blocks_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.blocks_per_record(_members(spark, sf_dir)[2])


@query(
    with_(S.PARTIES)
    + """, ka AS (SELECT k || '_' || s AS block, rec_id FROM (SELECT 0 AS k, substr(a1, 1, 1) || substr(a2, 1, 2) AS s, rec_id FROM alice UNION ALL SELECT 1, a2 || substr(a1, 2, 2), rec_id FROM alice))
       SELECT block, rec_id FROM ka WHERE block IN (SELECT block FROM ka GROUP BY block HAVING count(*) > (SELECT floor(0.002::DOUBLE * count(*)) FROM alice) AND count(*) <= (SELECT floor(0.05::DOUBLE * count(*)) FROM alice))"""
)
def psig_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda f, *pos: {"type": "characters-at", "feature": f, "config": {"pos": list(pos)}}
    config = {"signatureSpecs": [[at("a1", 0), at("a2", "0:2")], [{"type": "feature-value", "feature": "a2"}, at("a1", "1:3")]], "filter": {"type": "ratio", "min": 0.002, "max": 0.05}}
    return psig.ConfiguredSignature(config).index(parties.two_parties(spark, sf_dir)[0])


# ---------------------------------------------------------------- candidate pairs and metrics


@query(_SIGNED + "SELECT DISTINCT ka.rec_id AS a, kb.rec_id AS b FROM ka JOIN kb USING (block)")
def cand_pairs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ma, mb = _members(spark, sf_dir)
    return candidate_pairs(ma, mb)


@query(_SIGNED + ", s AS (" + ORACLES["psig_blocks"].removeprefix(_SIGNED) + ") SELECT coalesce(sum(na * nb), 0)::BIGINT AS cand_total, count(*) AS num_blocks FROM s")
def cand_pairs_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ma, mb = _members(spark, sf_dir)
    return metrics.total_pairs(shared_blocks(ma, mb))


@query(
    _SIGNED
    + """SELECT min(n) AS min_blk, quantile_cont(n, 0.5)::DOUBLE AS med_blk, greatest(max(n), 1) AS max_blk, avg(n) AS avg_blk, round(stddev_pop(n), 6) AS std_dev, count(*) AS num_blocks
       FROM (SELECT block, count(*) AS n FROM ka GROUP BY block)"""
)
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.block_stats(_members(spark, sf_dir)[2]).withColumn("std_dev", F.round("std_dev", 6))


@query(
    _SIGNED
    + """, m AS (SELECT DISTINCT block, rec_id FROM ka), deg AS (SELECT rec_id, count(*) AS d FROM m GROUP BY rec_id),
       co AS (SELECT x.rec_id AS r, y.rec_id AS s, count(*) AS c FROM m x JOIN m y USING (block) GROUP BY 1, 2)
       SELECT r AS rec_id, round(1.0::DOUBLE / count(*), 9) AS risk FROM co JOIN deg ON deg.rec_id = r WHERE c = d GROUP BY r"""
)
def disclosure_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.disclosure_risk(_members(spark, sf_dir)[2]).withColumn("risk", F.round("risk", 9))


@query(
    _SIGNED
    + """SELECT round(1.0::DOUBLE - max(n) / c, 9) AS rg_max, round(1.0::DOUBLE - avg(n) / c, 9) AS rg_avg, round(1.0::DOUBLE - min(n) / c, 9) AS rg_min, max(qm) AS qg_max, round(max(qa), 9) AS qg_avg
       FROM (SELECT block, count(*)::DOUBLE AS n FROM ka GROUP BY block), (SELECT count(*)::DOUBLE AS c FROM alice), (SELECT max(q) AS qm, avg(q) AS qa FROM (SELECT rec_id, count(*) AS q FROM ka GROUP BY rec_id)) GROUP BY c"""
)
def rg_qg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, ma, _ = _members(spark, sf_dir)
    g = metrics.guarantees(ma, a.count())
    return g.select(*[F.round(c, 9).alias(c) if c != "qg_max" else F.col(c) for c in g.columns])


@query(_SIGNED + "SELECT block, na * nb AS pairs FROM (" + ORACLES["psig_blocks"].removeprefix(_SIGNED) + ") ORDER BY pairs DESC, block LIMIT 20")
def largest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ma, mb = _members(spark, sf_dir)
    return shared_blocks(ma, mb).select("block", (F.col("na") * F.col("nb")).alias("pairs")).orderBy(F.desc("pairs"), "block").limit(20)


@query(
    "WITH "
    + ORACLES["disclosure_risk"].removeprefix("WITH ").replace("SELECT r AS rec_id", "risks AS (SELECT r AS rec_id", 1).replace("SELECT DISTINCT block", "SELECT DISTINCT block", 1).replace("GROUP BY 1, 2)\n", "GROUP BY 1, 2),\n")
    + ") SELECT row_number() OVER (ORDER BY risk, rec_id) AS at, risk FROM risks"
)
def risk_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(disclosure_risk(spark, sf_dir), ["risk", "rec_id"], "at").select("at", "risk")


@query(
    _SIGNED
    + """, m AS (SELECT 'a' AS p, block, rec_id FROM ka UNION SELECT 'b', block, rec_id FROM kb), deg AS (SELECT p, rec_id, count(*) AS d FROM m GROUP BY p, rec_id),
       co AS (SELECT x.p, x.rec_id AS r, y.rec_id AS s, count(*) AS c FROM m x JOIN m y ON x.p = y.p AND x.block = y.block GROUP BY 1, 2, 3),
       risk AS (SELECT co.p, r AS rec_id, round(1.0::DOUBLE / count(*), 9) AS risk FROM co JOIN deg ON deg.p = co.p AND deg.rec_id = r WHERE c = d GROUP BY co.p, r)
       SELECT rec_id, max(risk) FILTER (p = 'a') AS arisk, max(risk) FILTER (p = 'b') AS brisk FROM risk GROUP BY rec_id"""
)
def aligned_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ma, mb = _members(spark, sf_dir)
    both = sinks.aligned_risks(metrics.disclosure_risk(ma), metrics.disclosure_risk(mb))
    return both.select("rec_id", F.round("arisk", 9).alias("arisk"), F.round("brisk", 9).alias("brisk"))


@query(_SIGNED + "SELECT block || ',' || string_agg(rec_id, ',' ORDER BY rec_id) AS value FROM ka GROUP BY block")
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.block_lines(_members(spark, sf_dir)[2])


# ---------------------------------------------------------------- reference values and sorted neighbourhoods

_REFS = (S.PARTIES, S.refs(S.n_refs(K)), S.indexed("refs"))
_ASOF = "below AS (SELECT key, max(idx) AS idx FROM (SELECT DISTINCT key FROM {0}) JOIN indexed ON ref <= key OR idx = 0 GROUP BY key)"
_PREFIX = "substr({0}, 1, (3 * least(length({1}), length({2}))) // 4)"


def _near(a: str, b: str) -> str:
    return S.dice(_PREFIX.format(a, a, b), _PREFIX.format(b, a, b))


@query(with_(S.PARTIES, S.refs(S.n_refs(K))) + "SELECT pos, ref FROM refs")
def ref_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


@query(with_(*_REFS) + "SELECT idx, ref FROM indexed")
def ref_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.reference_index(_refs(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))


@query(with_(*_REFS) + f"SELECT a.idx, round({_near('a.ref', 'b.ref')}, 6) AS sim FROM indexed a JOIN indexed b ON b.idx = a.idx + 1")
def ref_next_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.next_similarity(sn.reference_index(_refs(spark, sf_dir))).select(F.col("idx").cast("long").alias("idx"), F.round("sim", 6).alias("sim"))


@query(with_(*_REFS, _ASOF.format("alice")) + "SELECT rec_id, idx FROM alice JOIN below USING (key)")
def asof_ref_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(parties.two_parties(spark, sf_dir)[0])
    return keys.join(sn.assign(keys, sn.reference_index(_refs(spark, sf_dir))), "key").select("rec_id", F.col("idx").cast("long").alias("idx"))


def _folded(party: str, tag: str, indexed: str = "indexed") -> str:
    """Ranges of the SIM fold as ``ranges_<tag>(lo, hi, n)``, by a recursive query over the indexes."""
    return f"""asof_{tag} AS (SELECT key, max(idx) AS idx FROM (SELECT DISTINCT key FROM {party}) JOIN {indexed} ON ref <= key OR idx = 0 GROUP BY key),
sized_{tag} AS (SELECT i.idx, i.ref, count(p.rec_id) AS n FROM {indexed} i LEFT JOIN (SELECT rec_id, idx FROM {party} JOIN asof_{tag} USING (key)) p ON p.idx = i.idx GROUP BY i.idx, i.ref),
near_{tag} AS (SELECT b.idx, b.n, {_near("a.ref", "b.ref")} AS sim FROM sized_{tag} a JOIN sized_{tag} b ON b.idx = a.idx + 1),
fold_{tag} AS (SELECT idx, idx AS lo, n AS held FROM sized_{tag} WHERE idx = 0
    UNION ALL SELECT x.idx, CASE WHEN f.held <= {K} OR x.sim >= 0.8 THEN f.lo ELSE x.idx END, CASE WHEN f.held <= {K} OR x.sim >= 0.8 THEN f.held + x.n ELSE x.n END
    FROM fold_{tag} f JOIN near_{tag} x ON x.idx = f.idx + 1),
raw_{tag} AS (SELECT lo, max(idx) AS hi, max(held) AS n FROM fold_{tag} GROUP BY lo),
tail_{tag} AS (SELECT *, row_number() OVER (ORDER BY lo DESC) AS back, lead(hi) OVER (ORDER BY lo) AS next_hi, lead(n) OVER (ORDER BY lo) AS next_n, count(*) OVER () AS m FROM raw_{tag}),
ranges_{tag} AS (SELECT lo, CASE WHEN back = 2 AND next_n < {K} THEN next_hi ELSE hi END AS hi, CASE WHEN back = 2 AND next_n < {K} THEN n + next_n ELSE n END AS n
    FROM tail_{tag} WHERE NOT (back = 1 AND m > 1 AND n < {K})),
members_{tag} AS (SELECT lo AS block, lo, hi, rec_id FROM {party} JOIN asof_{tag} USING (key) JOIN ranges_{tag} ON idx BETWEEN lo AND hi)"""


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def _three(spark: SparkSession, sf_dir: str, how: str = "SIM") -> tuple[DataFrame, DataFrame, sn.SortedNeighbourhood]:
    return *parties.two_parties(spark, sf_dir), sn.SortedNeighbourhood(_refs(spark, sf_dir), K, MIN_SIM, how)


@query(_recursive(*_REFS, _folded("alice", "a")) + "SELECT block, lo, hi, rec_id FROM members_a")
def sn3p_sim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, method = _three(spark, sf_dir)
    return method.index(_keys(a))


#: The fold by size as a recursive query over one list of ranges: of the smallest below K, the oldest
#: merges into the smaller of its neighbours, the later one if they are equal.
_BY_SIZE = f"""asof_s AS (SELECT key, max(idx) AS idx FROM (SELECT DISTINCT key FROM alice) JOIN indexed ON ref <= key OR idx = 0 GROUP BY key),
sized_s AS (SELECT i.idx, count(p.rec_id) AS n FROM indexed i LEFT JOIN (SELECT rec_id, idx FROM alice JOIN asof_s USING (key)) p ON p.idx = i.idx GROUP BY i.idx),
fold_s AS (SELECT 0::BIGINT AS step, list({{'n': n, 'age': idx::BIGINT, 'lo': idx::BIGINT, 'hi': idx::BIGINT}} ORDER BY idx) AS r, count(*)::BIGINT AS clock FROM sized_s
    UNION ALL SELECT step + 1, list_concat(list_concat(r[1:into_ - 1], [{{'n': r[into_].n + r[into_ + 1].n, 'age': clock, 'lo': r[into_].lo, 'hi': r[into_ + 1].hi}}]), r[into_ + 2:]), clock + 1
    FROM (SELECT step, r, clock, CASE WHEN place = 1 THEN 1 WHEN place = len(r) THEN place - 1 WHEN r[place - 1].n < r[place + 1].n THEN place - 1 ELSE place END AS into_
        FROM (SELECT step, r, clock, smallest['n'] AS least, smallest['place'] AS place
            FROM (SELECT step, r, clock, list_sort(list_transform(range(1, len(r) + 1), lambda i: {{'n': r[i].n, 'age': r[i].age, 'place': i}}))[1] AS smallest FROM fold_s)) WHERE least < {K} AND len(r) > 1)),
ranges_s AS (SELECT x.lo AS lo, x.hi AS hi FROM (SELECT unnest(r) AS x FROM fold_s WHERE step = (SELECT max(step) FROM fold_s)))"""


@query(_recursive(*_REFS, _BY_SIZE) + "SELECT lo AS block, lo, hi, rec_id FROM alice JOIN asof_s USING (key) JOIN ranges_s ON idx BETWEEN lo AND hi")
def sn3p_size_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, method = _three(spark, sf_dir, "SIZE")
    return method.index(_keys(a))


_SN3P = _recursive(*_REFS, _folded("alice", "a"), _folded("bob", "b"))


@query(_SN3P + "SELECT DISTINCT a.lo AS a_block, b.lo AS b_block FROM ranges_a a JOIN ranges_b b ON greatest(a.lo - 1, 0) <= b.hi AND b.lo <= a.hi + 1 WHERE a.n > 0 AND b.n > 0")
def sn3p_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, method = _three(spark, sf_dir)
    method.overlap = 1
    return method.match(method.index(_keys(a)), method.index(_keys(b)))


_SN3P_PAIRS = ", pairs AS (SELECT DISTINCT x.rec_id AS a, y.rec_id AS b FROM members_a x JOIN members_b y ON x.lo <= y.hi AND y.lo <= x.hi) "


@query(_SN3P + _SN3P_PAIRS + S.assessment("pairs"))
def sn3p_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, method = _three(spark, sf_dir)
    return metrics.assess(a, b, method.pairs(method.index(_keys(a)), method.index(_keys(b))))


_TWO = (
    S.PARTIES,
    S.refs(S.n_refs(K), "refs_a", "alice", "a"),
    S.refs(S.n_refs(K), "refs_b", "bob", "b"),
    S.indexed("refs_a", "indexed_a"),
    S.indexed("refs_b", "indexed_b"),
)
_WINDOWS = """vals AS (SELECT ref, max(a) AS a, max(b) AS b FROM (SELECT ref, 1 AS a, 0 AS b FROM {0} UNION ALL SELECT ref, 0, 1 FROM {1}) GROUP BY ref),
ranked AS (SELECT *, row_number() OVER (ORDER BY ref) AS rn, count(*) OVER () AS total FROM vals),
starts AS (SELECT rn AS start, total FROM ranked WHERE rn <= total - 3),
ends AS (SELECT start, min(e.rn) AS stop FROM starts s, ranked e WHERE e.rn >= start + 3 AND (e.rn = e.total OR (
    (SELECT sum(a) FROM ranked r WHERE r.rn BETWEEN s.start AND e.rn) >= 2 AND (SELECT sum(b) FROM ranked r WHERE r.rn BETWEEN s.start AND e.rn) >= 2)) GROUP BY start)"""


def _two_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    a, b = parties.two_parties(spark, sf_dir)
    n = _n_refs(a, b)
    ra = materialise(parties.hashed_values(_keys(a), n, "a"), "references")
    rb = materialise(parties.hashed_values(_keys(b), n, "b"), "references")
    return a, b, ra, rb


@query(with_(*_TWO, _WINDOWS.format("refs_a", "refs_b")) + "SELECT start, stop FROM ends")
def sn2p_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ra, rb = _two_refs(spark, sf_dir)
    return sn.window_ends(sn.windows(ra.select("ref"), rb.select("ref"), 2), 2).select(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


_SN2P = _recursive(*_TWO, _folded("alice", "a", "indexed_a"), _folded("bob", "b", "indexed_b"))
_SN2P += """, at_a AS (SELECT ref, lo AS block FROM indexed_a JOIN (SELECT DISTINCT lo, hi FROM members_a) ON idx BETWEEN lo AND hi WHERE idx > 0),
at_b AS (SELECT ref, lo AS block FROM indexed_b JOIN (SELECT DISTINCT lo, hi FROM members_b) ON idx BETWEEN lo AND hi WHERE idx > 0), """
_SN2P += _WINDOWS.format("at_a", "at_b")
_SN2P += """, met AS (SELECT DISTINCT x.ref AS a_ref, y.ref AS b_ref FROM ends JOIN ranked x ON x.rn BETWEEN start AND stop AND x.a = 1 JOIN ranked y ON y.rn BETWEEN start AND stop AND y.b = 1),
linked AS (SELECT at_a.block AS a_block, at_b.block AS b_block FROM met JOIN at_a ON at_a.ref = a_ref JOIN at_b ON at_b.ref = b_ref) """


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, sn.TwoPartySortedNeighbourhood, DataFrame, DataFrame]:
    a, b, ra, rb = _two_refs(spark, sf_dir)
    method = sn.TwoPartySortedNeighbourhood(ra, rb, K)
    return a, b, method, method.index(_keys(a), "a"), method.index(_keys(b), "b")


@query(_SN2P + "SELECT a_block, b_block FROM linked")
def sn2p_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, method, ma, mb = _two(spark, sf_dir)
    return method.match(ma, mb)


@query(_SN2P.rstrip() + ", pairs AS (SELECT DISTINCT x.rec_id AS a, y.rec_id AS b FROM linked JOIN members_a x ON x.block = a_block JOIN members_b y ON y.block = b_block) " + S.assessment("pairs"))
def sn2p_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, method, ma, mb = _two(spark, sf_dir)
    return metrics.assess(a, b, method.pairs(ma, mb))


# ---------------------------------------------------------------- Hamming and Lambda-fold LSH


def _hlsh(a: DataFrame, b: DataFrame) -> hlsh.HammingLsh:
    """Filter lengths come from the parties' values."""
    return hlsh.HammingLsh(("a1", "a2"), hlsh.filter_lengths(a, b, ["a1", "a2"], H_HASHES), H_SAMPLE, H_BITS, H_ITERATIONS, H_HASHES, H_SEED)


def _key_sql(k: int, sample: tuple[int, ...] | list[int]) -> str:
    return f"'{k}_' || array_to_string(list_transform({S.literal(sample)}, lambda p: CASE WHEN list_contains(bf, p) THEN '1' ELSE '0' END), '')"


def _layouts(means: range) -> str:
    """What the seed draws for each pair of mean lengths of the attributes, for the SQL to choose from."""
    rows = []
    for m1 in means:
        for m2 in means:
            lengths = [strings.bloom_length(m, H_HASHES, 0.5) for m in (m1, m2)]
            drawn = hlsh.Layout.make(lengths, H_SAMPLE, H_BITS, H_ITERATIONS, H_SEED)
            rows.append(f"SELECT {m1} AS m1, {m2} AS m2, {lengths[0]} AS l1, {lengths[1]} AS l2, {S.literal(drawn.places(0))} AS p1, {S.literal(drawn.places(1))} AS p2, [{', '.join(map(S.literal, drawn.samples))}] AS samples")
    return " UNION ALL ".join(rows)


_LAYOUT = (
    "means AS (" + ORACLES["attr_avg_len"].removeprefix(with_(S.PARTIES)).replace(", firsts AS (", "WITH firsts AS (", 1).lstrip() + ")",
    "layout AS (SELECT l.* FROM (" + _layouts(range(3, 6)) + ") l JOIN means ON a1 = m1 AND a2 = m2)",
)


def _hlsh_rows(party: str, tag: str) -> str:
    part = lambda k: f"list_transform({S.filter_bits(f'a{k}', H_HASHES, f'l{k}')}, lambda b: p{k}[b + 1])"
    key = "t || '_' || array_to_string(list_transform(samples[t + 1], lambda p: CASE WHEN list_contains(bf, p) THEN '1' ELSE '0' END), '')"
    return f"""bf_{tag} AS (SELECT a1, a2, samples, list_concat({part(1)}, {part(2)}) AS bf FROM (SELECT DISTINCT a1, a2 FROM {party}), layout),
h{tag} AS (SELECT {key} AS block, rec_id FROM {party} JOIN bf_{tag} USING (a1, a2), unnest(range(0, {H_ITERATIONS})) AS u(t))"""


@query(with_(S.PARTIES, *_LAYOUT, _hlsh_rows("alice", "a")) + "SELECT block, rec_id FROM ha")
def hlsh_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    return _hlsh(a, b).index(a)


_HLSH = with_(S.PARTIES, *_LAYOUT, _hlsh_rows("alice", "a"), _hlsh_rows("bob", "b"))


@query(_HLSH + "SELECT block, na, nb FROM (SELECT block, count(*) AS na FROM ha GROUP BY block) JOIN (SELECT block, count(*) AS nb FROM hb GROUP BY block) USING (block)")
def hlsh_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    method = _hlsh(a, b)
    return method.match(method.index(a), method.index(b))


@query(_HLSH.rstrip() + ", pairs AS (SELECT DISTINCT ha.rec_id AS a, hb.rec_id AS b FROM ha JOIN hb USING (block)) " + S.assessment("pairs"))
def hlsh_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    method = _hlsh(a, b)
    # a record's keys follow from its names: the first of each combination stands for all
    first = lambda p: p.groupBy(*method.attributes).agg(F.min("rec_id").alias("rec_id"))
    ma, mb = (materialise(method.index(first(p)), "members") for p in (a, b))
    return metrics.assess_blocks(a, b, ma, mb, method.attributes)


def _fold_rows(party: str, tag: str) -> str:
    keys = ", ".join(_key_sql(k, s) for k, s in enumerate(FOLD.samples()))
    bf = "list_distinct(list_concat(" + ", ".join(S.filter_bits(c, FOLD.hashes, FOLD.length) for c in FOLD.attributes) + "))"
    return f"bf_{tag} AS (SELECT a1, a2, {bf} AS bf FROM (SELECT DISTINCT a1, a2 FROM {party})), l{tag} AS (SELECT unnest([{keys}]) AS block, rec_id FROM {party} JOIN bf_{tag} USING (a1, a2))"


@query(with_(S.PARTIES, _fold_rows("alice", "a")) + "SELECT block, rec_id FROM la")
def lambda_fold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FOLD.index(parties.two_parties(spark, sf_dir)[0])


@query(with_(S.PARTIES, _fold_rows("alice", "a"), _fold_rows("bob", "b")) + "SELECT block, na, nb FROM (SELECT block, count(*) AS na FROM la GROUP BY block) JOIN (SELECT block, count(*) AS nb FROM lb GROUP BY block) USING (block)")
def lambda_fold_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FOLD.match(*(FOLD.index(p) for p in parties.two_parties(spark, sf_dir)))


# ---------------------------------------------------------------- clustering of reference values


def _nearest(party: str, tag: str, values: str) -> str:
    return f"""sim_{tag} AS (SELECT key, pos, cluster, {S.dice("key", "ref")} AS sim FROM (SELECT DISTINCT key FROM {party}), {values}),
best_{tag} AS (SELECT key, arg_max(cluster, (round(sim, 12), -cluster, -pos)) AS cluster, max(sim) AS sim FROM sim_{tag} GROUP BY key),
n{tag} AS (SELECT CASE WHEN sim > 0 THEN cluster ELSE -1 END AS block, rec_id, sim FROM {party} JOIN best_{tag} USING (key))"""


#: Each value points at its most similar predecessors; its cluster is the oldest first value it reaches.
_GROWN = f"""before AS (SELECT x.pos, y.pos AS prev, {S.dice("x.ref", "y.ref")} AS sim FROM refs x JOIN refs y ON y.pos < x.pos),
pointers AS (SELECT pos, prev FROM before WHERE sim >= {MIN_SIM} QUALIFY sim = max(sim) OVER (PARTITION BY pos)),
reach AS (SELECT pos, pos AS prev FROM refs UNION SELECT r.pos, p.prev FROM reach r JOIN pointers p ON p.pos = r.prev),
clusters AS (SELECT pos, ref, cluster FROM refs JOIN (SELECT pos, min(prev) AS cluster FROM reach WHERE prev NOT IN (SELECT pos FROM pointers) GROUP BY pos) USING (pos)),
sums AS (SELECT x.cluster, x.ref, round(sum({S.dice("x.ref", "y.ref")}) - 1, 9) AS s FROM clusters x JOIN clusters y ON x.cluster = y.cluster GROUP BY x.cluster, x.ref),
centers AS (SELECT cluster, cluster AS pos, arg_max(ref, (s, ref)) AS ref FROM sums GROUP BY cluster)"""
_GROWING = _recursive(S.PARTIES, S.refs(S.n_refs(K)), _GROWN)
_KNN = _GROWING.rstrip() + ", " + _nearest("alice", "a", "centers") + ", " + _nearest("bob", "b", "centers") + " "


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(clustering.medoids(clustering.nearest_neighbour_frame(_refs(spark, sf_dir), MIN_SIM)), "centers")


@query(_GROWING + "SELECT pos, cluster, ref FROM clusters")
def knn_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.nearest_neighbour_frame(_refs(spark, sf_dir), MIN_SIM)
    return found.select(F.col("pos").cast("long").alias("pos"), F.col("cluster").cast("long").alias("cluster"), "ref")


@query(_GROWING + "SELECT cluster, ref FROM centers")
def knn_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, sf_dir).select(F.col("cluster").cast("long").alias("cluster"), "ref")


@query(_KNN + "SELECT rec_id, block, round(sim, 6) AS sim FROM na")
def knn_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(parties.two_parties(spark, sf_dir)[0])
    best = clustering.assign_nearest(keys, _centers(spark, sf_dir))
    return keys.join(best, "key").select("rec_id", F.col("cluster").cast("long").alias("block"), F.round("sim", 6).alias("sim"))


@query(_KNN + f"SELECT block, na, nb FROM (SELECT block, count(*) AS na FROM na GROUP BY block) JOIN (SELECT block, count(*) AS nb FROM nb GROUP BY block) USING (block) WHERE na >= {K} AND nb >= {K}")
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = clustering.NearestNeighbour(_centers(spark, sf_dir), K)
    return method.match(*(method.index(_keys(p)) for p in parties.two_parties(spark, sf_dir))).withColumn("block", F.col("block").cast("long"))


_KEPT = "ok AS (SELECT block FROM na GROUP BY block HAVING count(*) >= {0} INTERSECT SELECT block FROM nb GROUP BY block HAVING count(*) >= {0})"


@query(_KNN.rstrip() + ", " + _KEPT.format(K) + ", pairs AS (SELECT DISTINCT na.rec_id AS a, nb.rec_id AS b FROM na JOIN nb USING (block) WHERE block IN (SELECT block FROM ok)) " + S.assessment("pairs"))
def knn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    method = clustering.NearestNeighbour(_centers(spark, sf_dir), K)
    ma, mb = (materialise(method.index(_keys(p)), "members") for p in (a, b))
    kept = method.match(ma, mb).select("block")
    return metrics.assess_blocks(a, b, ma.join(kept, "block", "left_semi"), mb.join(kept, "block", "left_semi"))


_KS = (3, 10, 20, 50, 100)


@query(
    _KNN.rstrip()
    + ", shared AS (SELECT block, na, nb FROM (SELECT block, count(*) AS na FROM na GROUP BY block) JOIN (SELECT block, count(*) AS nb FROM nb GROUP BY block) USING (block)) "
    + " UNION ALL ".join(f"SELECT {k} AS k, coalesce(sum(na * nb), 0)::BIGINT AS cand_total, count(*) AS num_blocks FROM shared WHERE na >= {k} AND nb >= {k}" for k in _KS)
)
def knn_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = clustering.NearestNeighbour(_centers(spark, sf_dir), 0)
    shared = materialise(method.match(*(method.index(_keys(p)) for p in parties.two_parties(spark, sf_dir))), "shared")
    return reduce(DataFrame.unionByName, [metrics.total_pairs(shared.filter((F.col("na") >= k) & (F.col("nb") >= k))).select(F.lit(k).alias("k"), "cand_total", "num_blocks") for k in _KS])


#: Average linkage as a recursive query: a row for each value with its cluster's number, and at each
#: step the pair of clusters that is most alike, the first of equal ones, gets a new number.
_LINKED = f"""alike AS (SELECT x.pos AS i, y.pos AS j, {S.dice("x.ref", "y.ref")} AS sim FROM refs x JOIN refs y ON x.pos <> y.pos),
total AS (SELECT count(*) AS r, greatest(count(*) // 3, 1) AS wanted FROM refs),
linked AS (SELECT 0::BIGINT AS step, pos::BIGINT AS cluster, pos FROM refs
    UNION ALL SELECT l.step + 1, CASE WHEN l.cluster IN (p.x, p.y) THEN r + l.step ELSE l.cluster END, l.pos
    FROM linked l, total, (SELECT a.cluster AS x, b.cluster AS y FROM linked a JOIN alike ON i = a.pos JOIN linked b ON j = b.pos WHERE a.cluster < b.cluster
        GROUP BY a.cluster, b.cluster ORDER BY round(avg(sim), 9) DESC, x, y LIMIT 1) p
    WHERE r - l.step > wanted),
clusters AS (SELECT l.pos, cluster, ref FROM linked l JOIN refs ON refs.pos = l.pos WHERE step = (SELECT max(step) FROM linked))"""
_LINKING = _recursive(S.PARTIES, S.refs(S.n_refs(K)), _LINKED)
_HCLUST = _LINKING.rstrip() + ", " + _nearest("alice", "a", "clusters") + ", " + _nearest("bob", "b", "clusters") + ", firsts AS (SELECT min(cluster) AS one FROM clusters) "


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, cluster, ref), written; the values come to the driver."""
    rows = _refs(spark, sf_dir).orderBy("pos").collect()
    found = clustering.average_linkage([r["ref"] for r in rows], len(rows) // 3)
    place = {r["ref"]: r["pos"] for r in rows}
    return materialise(spark.createDataFrame([(place[v], c, v) for c, members in found.items() for v in members], "pos int, cluster int, ref string"), "linked")


@query(_LINKING + "SELECT pos, cluster, ref FROM clusters")
def hclust_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(F.col("pos").cast("long").alias("pos"), F.col("cluster").cast("long").alias("cluster"), "ref")


@query(_HCLUST + "SELECT rec_id, CASE WHEN block < 0 THEN one ELSE block END AS block FROM na, firsts")
def hclust_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(parties.two_parties(spark, sf_dir)[0])
    return clustering.HierarchicalClustering(_linked(spark, sf_dir)).index(keys).select("rec_id", F.col("block").cast("long").alias("block"))


@query(
    _HCLUST
    + """SELECT block, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT DISTINCT cluster AS block FROM clusters)
       LEFT JOIN (SELECT CASE WHEN block < 0 THEN one ELSE block END AS block, count(*) AS na FROM na, firsts GROUP BY 1) USING (block)
       LEFT JOIN (SELECT CASE WHEN block < 0 THEN one ELSE block END AS block, count(*) AS nb FROM nb, firsts GROUP BY 1) USING (block)"""
)
def hclust_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = clustering.HierarchicalClustering(_linked(spark, sf_dir))
    ma, mb = (method.padded(method.index(_keys(p))) for p in parties.two_parties(spark, sf_dir))
    return method.match(ma, mb).withColumn("block", F.col("block").cast("long"))


@query(
    _HCLUST
    + """, sizes AS (SELECT block, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster AS block FROM clusters)
        LEFT JOIN (SELECT CASE WHEN block < 0 THEN one ELSE block END AS block, count(*) AS n FROM na, firsts GROUP BY 1) USING (block)),
       drawn AS (SELECT block, (('0x' || substr(md5('7:' || block), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE - 0.5::DOUBLE AS u, (SELECT avg(n) FROM sizes) AS mean FROM sizes)
       SELECT block, greatest(trunc((-2.0::DOUBLE / 0.3::DOUBLE) * ln(2.0::DOUBLE * mean / (mean + 10.0::DOUBLE)) - (2.0::DOUBLE / 0.3::DOUBLE) * sign(u) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs(u)))::INT, 0) AS fakes FROM drawn"""
)
def hclust_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = clustering.HierarchicalClustering(_linked(spark, sf_dir))
    return method.noise(method.index(_keys(parties.two_parties(spark, sf_dir)[0]))).select(F.col("block").cast("long").alias("block"), "fakes")


# ---------------------------------------------------------------- many parties

_MANY = with_(S.MANY, "members AS (SELECT party, substr(a1, 1, 3) || substr(a2, 1, 2) AS block, rec_id FROM records)")


def _many(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = parties.many_parties(spark, sf_dir)
    return records, records.select("party", F.concat(F.substring("a1", 1, 3), F.substring("a2", 1, 2)).alias("block"), "rec_id")


@query(_MANY + "SELECT rec_id AS ent, party, rec_id FROM records WHERE rec_id IN (SELECT rec_id FROM records GROUP BY rec_id HAVING count(DISTINCT party) >= 4)")
def mp_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiparty.true_sets(_many(spark, sf_dir)[0], 4).select("ent", F.col("party").cast("long").alias("party"), "rec_id")


_HELD = "held AS (SELECT * FROM members WHERE block IN (SELECT block FROM members GROUP BY block HAVING count(DISTINCT party) >= 5))"


@query(_MANY.rstrip() + f", {_HELD} SELECT party, block, rec_id FROM held")
def mp_blocks_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiparty.blocks_of_at_least(_many(spark, sf_dir)[1], 5).select(F.col("party").cast("long").alias("party"), "block", "rec_id")


@query(
    _MANY.rstrip()
    + f""", {_HELD}, p AS (SELECT block, product(n) AS p FROM (SELECT block, party, count(*) AS n FROM held GROUP BY block, party) GROUP BY block)
       SELECT comparisons, naive, round(1.0::DOUBLE - comparisons / naive, 9) AS rr FROM (SELECT coalesce(sum(p), 0)::DOUBLE AS comparisons FROM p), (SELECT product(n)::DOUBLE AS naive FROM (SELECT count(*) AS n FROM records GROUP BY party))"""
)
def mp_reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiparty.reduction(*_many(spark, sf_dir), 5).withColumn("rr", F.round("rr", 9))


@query(
    _MANY.rstrip()
    + f""", {_HELD}, truth AS (SELECT rec_id, party FROM records WHERE rec_id IN (SELECT rec_id FROM records GROUP BY rec_id HAVING count(DISTINCT party) >= 4)),
       size AS (SELECT rec_id, count(*) AS n FROM truth GROUP BY rec_id), met AS (SELECT t.rec_id, block, count(*) AS c FROM truth t JOIN (SELECT DISTINCT party, block, rec_id FROM held) h ON h.party = t.party AND h.rec_id = t.rec_id GROUP BY 1, 2)
       SELECT contained, true_sets, contained::DOUBLE / true_sets AS sc FROM (SELECT count(DISTINCT met.rec_id) AS contained FROM met JOIN size ON size.rec_id = met.rec_id WHERE c = n), (SELECT count(*) AS true_sets FROM size)"""
)
def mp_set_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, members = _many(spark, sf_dir)
    truth = multiparty.true_sets(records, 4).select("party", "rec_id").join(records, ["party", "rec_id"])
    return multiparty.set_completeness(truth, multiparty.blocks_of_at_least(members, 5), 4)


@query(
    _MANY.rstrip()
    + """ SELECT party, min(n) AS min_blk, quantile_cont(n, 0.5)::DOUBLE AS med_blk, greatest(max(n), 1) AS max_blk, avg(n) AS avg_blk, round(stddev_pop(n), 6) AS std_dev, count(*) AS num_blocks
       FROM (SELECT party, block, count(*) AS n FROM members GROUP BY party, block) GROUP BY party"""
)
def mp_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.block_stats(_many(spark, sf_dir)[1], "party")
    return stats.withColumns({"party": F.col("party").cast("long"), "std_dev": F.round("std_dev", 6)})


# ---------------------------------------------------------------- sweeps and reports

def _one_of(sql: str, name: str, value: object) -> str:
    return f"SELECT {value} AS {name}, * FROM ({sql})"


def _at_share(share: float) -> str:
    return with_(S.PARTIES, S.signed(S.SIGNATURES, LOW, S.share_of(share)), _PAIRS) + S.assessment("pairs")


def _by_share(spark: SparkSession, sf_dir: str, shares: tuple[float, ...]) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    sa, sb, n = psig.signatures(a, S.SIGNATURES), psig.signatures(b, S.SIGNATURES), a.count()
    found = metrics.assess_limits(a, b, sa, sb, LOW, [int(x * n) for x in shares])
    # the shares are a list in the code, hence the broadcast
    return found.join(F.broadcast(spark.createDataFrame(list(enumerate(shares)), "k int, drop_ratio double")), "k").drop("k").select("drop_ratio", *[c for c in found.columns if c != "k"])


@query(_one_of(_at_share(SHARE), "drop_ratio", f"{SHARE}::DOUBLE"))
def psig_share_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_share(spark, sf_dir, (SHARE,))


@query(" UNION ALL ".join(_one_of(_at_share(x), "drop_ratio", f"{x}::DOUBLE") for x in SHARES))
def drop_ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_share(spark, sf_dir, SHARES)


@query(" UNION ALL ".join(_one_of(with_(S.PARTIES, S.signed(S.SIGNATURES, LOW, S.share_of(x)), "s AS (" + ORACLES["psig_blocks"].removeprefix(_SIGNED) + ")") + "SELECT coalesce(sum(na * nb), 0)::BIGINT AS cand_total, count(*) AS num_blocks FROM s", "drop_ratio", f"{x}::DOUBLE") for x in SHARES))
def sweep_drop_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    sa, sb, n = psig.signatures(a, S.SIGNATURES), psig.signatures(b, S.SIGNATURES), a.count()
    rows = [metrics.total_pairs(shared_blocks(*(frequency_filter(m, LOW, int(x * n)) for m in (sa, sb)))).select(F.lit(x).alias("drop_ratio"), "cand_total", "num_blocks") for x in SHARES]
    return reduce(DataFrame.unionByName, rows)


_SWEPT = with_("sweep AS (SELECT 'psig' AS \"Method\", * FROM (" + ORACLES["drop_ratio_metrics"] + "))")


@query(_SWEPT + 'SELECT "Method", round(avg(pc), 9) AS mean_pc, round(stddev_pop(pc), 9) AS std_pc FROM sweep GROUP BY "Method"')
def report_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_ratio_metrics(spark, sf_dir).withColumn("Method", F.lit("psig"))
    return reports.variance(rows).select("Method", F.round("mean_pc", 9).alias("mean_pc"), F.round("std_pc", 9).alias("std_pc"))


@query()
def report_scalability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured times of signature blocking over a quarter, half and all of the records."""
    a, b = parties.two_parties(spark, sf_dir)
    rows = []
    for quarters in (1, 2, 4):
        pa, pb = (p.filter(F.pmod(F.xxhash64("ent_id"), F.lit(4)) < quarters) for p in (a, b))
        method = psig.PSignature(S.SIGNATURES, LOW, int(SHARE * pa.count()))
        rows.append(experiments.run_experiment(spark, "psig", pa, pb, lambda m=method, p=pa: m.index(p), lambda m=method, p=pb: m.index(p)))
    return reports.scalability(reduce(DataFrame.unionByName, rows))


_RATIOS = tuple(round(0.01 + 0.01 * k / 19, 6) for k in range(20))
#: Two first letters, the first two letters of either word, and of the place.
_GUARANTEED = ("0,0:1,0", "0,0:0,1", "1,0:1,1", "2,0:2,1")


def _guaranteed(share: float) -> str:
    rows = with_(S.PARTIES, S.signed(_GUARANTEED, 0, S.share_of(share)), _PAIRS).rstrip()
    return f"""{rows}, scores AS ({S.assessment("pairs")}), sizes AS (SELECT block, count(*)::DOUBLE AS n FROM ka GROUP BY block), each_ AS (SELECT rec_id, count(*) AS q FROM ka GROUP BY rec_id)
       SELECT round(1.0::DOUBLE - (SELECT max(n) FROM sizes) / na, 9) AS "RG_MAX", round(1.0::DOUBLE - (SELECT avg(n) FROM sizes) / na, 9) AS "RG_AVG", round(1.0::DOUBLE - (SELECT min(n) FROM sizes) / na, 9) AS "RG_MIN",
       rr AS "RR", pc AS "PC", (SELECT max(q) FROM each_) AS "QG_MAX", round((SELECT avg(q) FROM each_), 9) AS "QG_AVG" FROM scores"""


@query(" UNION ALL ".join(_one_of(_guaranteed(x), '"MAX_RATIO"', f"{x}::DOUBLE") for x in _RATIOS))
def guarantee_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    members = [materialise(psig.signatures(p, _GUARANTEED), "members") for p in (a, b)]
    out = experiments.guarantee_sweep(a, b, *members, _RATIOS)
    return out.withColumns({c: F.round(c, 9) for c in ("RG_MAX", "RG_AVG", "RG_MIN", "QG_AVG")})


@query('SELECT round(corr("RG_AVG", "RR"), 6) AS correlation FROM (' + ORACLES["guarantee_sweep"] + ")")
def report_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.correlation(guarantee_sweep(spark, sf_dir), "RG_AVG", "RR").select(F.round("correlation", 6).alias("correlation"))


#: The signatures of which every one to four are tried together, and the shares of their limits.
_TRIED = ("1,0:1,1:0,0:0,1", "1,0:1,1:3,0:3,1:3,2:3,3", "1,0:1,1:2,0:2,1:2,2:3,0:3,1:3,2:3,3", "3,0:3,1:3,2:3,3", "1,0:1,1:2,*:3,*", "1,q3:3,q3")
_TRIED_HIGH, _TRIED_LOW = 0.015, 0.0002


def _tried_sql() -> str:
    grams = lambda c, i: f"unnest(CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3) || '_{i}') END)"
    rows = lambda t: " UNION ALL ".join([f"SELECT {k} AS sig, {S.signature(x)} AS block, rec_id FROM {t}" for k, x in enumerate(_TRIED[:5])] + [f"SELECT 5, {grams(f'a{i + 1}', i)}, rec_id FROM {t}" for i in (1, 3)])
    subsets = [c for n in range(1, 5) for c in combinations(range(6), n)]
    chosen = ", ".join(f"('{'|'.join(_TRIED[k] for k in c)}', {k})" for c in subsets for k in c)
    high, low = S.share_of(_TRIED_HIGH), f"greatest({S.share_of(_TRIED_LOW)}, 1)"
    kept = lambda t: f"SELECT * FROM (SELECT signatures, block, rec_id, count(*) OVER (PARTITION BY signatures, block) AS n FROM {t} JOIN chosen USING (sig)) WHERE n > {low} AND n <= {high}"
    size = lambda t: f"(SELECT signatures, min(n) AS min_{t}_size, quantile_cont(n, 0.5)::DOUBLE AS med_{t}_size, max(n) AS max_{t}_size, round(avg(n), 6) AS avg_{t}_size, round(stddev_pop(n), 6) AS std_{t}_size FROM (SELECT signatures, block, count(*) AS n FROM k{t} GROUP BY ALL) GROUP BY signatures)"
    each = lambda t: f"(SELECT signatures, min(n) AS min_{t}_bpr, max(n) AS max_{t}_bpr, round(avg(n), 6) AS avg_{t}_bpr FROM (SELECT signatures, rec_id, count(*) AS n FROM k{t} GROUP BY ALL) GROUP BY signatures)"
    return (
        with_(S.PARTIES, f"chosen(signatures, sig) AS (VALUES {chosen})", f"sa AS ({rows('alice')})", f"sb AS ({rows('bob')})", f"ka AS ({kept('sa')})", f"kb AS ({kept('sb')})").rstrip()
        + """, met AS (SELECT signatures, count(*) AS cand, count(*) FILTER (a = b) AS hit FROM (SELECT DISTINCT ka.signatures, ka.rec_id AS a, kb.rec_id AS b FROM ka JOIN kb ON ka.signatures = kb.signatures AND ka.block = kb.block) GROUP BY signatures),
       n AS (SELECT (SELECT count(*) FROM alice) AS na, (SELECT count(*) FROM bob) AS nb, (SELECT count(*) FROM alice JOIN bob USING (ent_id)) AS t)
       SELECT s.signatures, 1.0::DOUBLE - coalesce(cand, 0) / (na * nb) AS rr, CASE WHEN t > 0 THEN coalesce(hit, 0)::DOUBLE / t ELSE -1.0 END AS pc, CASE WHEN cand > 0 THEN hit::DOUBLE / cand ELSE -1.0 END AS pq,
       """
        + ", ".join(f"{m}_{t}_{x}" for x, ms in (("bpr", ("min", "max", "avg")), ("size", ("min", "med", "max", "avg", "std"))) for t in "ab" for m in ms)
        + " FROM (SELECT DISTINCT signatures FROM chosen) s CROSS JOIN n LEFT JOIN met USING (signatures) "
        + " ".join(f"LEFT JOIN {f(t)} USING (signatures)" for f in (size, each) for t in "ab")
    )


@query(_tried_sql())
def sig_subset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parties.two_parties(spark, sf_dir)
    n = a.count()
    return experiments.subset_sweep(a, b, _TRIED, 4, max(int(_TRIED_LOW * n), 1), int(_TRIED_HIGH * n))


@query(
    "SELECT 'hlsh' AS \"Method\", rr, pc, pq FROM (" + ORACLES["hlsh_metrics"] + ") UNION ALL SELECT 'knn', rr, pc, pq FROM (" + ORACLES["knn_metrics"]
    + ") UNION ALL SELECT 'psig', rr, pc, pq FROM (" + ORACLES["psig_metrics"] + ") UNION ALL SELECT 'snc2p', rr, pc, pq FROM (" + ORACLES["sn2p_metrics"] + ") UNION ALL SELECT 'snn_sim', rr, pc, pq FROM (" + ORACLES["sn3p_metrics"] + ")"
)
def method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"hlsh": hlsh_metrics, "knn": knn_metrics, "psig": psig_metrics, "snc2p": sn2p_metrics, "snn_sim": sn3p_metrics}
    rows = [f(spark, sf_dir).select(F.lit(n).alias("Method"), "rr", "pc", "pq") for n, f in parts.items()]
    return reduce(DataFrame.unionByName, rows)

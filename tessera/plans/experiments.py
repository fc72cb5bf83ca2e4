"""Experiments: index two parties, match, assess, and one result row of the known columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hlsh, metrics, multiparty, psig
from tessera.operators.blocks import candidate_pairs
from tessera.session import materialise
from tessera.sources.parties import ATTRIBUTES
from tessera.sources.sinks import block_lines, result_row

Pairs = Callable[[DataFrame, DataFrame], DataFrame]


def run_experiment(
    spark: SparkSession, name: str, a: DataFrame, b: DataFrame, index_a: Callable[[], DataFrame], index_b: Callable[[], DataFrame], pairs: Pairs = candidate_pairs, k: int | None = None, num_ref_val: int | None = None
) -> DataFrame:
    """Index, match and assessment of a method, each timed; the result row."""
    began = time.perf_counter()
    ma, mb = materialise(index_a(), "index"), materialise(index_b(), "index")
    indexed = time.perf_counter()
    found = materialise(pairs(ma, mb), "pairs")
    matched = time.perf_counter()
    scores = metrics.assess(a, b, found).first().asDict()
    out: dict[str, object] = {"Method": name, "K": k, "num_ref_val": num_ref_val, "alice_num_recs": scores["na"], "bob_num_recs": scores["nb"], "num_cand_rec_pairs": scores["cand"]}
    out |= {c: scores[c] for c in ("rr", "pc", "pq")}
    for side, members in (("a", ma), ("b", mb)):
        stats = metrics.block_stats(members).first().asDict()
        out |= {f"{side}_{c}": v for c, v in stats.items() if c != "num_blocks"}
        out.setdefault("num_blocks", stats["num_blocks"])
    ended = time.perf_counter()
    out |= {"dbo_time": indexed - began, "lu_time": matched - indexed, "assess_time": ended - matched, "tot_time": ended - began}
    return result_row(spark, out)


def guarantee_sweep(a: DataFrame, b: DataFrame, ma: DataFrame, mb: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """What blocks of at most each share of Alice's records guarantee, and what they reach.

    MAX_RATIO, RG_MAX, RG_AVG, RG_MIN, RR, PC, QG_MAX, QG_AVG.
    """
    n = a.count()
    limits = [int(x * n) for x in ratios]
    reached = metrics.assess_limits(a, b, ma, mb, 0, limits).select("k", "rr", "pc")
    # the ratios are a list in the code, hence the broadcasts
    shares = F.broadcast(a.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(ratios)], "k int, MAX_RATIO double"))
    both = reached.join(F.broadcast(metrics.guarantees_by_limit(ma, n, limits)), "k").join(shares, "k")
    return both.select("MAX_RATIO", *[F.col(c).alias(c.upper()) for c in ("rg_max", "rg_avg", "rg_min", "rr", "pc", "qg_max", "qg_avg")])


def subset_sweep(a: DataFrame, b: DataFrame, specs: Sequence[str], most: int, low: int, high: int) -> DataFrame:
    """A row for each choice of one to ``most`` signatures: signatures, rr, pc, pq, blocks per record and block
    sizes of both parties (21 columns).

    All choices go through one plan. Neither memberships are repeated for a choice nor pairs made: records
    with the same blocks are a class, and a number holds in bits the choices in which a block stays.
    """
    choices = [c for n in range(1, most + 1) for c in combinations(range(len(specs)), n)]
    ma, mb = (materialise(reduce(DataFrame.unionByName, [psig.signatures(p, [spec]).select(F.lit(k).alias("sig"), "block", "rec_id") for k, spec in enumerate(specs)]), "members") for p in (a, b))
    na, nb, true = a.count(), b.count(), metrics.true_matches(a, b).first()["true_total"]
    # a choice is a bit of a number
    parts = [_subsets(a, b, ma, mb, ["|".join(specs[k] for k in c) for c in choices[at : at + 60]], choices[at : at + 60], low, high) for at in range(0, len(choices), 60)]
    out = reduce(DataFrame.unionByName, parts)
    rr = F.lit(1.0) - F.col("cand") / F.lit(float(na * nb)) if na * nb else F.lit(-1.0)
    pc = F.col("hit") / F.lit(float(true)) if true else F.lit(-1.0)
    pq = F.when(F.col("cand") > 0, F.col("hit") / F.col("cand")).otherwise(F.lit(-1.0))
    measured = [f"{n}_{side}_{kind}" for kind in ("bpr", "size") for side in "ab" for n in _MEASURES[kind].values()]
    return out.select("signatures", rr.alias("rr"), pc.alias("pc"), pq.alias("pq"), *measured)


_MEASURES = {"size": {"min_blk": "min", "med_blk": "med", "max_blk": "max", "avg_blk": "avg", "std_dev": "std"}, "bpr": {"min_bpr": "min", "max_bpr": "max", "avg_bpr": "avg"}}


def _subsets(a: DataFrame, b: DataFrame, ma: DataFrame, mb: DataFrame, names: Sequence[str], choices: Sequence[Sequence[int]], low: int, high: int) -> DataFrame:
    """signatures, cand, hit and the measures of choices of signatures, each a bit of a mask."""
    spark = a.sparkSession
    # the choices are a list in the code, hence the broadcasts
    chosen = F.broadcast(spark.createDataFrame([(c, 1 << c, k) for c, ks in enumerate(choices) for k in ks], "choice int, bit long, sig int"))
    out = spark.createDataFrame(list(enumerate(names)), "choice int, signatures string")
    bits = F.broadcast(spark.createDataFrame([(c, 1 << c) for c in range(len(choices))], "choice int, bit long"))
    has = lambda mask: mask.bitwiseAND(F.col("bit")) != 0
    masks = {}
    for side, m in (("a", ma), ("b", mb)):
        sizes = materialise(m.groupBy("sig", "block").agg(F.count(F.lit(1)).alias("n")), "sizes")
        each = sizes.join(chosen, "sig")
        kept = materialise(each.groupBy("choice", "block").agg(F.sum("n").alias("n")).filter((F.col("n") > low) & (F.col("n") <= high)), "kept")
        masked = each.drop("n").join(kept.select("choice", "block"), ["choice", "block"], "left_semi")
        masks[side] = materialise(masked.groupBy("sig", "block").agg(F.bit_or("bit").alias("mask")), "masks")
        # records whose memberships stay in the same choices are one row
        held = m.join(masks[side], ["sig", "block"]).groupBy("rec_id").agg(F.sort_array(F.collect_list("mask")).alias("masks")).groupBy("masks").agg(F.count(F.lit(1)).alias("records"))
        held = materialise(held, "held").crossJoin(bits).select("choice", "records", F.size(F.filter("masks", has)).alias("q")).filter("q > 0")
        bpr = held.groupBy("choice").agg(F.min("q").cast("long").alias("min_bpr"), F.max("q").cast("long").alias("max_bpr"), (F.sum(F.col("q") * F.col("records")) / F.sum("records")).alias("avg_bpr"))
        for kind, measured in (("size", metrics.size_stats(kept, "choice")), ("bpr", bpr)):
            cells = [(F.round(c, 6) if n in ("avg", "std") else F.col(c)).alias(f"{n}_{side}_{kind}") for c, n in _MEASURES[kind].items()]
            out = out.join(measured.select("choice", *cells), "choice", "left")
    # a block of one name may come from several signatures: each two of them are a block of their own
    shared = masks["a"].select("block", F.col("sig").alias("sa"), F.col("mask").alias("x")).join(masks["b"].select("block", F.col("sig").alias("sb"), "mask"), "block")
    shared = materialise(shared.withColumn("mask", F.col("mask").bitwiseAND(F.col("x"))).filter("mask <> 0").select("block", "sa", "sb", "mask"), "met")
    of = sorted(r["mask"] for r in shared.select("mask").distinct().collect())
    places = F.broadcast(spark.createDataFrame(list(zip(of, range(len(of)), strict=True)), "mask long, place int"))
    shared = metrics.numbered(shared.join(places, "mask"), "place")
    sa, sb = (metrics.block_sets(p, m.withColumnRenamed("sig", s), shared, ["block", s]) for p, m, s in ((a, ma, "sa"), (b, mb, "sb")))
    literals = F.array(*[F.lit(x).cast("long") for x in of]) if of else F.array().cast("array<bigint>")
    either = lambda codes: F.aggregate(codes, F.lit(0).cast("long"), lambda x, c: x.bitwiseOR(F.get(literals, metrics.kind_of(c))))
    for found, n, name in ((metrics.met_pairs(sa, sb, either(F.array_intersect("ca", "cb")), True), "cand", "cand"), (metrics.met_matches(sa, sb, either(F.col("codes"))), "true_cand", "hit")):
        counted = materialise(found, "met").crossJoin(bits).filter(has(F.col("kind"))).groupBy("choice").agg(F.sum(n).alias(name))
        out = out.join(counted, "choice", "left")
    return out.na.fill(0, ["cand", "hit"]).drop("choice")


def from_config(config: Mapping[str, object]):
    """A blocking method out of a configuration ``{type, config}``: p-sig or lambda-fold.

    Of lambda-fold, what the configuration leaves out has the class's default; features are names or
    positions from 1; with ``input-clks`` the parties bring their set bits in a column ``clk``.
    """
    kind, c = config["type"], config["config"]
    if kind == "p-sig":
        return psig.ConfiguredSignature(c)
    if kind == "lambda-fold":
        features, made = c.get("blocking-features", ()), hlsh.LambdaFoldLsh(())
        made.attributes = tuple(f if isinstance(f, str) else ATTRIBUTES[f - 1] for f in features)
        for name, key in (("folds", "Lambda"), ("bits", "K"), ("length", "bf-len"), ("hashes", "num-hash-funcs"), ("seed", "random_state")):
            setattr(made, name, c.get(key, getattr(made, name)))
        made.clks = "clk" if c.get("input-clks") else None
        return made
    raise ValueError(f"unknown blocking type {kind}")


def run_many_parties(spark: SparkSession, records: DataFrame, members: DataFrame, ks: tuple[int, ...]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(k, NUMBER_OF_COMPARISON, RR, SC, TOTAL_TIME) for each least number of parties, and the saved lines of blocks."""
    rows, lines = None, {}
    for k in ks:
        began = time.perf_counter()
        held = materialise(multiparty.blocks_of_at_least(members, k), "held")
        took = time.perf_counter() - began
        lines[k] = block_lines(held)
        row = metrics.side_by_side(multiparty.reduction(records, held, k), multiparty.set_completeness(records, held, k))
        row = row.select(F.lit(k).alias("k"), F.col("comparisons").alias("NUMBER_OF_COMPARISON"), F.col("rr").alias("RR"), F.col("sc").alias("SC"), F.lit(took).alias("TOTAL_TIME"))
        rows = row if rows is None else rows.unionByName(row)
    return rows, lines

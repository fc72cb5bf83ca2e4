"""Pairs counted by classes, nearest values by blocks and average linkage without a matrix, against plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering, metrics
from tessera.operators.blocks import candidate_pairs, frequency_filter


def some_parties(spark, seed):
    rng = random.Random(seed)
    party = lambda first: spark.createDataFrame([(f"{first}{k}", f"e{rng.randrange(30)}") for k in range(60)], "rec_id string, ent_id string")
    # few records stand in blocks, repeats are there, and many have the same blocks
    members = lambda first: spark.createDataFrame([(f"b{rng.randrange(12)}", f"{first}{rng.randrange(50)}") for _ in range(90)], "block string, rec_id string")
    return party("a"), party("b"), members("a"), members("b")


@pytest.mark.parametrize("seed", range(2))
def test_assessment_without_pairs(spark, seed):
    a, b, ma, mb = some_parties(spark, seed)
    assert metrics.assess_blocks(a, b, ma, mb).first() == metrics.assess(a, b, candidate_pairs(ma, mb)).first()
    none = ma.filter("block = ''")
    assert metrics.assess_blocks(a, b, none, mb).first() == metrics.assess(a, b, candidate_pairs(none, mb)).first()


def test_limits_in_one_plan(spark):
    a, b, ma, mb = some_parties(spark, 7)
    limits = [7, 3, 9, 0, 9]
    got = {r["k"]: r for r in metrics.assess_limits(a, b, ma, mb, 1, limits).collect()}
    held = {r["k"]: r for r in metrics.guarantees_by_limit(ma, 60, limits).collect()}
    for k, x in enumerate(limits):
        ka, kb = (frequency_filter(m, 1, x) for m in (ma, mb))
        assert got[k].asDict() == {"k": k} | metrics.assess(a, b, candidate_pairs(ka, kb)).first().asDict()
        expected = metrics.guarantees(frequency_filter(ma, 0, x), 60).first().asDict()
        assert {c: held[k][c] for c in expected} == pytest.approx(expected)


def test_a_common_name_costs_one_class(spark):
    """Ten thousand millions of pairs of one block."""
    a, b = (spark.range(100_000).select(F.concat(F.lit(x), F.col("id")).alias("rec_id"), F.col("id").cast("string").alias("ent_id")) for x in "ab")
    ma, mb = (p.select(F.lit("x").alias("block"), "rec_id") for p in (a, b))
    row = metrics.assess_blocks(a, b, ma, mb).first()
    assert (row["cand"], row["true_cand"], row["rr"], row["pc"]) == (10**10, 100_000, 0.0, 1.0)


def test_nearest_values_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "KEYS", 7)
    monkeypatch.setattr(clustering, "VALUES", 5)
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(6)))
    values = list(dict.fromkeys(name() for _ in range(25)))
    refs = [(k, k % 4, v) for k, v in enumerate(values)]
    keys = [*dict.fromkeys([*(name() for _ in range(40)), "zz"])]
    found = clustering.assign_nearest(spark.createDataFrame([(k,) for k in keys * 2], "key string"), spark.createDataFrame(refs, "pos int, cluster int, ref string"), -5)
    got = {r["key"]: (r["cluster"], r["sim"]) for r in found.collect()}
    for key in keys:
        sim, cluster, _ = max((round(clustering.dice_python(key, v), 12), -c, -k) for k, c, v in refs)
        assert got[key] == pytest.approx((-cluster, sim) if sim else (-5, 0.0))
    assert len(got) == len(keys)


def test_predecessors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "VALUES", 6)
    rng = random.Random(4)
    values = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(40)))
    expected = set()
    for k, v in enumerate(values):
        sims = [clustering.dice_python(v, x) for x in values[:k]]
        expected |= {(k, to) for to, x in enumerate(sims) if x >= 0.5 and x == max(sims)}
    found = clustering.similar_predecessors(spark.createDataFrame(list(enumerate(values)), "pos int, ref string"), 0.5)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_average_linkage_of_many_values():
    rng = random.Random(1)
    values = list(dict.fromkeys("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6100)))
    values[5], values[4000] = "thewhole", "thewholes"
    found = clustering.average_linkage(values, len(values) - 1)
    assert found[len(values)] == ["thewhole", "thewholes"] and len(found) == len(values) - 1

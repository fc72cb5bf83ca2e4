"""Connected components of an undirected graph, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise, scratch


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "w")).alias("x")).first()
    return row["n"], row["x"] or 0


def _written(low: DataFrame) -> DataFrame:
    """A row per node, written first: joined straight from its aggregation it would pin all edges of
    a node to one task, while two plain shuffles let adaptive execution split a hub's edges."""
    return materialise(low, "cc-low")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select("v", "w").unionByName(edges.select(F.col("w").alias("v"), F.col("v").alias("w")))
    low = _written(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m")))
    return both.filter("w > v").join(low, "v").select(F.col("w").alias("v"), F.col("m").alias("w"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours to the smallest of them. Edges run from v down to w."""
    low = _written(edges.groupBy("v").agg(F.min("w").alias("m")))
    moved = edges.join(low, "v").filter("w > m").select(F.col("w").alias("v"), F.col("m").alias("w"))
    return moved.unionByName(low.select("v", F.col("m").alias("w"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Self loops, repeated edges and either direction are allowed; null ends are ignored. Each round
    only passes minima along the edges, and is written to the shared folder.
    """
    e = (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
        .distinct()
    )
    e = materialise(e, "cc")
    before = _fingerprint(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        with scratch(e.sparkSession):
            e = materialise(_small_star(_large_star(e).distinct()), "cc", outlives=True)
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected_components did not settle")
    roots = e.select(F.col("w").alias("node"), F.col("w").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("w").alias("component")).unionByName(roots)

"""Blocking by clusters of reference values: nearest-neighbour and average-linkage clustering.

Nearest-neighbour clusters are formed in Spark; average linkage on the driver, without a matrix.
Records are assigned through shared q-grams, counted block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.registry import similarity
from tessera.functions.strings import FIRST_PAD, LAST_PAD, laplace_location, qgrams
from tessera.operators.blocks import shared_blocks
from tessera.session import materialise

#: Most values for average linkage by a similarity of one's own: a matrix of 288 MB.
MOST_VALUES = 6000
#: So many values and keys meet in one task when keys are assigned.
VALUES, KEYS = 8192, 20_000


def dice_python(a: str, b: str) -> float:
    """Dice over padded bigrams, as ``functions.strings.dice``."""
    if a == b:
        return 1.0
    ga, gb = ([p[i : i + 2] for i in range(len(p) - 1)] for p in (FIRST_PAD + s + LAST_PAD for s in (a, b)))
    return 2.0 * len(set(ga) & set(gb)) / (len(ga) + len(gb))


def nearest_neighbour_clusters(values: Sequence[str], threshold: float, sim: Callable[[str, str], float] = dice_python, strict: bool = False) -> list[list[str]]:
    """Each value joins the cluster of its most similar predecessor, if that is similar enough.

    ``strict`` tests the similarity to the last predecessor instead of the best.
    """
    clusters: list[list[str]] = []
    for v in values:
        best, at, s = 0.0, -1, 0.0
        for c, members in enumerate(clusters):
            for m in members:
                s = sim(v, m)
                if s > best:
                    best, at = s, c
        if clusters and (s if strict else best) >= threshold and (at >= 0 or strict):
            clusters[at].append(v)
        else:
            clusters.append([v])
    return clusters


class GramIndex:
    """Lists of the values that hold each bigram: Dice of one value to all others, without a matrix."""

    def __init__(self, values: Sequence[str]) -> None:
        holders: dict[str, list[int]] = {}
        same: dict[str, list[int]] = {}
        for i, v in enumerate(values):
            same.setdefault(v, []).append(i)
            for g in self._grams(v):
                holders.setdefault(g, []).append(i)
        self.values, self.same = values, same
        self.holders = {g: np.array(at, np.intp) for g, at in holders.items()}
        self.size = np.array([len(v) + 1 for v in values], dtype=float)

    @staticmethod
    def _grams(value: str) -> set[str]:
        padded = FIRST_PAD + value + LAST_PAD
        return {padded[i : i + 2] for i in range(len(padded) - 1)}

    def similar(self, value: str) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places of the values that share a gram with ``value``, and their similarities."""
        found = [self.holders[g] for g in self._grams(value) if g in self.holders]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.bincount(np.concatenate(found))
        at = np.flatnonzero(both)
        sim = 2.0 * both[at] / (self.size[at] + (len(value) + 1))
        if value in self.same:
            sim[np.searchsorted(at, self.same[value])] = 1.0
        return at, sim


def average_linkage(values: Sequence[str], clusters: int, sim: Callable[[str, str], float] | None = None, most: int | None = None) -> dict[int, list[str]]:
    """Merges the two clusters of highest mean similarity (by default Dice, to nine places) until ``clusters`` are left.

    Ties go to the first pair; if nothing is similar the first two live clusters merge. A merged
    cluster gets a new, higher number. Each cluster remembers its best partner among the later ones,
    so a merge costs a few rows of similarities. By Dice a row is made when it is looked at, and what
    is held follows the number of values; of another similarity a matrix is held, and more than
    ``MOST_VALUES`` are refused, as are more than ``most`` of either.
    """
    n = len(values)
    if n > (most if most is not None else n if sim is None else MOST_VALUES):
        raise ValueError(f"{n} values; at most {most or MOST_VALUES} are clustered in one place")
    if sim is None:
        index = GramIndex(values)
        row_of = lambda v: index.similar(values[v])
    else:
        matrix = np.array([[sim(x, y) for y in values] for x in values], dtype=float).reshape(n, n)
        row_of = lambda v: (at := np.flatnonzero(matrix[v]), matrix[v, at])
    held = [[i] for i in range(n)]
    ids, size, live, slot = np.arange(n), np.ones(n), np.ones(n, bool), np.arange(n)
    best, partner = np.zeros(n), np.full(n, -1)

    def means(s: int) -> tuple[np.ndarray, np.ndarray]:
        """The clusters that are somewhat like the one at ``s``, and how much, not yet rounded."""
        rows = [row_of(v) for v in held[s]]
        total = np.bincount(slot[np.concatenate([at for at, _ in rows])], np.concatenate([x for _, x in rows]))
        at = np.flatnonzero(total)
        return at, total[at] / (size[s] * size[at])

    def look(s: int) -> None:
        at, mean = means(s)
        later = ids[at] > ids[s]
        at, mean = at[later], mean[later]
        best[s], partner[s] = 0.0, -1
        if len(at):
            # rounding is slow, so only what can be the most is rounded
            near = mean > mean.max() - 2e-9
            at, mean = at[near], np.round(mean[near], 9)
            top = at[mean == mean.max()]
            best[s], partner[s] = mean.max(), top[ids[top].argmin()]

    for s in range(n):
        look(s)
    for new in range(n, n + n - max(1, clusters)):
        slots = np.flatnonzero(live)
        top = slots[best[slots] == best[slots].max()]
        a = int(top[ids[top].argmin()])
        b = int(partner[a])
        if best[a] <= 0:
            first = slots[np.argpartition(ids[slots], 1)[:2]]
            a, b = (int(x) for x in first[ids[first].argsort()])
        held[a], held[b] = held[a] + held[b], []
        slot[held[a]] = a
        size[a] += size[b]
        live[b] = False
        ids[a] = new
        # nothing is later than the new cluster
        best[a], partner[a] = 0.0, -1
        for s in np.flatnonzero(live & ((partner == a) | (partner == b))):
            look(int(s))
        at, mean = means(a)
        near = (at != a) & (mean > best[at] - 2e-9)
        at, mean = at[near], np.round(mean[near], 9)
        better = mean > best[at]
        best[at[better]], partner[at[better]] = mean[better], a
    return {int(ids[s]): [values[v] for v in held[s]] for s in sorted(np.flatnonzero(live), key=lambda s: ids[s])}


def clusters_frame(spark: SparkSession, clusters: dict[int, list[str]]) -> DataFrame:
    """(pos, cluster, ref) in the order in which values are compared."""
    rows = [(c, v) for c, members in clusters.items() for v in members]
    return spark.createDataFrame([(k, int(c), v) for k, (c, v) in enumerate(rows)], "pos int, cluster int, ref string")


def similar_predecessors(refs: DataFrame, threshold: float) -> DataFrame:
    """(pos, to): the values before each that are most similar to it by Dice, if that is ``threshold`` or more.

    Values are dealt into blocks and each two blocks meet once; of a block only the most similar are handed on.
    """

    def best(values: pa.Table, before: pa.Table) -> pa.Table:
        index, places, out = GramIndex(before["ref"].to_pylist()), before["pos"].to_numpy(), []
        for pos, ref in zip(values["pos"].to_pylist(), values["ref"].to_pylist(), strict=True):
            at, sim = index.similar(ref)
            near = (sim >= threshold) & (places[at] < pos)
            at, sim = places[at[near]], sim[near]
            if len(at):
                out += [(pos, to, sim.max()) for to in at[sim == sim.max()].tolist()]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["pos", "to", "sim"])

    refs = refs.select(F.col("pos").cast("int").alias("pos"), "ref").filter("ref is not null")
    blocks = F.lit(max(1, -(-refs.count() // VALUES)))
    own, every = F.pmod(F.xxhash64("ref"), blocks), F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))
    left = refs.select("pos", "ref", own.alias("row"), every.alias("column")).groupBy("row", "column")
    right = refs.select("pos", "ref", every.alias("row"), own.alias("column")).groupBy("row", "column")
    met = materialise(left.cogroup(right).applyInArrow(best, "pos int, to int, sim double"), "predecessors")
    most = met.groupBy("pos").agg(F.max("sim").alias("sim"))
    return met.join(most, ["pos", "sim"]).select("pos", "to")


def nearest_neighbour_frame(refs: DataFrame, threshold: float) -> DataFrame:
    """``nearest_neighbour_clusters`` over (pos, ref) in Spark, as (pos, cluster, ref); a cluster is named
    by the position of its first value.

    A value joins the oldest of the clusters where its most similar predecessors are, so its cluster
    is the least first value that pointers reach; minima are passed on until none moves.
    """
    refs = materialise(refs.select("pos", "ref"), "values")
    to = materialise(similar_predecessors(refs, threshold), "pointers")
    least = refs.join(to.select("pos").distinct(), "pos", "left_anti").select("pos", F.col("pos").alias("cluster"))
    known = materialise(least, "firsts")
    while True:
        # the pointers of a value lead back, so every round settles at least the next values in line
        open_ = to.join(known.select(F.col("pos")), "pos", "left_anti")
        met = open_.join(known.select(F.col("pos").alias("to"), "cluster"), "to", "left")
        ready = met.groupBy("pos").agg(F.min("cluster").alias("cluster"), F.count_if(F.col("cluster").isNull()).alias("waiting")).filter("waiting = 0")
        more = materialise(ready.select("pos", "cluster"), "clusters")
        if more.isEmpty():
            break
        known = materialise(known.unionByName(more), "clusters")
    return refs.join(known, "pos").select("pos", "cluster", "ref")


def medoids(clusters: DataFrame, name: str = "dice") -> DataFrame:
    """(pos, cluster, ref): the member with the highest sum of similarities; ties go to the largest value.

    By Dice the sums come from counts of each gram and length in a cluster; no pairs are made.
    """
    if name == "dice":
        grams = clusters.select("cluster", F.col("ref").alias("x"), "pos", qgrams(F.col("ref")).alias("g")).withColumn("size", F.size("g"))
        each = grams.select("cluster", "x", "pos", "size", F.size(F.array_distinct("g")).alias("own"), F.explode(F.array_distinct("g")).alias("gram"))
        held = each.groupBy("cluster", "gram", F.col("size").alias("length")).agg(F.count(F.lit(1)).alias("n"))
        met = each.join(held, ["cluster", "gram"]).groupBy("cluster", "x", "pos", "size", "own").agg(F.sum(F.lit(2.0) * F.col("n") / (F.col("size") + F.col("length"))).alias("s"))
        sums = met.select("cluster", "x", "pos", F.round(F.col("s") - F.col("own") / F.col("size"), 9).alias("s"))
    else:
        sim = similarity(name)
        a, b = clusters.select("cluster", F.col("ref").alias("x"), "pos"), clusters.select("cluster", F.col("ref").alias("y"))
        sums = a.join(b, "cluster").groupBy("cluster", "x", "pos").agg(F.round(F.sum(sim(F.col("x"), F.col("y"))) - 1, 9).alias("s"))
    return sums.groupBy("cluster").agg(F.max(F.struct("s", "x")).alias("m"), F.min("pos").alias("pos")).select("pos", "cluster", F.col("m.x").alias("ref"))


def _nearest(keys: pa.Table, refs: pa.Table) -> pa.Table:
    """(key, cluster, pos, sim): for each key the first of the values here that are most similar to it."""
    refs = refs.sort_by([("cluster", "ascending"), ("pos", "ascending")])
    index, out = GramIndex(refs["ref"].to_pylist()), []
    for key in keys["key"].to_pylist():
        at, sim = index.similar(key)
        if len(at):
            k = np.round(sim, 12).argmax()
            out.append((key, at[k], sim[k]))
    at = pa.array([x[1] for x in out], pa.int64())
    columns = [pa.array([x[0] for x in out], pa.string()), refs["cluster"].take(at).cast(pa.int64()), refs["pos"].take(at).cast(pa.int64()), pa.array([x[2] for x in out], pa.float64())]
    return pa.table(columns, names=["key", "cluster", "pos", "sim"])


def assign_nearest(keys: DataFrame, refs: DataFrame, nobody: int = -1) -> DataFrame:
    """(key, cluster, sim): for each distinct key the first of the most similar values, by Dice; the values
    stand in the order of their clusters, and in a cluster in that of their positions.

    Only values that share a q-gram have a similarity above 0; a key without any goes to ``nobody``.
    Keys and values are dealt into blocks, and each block of keys meets each of values once: what a
    key shares with a value is counted there, so that no row is made for a pair. Written.
    """
    keys = materialise(keys.select("key").distinct().filter("key is not null"), "keys")
    refs = refs.select("pos", "cluster", "ref").filter("ref is not null")
    rows, columns = (F.lit(max(1, -(-x.count() // most))) for x, most in ((keys, KEYS), (refs, VALUES)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    left = keys.select("key", dealt("key", rows).alias("row"), every(columns).alias("column")).groupBy("row", "column")
    right = refs.select("pos", "cluster", "ref", every(rows).alias("row"), dealt("ref", columns).alias("column")).groupBy("row", "column")
    met = left.cogroup(right).applyInArrow(_nearest, "key string, cluster long, pos long, sim double")
    best = met.groupBy("key").agg(F.max_by(F.struct("cluster", "sim"), F.struct(F.round("sim", 12), -F.col("cluster"), -F.col("pos"))).alias("m"))
    # the cluster keeps the type it has among the values
    kind = refs.schema["cluster"].dataType
    out = keys.join(best, "key", "left").select("key", F.coalesce(F.col("m.cluster").cast(kind), F.lit(nobody)).alias("cluster"), F.coalesce("m.sim", F.lit(0.0)).alias("sim"))
    return materialise(out, "nearest")


@dataclass
class NearestNeighbour:
    """k-anonymous nearest-neighbour blocking; records like no value stand in block -1."""

    refs: DataFrame
    k: int

    def index(self, party_keys: DataFrame) -> DataFrame:
        return party_keys.join(assign_nearest(party_keys, self.refs), "key").select(F.col("cluster").alias("block"), "rec_id")

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return shared_blocks(a, b, self.k)


@dataclass
class HierarchicalClustering:
    """Average-linkage clusters, padded with fakes drawn from Laplace noise; fakes never match."""

    refs: DataFrame
    weight: float = 10.0
    epsilon: float = 0.3
    seed: int = 7

    def index(self, party_keys: DataFrame) -> DataFrame:
        first = self.refs.agg(F.min("cluster")).first()[0]
        return party_keys.join(assign_nearest(party_keys, self.refs, first), "key").select(F.col("cluster").alias("block"), "rec_id", F.lit(False).alias("fake"))

    def noise(self, members: DataFrame) -> DataFrame:
        """(block, fakes): noise from an md5 of the seed and the block, so that it can be repeated."""
        sizes = self.refs.select(F.col("cluster").alias("block")).distinct().join(members.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block", "left").na.fill(0, ["n"])
        mean = sizes.agg(F.avg("n").alias("mean")).withColumn("_k", F.lit(1))
        digits = F.substring(F.md5(F.concat(F.lit(f"{self.seed}:"), F.col("block").cast("string"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52) - 0.5
        scale = 2.0 / self.epsilon
        drawn = laplace_location(F.col("mean"), self.weight, self.epsilon) - F.lit(scale) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))
        return sizes.withColumn("_k", F.lit(1)).join(mean, "_k").select("block", F.greatest(drawn.cast("int"), F.lit(0)).alias("fakes"))

    def padded(self, members: DataFrame) -> DataFrame:
        made = self.noise(members).filter("fakes > 0").select("block", F.explode(F.sequence(F.lit(1), "fakes")).alias("i"))
        return members.unionByName(made.select("block", F.lit("fake").alias("rec_id"), F.lit(True).alias("fake")))

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """(block, na, nb) of every cluster of A's side, empty ones too."""
        all_ = self.refs.select(F.col("cluster").alias("block")).distinct()
        na, nb = (m.filter("not fake").groupBy("block").agg(F.count(F.lit(1)).alias(n)) for m, n in ((a, "na"), (b, "nb")))
        return all_.join(na, "block", "left").join(nb, "block", "left").na.fill(0, ["na", "nb"])

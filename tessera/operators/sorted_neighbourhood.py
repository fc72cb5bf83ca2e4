"""Blocking by sorted reference values: as-of assignment, merged ranges, and windows over two parties.

Reference values have indexes from 1 in code-point order; index 0 stands before all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.registry import similarity
from tessera.functions.strings import FIRST_PAD, common_prefix_similarity
from tessera.operators.blocks import linked_pairs
from tessera.operators.ranking import in_ranges, ranked
from tessera.session import materialise


def reference_index(refs: DataFrame) -> DataFrame:
    """(idx, ref) of ``refs(ref)``, with the sentinel at 0."""
    rows = ranked(refs.select("ref").distinct(), ["ref"], "idx").select(F.col("idx").cast("int").alias("idx"), "ref")
    return rows.unionByName(rows.sparkSession.range(1).select(F.lit(0).alias("idx"), F.lit(FIRST_PAD).alias("ref")))


def assign(keys: DataFrame, index: DataFrame, partitions: int | None = None) -> DataFrame:
    """(key, idx): for each distinct key the largest reference value that isn't above it.

    Keys and values are sorted together in ranges; what is carried into a range is the largest index
    of the ranges before it.
    """
    sweep = index.select(F.col("ref").alias("key"), "idx").unionByName(keys.select("key").distinct().select("key", F.lit(None).cast("int").alias("idx")))
    parts = in_ranges(sweep, ["key"], partitions)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy("_part").agg(F.max("idx").alias("idx")).select("_part", F.max("idx").over(earlier).alias("carried"))
    order = Window.partitionBy("_part").orderBy("key", F.col("idx").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    # a row per range, hence the broadcast
    swept = parts.join(F.broadcast(carried), "_part").withColumn("at", F.last("idx", True).over(order))
    return swept.filter("idx is null").select("key", F.coalesce("at", "carried", F.lit(0)).alias("idx"))


def _beside(index: DataFrame, step: int, name: str) -> DataFrame:
    """The index with the value ``step`` places further as ``name``."""
    return index.join(index.select((F.col("idx") - step).alias("idx"), F.col("ref").alias(name)), "idx", "left")


def index_sizes(at: DataFrame, index: DataFrame, similarity_name: str = "dice") -> DataFrame:
    """(idx, ref, n, sim): records of ``at(rec_id, idx)`` per reference value, and its similarity to the one before."""
    sized = at.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    near = common_prefix_similarity(F.col("before"), F.col("ref"), similarity(similarity_name))
    rows = _beside(index, -1, "before").withColumn("sim", F.when(F.col("before").isNull(), F.lit(0.0)).otherwise(near))
    return rows.join(sized, "idx", "left").select("idx", "ref", F.coalesce("n", F.lit(0)).alias("n"), "sim")


def next_similarity(index: DataFrame, similarity_name: str = "dice") -> DataFrame:
    """(idx, sim): the similarity of each value's prefix to the next value's."""
    near = common_prefix_similarity(F.col("ref"), F.col("after"), similarity(similarity_name))
    return _beside(index, 1, "after").filter("after is not null").select("idx", near.alias("sim"))


def fold_by_similarity(rows: Iterable[tuple[int, int, float]], k: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """Ranges (lo, hi, n) of (idx, n, sim to the one before) in order.

    A value joins the current range while that has at most ``k`` records or is similar enough; a last
    range of fewer than ``k`` joins the one before it.
    """
    before = here = None
    for idx, n, sim in rows:
        if here is None:
            here = [idx, idx, n]
        elif here[2] <= k or sim >= threshold:
            here[1], here[2] = idx, here[2] + n
        else:
            if before:
                yield tuple(before)
            before, here = here, [idx, idx, n]
    if here is None:
        return
    if before and here[2] < k:
        before[1], before[2] = here[1], before[2] + here[2]
        here = None
    if before:
        yield tuple(before)
    if here:
        yield tuple(here)


def fold_by_size(sizes: Sequence[int], k: int) -> list[tuple[int, int, int]]:
    """Ranges (lo, hi, n) over positions: the smallest range under ``k`` joins its smaller neighbour.

    The neighbour before must be strictly smaller to be chosen. Equal sizes are taken in the order
    in which ranges came to be.
    """
    n = len(sizes)
    lo, hi, size = list(range(n)), list(range(n)), list(sizes)
    left, right = [i - 1 for i in range(n)], [i + 1 if i + 1 < n else -1 for i in range(n)]
    stamp, alive, clock = list(range(n)), [True] * n, n
    heap = [(size[i], i, i) for i in range(n)]
    heapq.heapify(heap)
    count = n
    while heap and count > 1:
        s, t, i = heapq.heappop(heap)
        if not alive[i] or stamp[i] != t:
            continue
        if s >= k:
            break
        p, q = left[i], right[i]
        into = q if p < 0 else p if q < 0 else p if size[p] < size[q] else q
        lo[into], hi[into], size[into] = min(lo[into], lo[i]), max(hi[into], hi[i]), size[into] + size[i]
        if into == p:
            right[p] = q
            if q >= 0:
                left[q] = p
        else:
            left[q] = p
            if p >= 0:
                right[p] = q
        alive[i] = False
        stamp[into] = clock
        heapq.heappush(heap, (size[into], clock, into))
        clock += 1
        count -= 1
    return sorted((lo[i], hi[i], size[i]) for i in range(n) if alive[i])


def fold_in_stretches(sizes: Iterable[int], k: int) -> Iterator[tuple[int, int, int]]:
    """``fold_by_size`` over a stream.

    Two neighbours of ``k`` or more never merge, and neither side of them sees the other: there the
    stream is cut, and only a stretch between two cuts is held.
    """
    held, start = [], 0
    for n in sizes:
        if held and n >= k and held[-1] >= k:
            yield from ((lo + start, hi + start, total) for lo, hi, total in fold_by_size(held, k))
            start, held = start + len(held), []
        held.append(n)
    yield from ((lo + start, hi + start, total) for lo, hi, total in fold_by_size(held, k))


def _ranges(sized: DataFrame, how: str, k: int, threshold: float, strict: bool) -> DataFrame:
    """(lo, hi, n): the fold over all reference values, streamed in order through one task.

    It sees one row of three numbers per reference value, never a record.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = fold_by_similarity(rows, k, threshold) if how == "SIM" else fold_in_stretches((r[1] for r in rows), k)
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=["lo", "hi", "n"])

    if how not in ("SIM", "SIZE"):
        raise ValueError(f"SIM or SIZE, not {how}")
    rows = sized.select(F.col("idx").cast("long"), F.col("n").cast("long"), "sim")
    if strict and how == "SIM":
        rows = rows.join(rows.agg(F.max("idx").alias("idx")), "idx", "left_anti")
    return rows.repartition(1).sortWithinPartitions("idx").mapInArrow(run, "lo long, hi long, n long")


@dataclass
class SortedNeighbourhood:
    """Three parties: common reference values, ranges merged by similarity (SIM) or size (SIZE).

    ``strict`` leaves out the range of the largest value in SIM.
    """

    refs: DataFrame
    k: int
    threshold: float = 0.8
    how: str = "SIM"
    overlap: int = 0
    similarity_name: str = "dice"
    strict: bool = False

    def index(self, party_keys: DataFrame) -> DataFrame:
        """(block, lo, hi, rec_id) of a party's (rec_id, key); block is the range's first index.

        Built once and written: matching and assessing read it again.
        """
        refs = materialise(reference_index(self.refs), "references")
        at = materialise(party_keys.join(assign(party_keys, refs), "key").select("rec_id", "idx"), "assigned")
        ranges = _ranges(index_sizes(at, refs, self.similarity_name), self.how, self.k, self.threshold, self.strict)
        spread = ranges.select(F.col("lo").alias("block"), "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("idx"))
        return materialise(at.join(spread, "idx").select("block", "lo", "hi", "rec_id"), "members")

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """(a_block, b_block) of ranges that share an index, widened by ``overlap``."""
        last = self.refs.select("ref").distinct().count()
        wide = F.sequence(F.greatest(F.col("lo") - self.overlap, F.lit(0)), F.least(F.col("hi") + self.overlap, F.lit(last)))
        left = a.select("block", "lo", "hi").distinct().select(F.col("block").alias("a_block"), F.explode(wide).alias("idx"))
        right = b.select("block", "lo", "hi").distinct().select(F.col("block").alias("b_block"), F.explode(F.sequence("lo", "hi")).alias("idx"))
        return left.join(right, "idx").select("a_block", "b_block").distinct()

    def pairs(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return linked_pairs(a, b, self.match(a, b))


def windows(a_values: DataFrame, b_values: DataFrame, w: int) -> DataFrame:
    """(start, stop): windows of 2w ranks over the distinct values of both parties, each widened to the
    right until it holds w values of either party or ends. Fewer than 2w values have no window."""
    flags = a_values.select("ref", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b_values.select("ref", F.lit(0).alias("a"), F.lit(1).alias("b")))
    flags = flags.groupBy("ref").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    placed = materialise(ranked(flags, ["ref"], "rn", {"ca": "a", "cb": "b"}), "window-values")
    return placed.withColumn("total", F.lit(placed.count()))


def window_ends(ranked: DataFrame, w: int) -> DataFrame:
    """Adds ``start, stop`` for every rank that starts a window."""
    starts = ranked.filter(F.col("rn") <= F.col("total") - 2 * w + 1).select(F.col("rn").alias("start"), "total", (F.col("ca") - F.col("a") + w).alias("need_a"), (F.col("cb") - F.col("b") + w).alias("need_b"))
    at = lambda side: ranked.filter(F.col(side) == 1).select(F.col(f"c{side}").alias(f"need_{side}"), F.col("rn").alias(f"rank_{side}"))
    out = starts.join(at("a"), "need_a", "left").join(at("b"), "need_b", "left")
    return out.select("start", F.greatest(F.col("start") + 2 * w - 1, F.coalesce("rank_a", "total"), F.coalesce("rank_b", "total")).alias("stop"))


def window_pairs(ranked: DataFrame, ends: DataFrame, w: int) -> DataFrame:
    """Distinct (a_ref, b_ref) that stand in one window.

    Ends never decrease, so a pair of ranks shares a window just if it shares the last one that
    starts at or before the lower rank: each rank reaches a range of ranks to its right.
    """
    last = ranked.filter(F.col("total") >= 2 * w).withColumn("start", F.least(F.col("rn"), F.col("total") - 2 * w + 1))
    reach = last.join(ends, "start").select("rn", "ref", "a", "b", F.explode(F.sequence("rn", "stop")).alias("at"))
    right = ranked.select(F.col("rn").alias("at"), F.col("ref").alias("other"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    met = reach.join(right, "at")
    one = met.filter("a = 1 and ob = 1").select(F.col("ref").alias("a_ref"), F.col("other").alias("b_ref"))
    two = met.filter("b = 1 and oa = 1").select(F.col("other").alias("a_ref"), F.col("ref").alias("b_ref"))
    return one.unionByName(two).distinct()


@dataclass
class TwoPartySortedNeighbourhood:
    """Two parties with reference values of their own, ranges merged by similarity, matched by windows."""

    a_refs: DataFrame
    b_refs: DataFrame
    k: int
    w: int = 2
    threshold: float = 0.8
    similarity_name: str = "dice"
    strict: bool = False

    def _side(self, refs: DataFrame) -> SortedNeighbourhood:
        return SortedNeighbourhood(refs, self.k, self.threshold, "SIM", 0, self.similarity_name, self.strict)

    def index(self, party_keys: DataFrame, side: str) -> DataFrame:
        return self._side(self.a_refs if side == "a" else self.b_refs).index(party_keys)

    def ref_blocks(self, members: DataFrame, side: str) -> DataFrame:
        """(ref, block): the values in each range, without the sentinel."""
        spread = members.select("block", "lo", "hi").distinct().select("block", F.explode(F.sequence("lo", "hi")).alias("idx"))
        return spread.filter("idx > 0").join(reference_index(self.a_refs if side == "a" else self.b_refs), "idx").select("ref", "block")

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """(a_block, b_block), one row for each pair of reference values that share a window."""
        left, right = self.ref_blocks(a, "a"), self.ref_blocks(b, "b")
        ranked = windows(left.select("ref"), right.select("ref"), self.w)
        pairs = window_pairs(ranked, window_ends(ranked, self.w), self.w)
        of_a = left.select(F.col("ref").alias("a_ref"), F.col("block").alias("a_block"))
        of_b = right.select(F.col("ref").alias("b_ref"), F.col("block").alias("b_block"))
        return pairs.join(of_a, "a_ref").join(of_b, "b_ref").select("a_block", "b_block")

    def pairs(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return linked_pairs(a, b, self.match(a, b))

"""Places and running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise


def in_ranges(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``_part``: ranges of ``order`` of about equal size, in order, and written."""
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return materialise(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def before_each(parts: DataFrame, **totals: Column) -> DataFrame:
    """(_part, totals): what the ranges before each hold. A row per range, so one task can add them up."""
    held = parts.groupBy("_part").agg(*[c.alias(n) for n, c in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals])


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", sums: Mapping[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``name``, the place from 1 by ``order``, and for each ``new: column`` of ``sums`` its running sum.

    Ranges are sorted one by one; what stands before a range comes from the ranges' totals.
    """
    sums = dict(sums or {})
    parts = in_ranges(df, order, partitions)
    totals = {f"_before_{k}": F.sum(c) for k, c in enumerate(sums.values())}
    before = before_each(parts, _before=F.count(F.lit(1)), **totals)
    here = Window.partitionBy("_part").orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    # a row per range, hence the broadcast
    rows = parts.join(F.broadcast(before), "_part")
    made = {name: (F.row_number().over(here) + F.col("_before")).cast("long")}
    made |= {n: F.sum(c).over(so_far) + F.col(f"_before_{k}") for k, (n, c) in enumerate(sums.items())}
    return rows.withColumns(made).drop("_part", "_before", *totals)

"""Blocks as long tables: memberships (block, rec_id) of a party, joined into candidate pairs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Blocker(Protocol):
    """A blocking method: memberships of a party, and the blocks that two parties share."""

    def index(self, party: DataFrame) -> DataFrame: ...

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame: ...


def frequency_filter(members: DataFrame, low: int, high: int) -> DataFrame:
    """Memberships of blocks with more than ``low`` and at most ``high`` members, repeats counted."""
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > low) & (F.col("_n") <= high))
    return members.join(sizes.select("block"), "block", "left_semi")


def ratio_filter(members: DataFrame, records: int, low: float, high: float) -> DataFrame:
    """The frequency filter with bounds as shares of the party's records."""
    return frequency_filter(members, int(low * records), int(high * records))


def shared_blocks(a: DataFrame, b: DataFrame, k: int = 0) -> DataFrame:
    """(block, na, nb) of the blocks that both parties have, each with at least ``k`` members."""
    na = a.groupBy("block").agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy("block").agg(F.count(F.lit(1)).alias("nb"))
    return na.join(nb, "block").filter((F.col("na") >= k) & (F.col("nb") >= k))


def candidate_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of records that share a block.

    Memberships are made distinct first: repeats would multiply within the join.
    """
    left = a.select("block", F.col("rec_id").alias("a")).distinct()
    right = b.select("block", F.col("rec_id").alias("b")).distinct()
    return left.join(right, "block").select("a", "b").distinct()


def linked_pairs(a: DataFrame, b: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct pairs of records whose blocks are linked: links are (a_block, b_block)."""
    left = a.select(F.col("block").alias("a_block"), F.col("rec_id").alias("a")).distinct()
    right = b.select(F.col("block").alias("b_block"), F.col("rec_id").alias("b")).distinct()
    return links.select("a_block", "b_block").distinct().join(left, "a_block").join(right, "b_block").select("a", "b").distinct()

"""Many parties: blocks held by at least k of them, and how well they reduce and cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import side_by_side


def blocks_of_at_least(members: DataFrame, k: int) -> DataFrame:
    """Memberships (party, block, rec_id) of the blocks that at least ``k`` parties have."""
    held = members.select("block", "party").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    return members.join(held.select("block"), "block", "left_semi")


def true_sets(records: DataFrame, k: int) -> DataFrame:
    """(ent, party, rec_id): records of the entities that at least ``k`` parties hold."""
    ent = records.select(F.col("rec_id").alias("ent"), "party", "rec_id").distinct()
    enough = ent.groupBy("ent").agg(F.countDistinct("party").alias("n")).filter(F.col("n") >= k)
    return ent.join(enough.select("ent"), "ent", "left_semi")


def reduction(records: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """One row comparisons, naive, rr: the product of a block's sizes over the parties that have it.

    It can exceed the product of all parties' sizes, and rr then is below 0.
    """
    sizes = blocks_of_at_least(members, k).groupBy("block", "party").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    product = lambda c: F.aggregate(F.collect_list(c), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    done = sizes.groupBy("block").agg(product("n").alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0)).cast("double").alias("comparisons"))
    naive = records.groupBy("party").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n")).agg(product("n").cast("double").alias("naive"))
    return side_by_side(done, naive).select("comparisons", "naive", (F.lit(1.0) - F.col("comparisons") / F.col("naive")).alias("rr"))


def set_completeness(records: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """One row contained, true_sets, sc: true sets that stand whole in some block."""
    truth = true_sets(records, k)
    size = truth.groupBy("ent").agg(F.count(F.lit(1)).alias("n"))
    met = truth.join(blocks_of_at_least(members, k).select("party", "rec_id", "block").distinct(), ["party", "rec_id"])
    whole = met.groupBy("ent", "block").agg(F.count(F.lit(1)).alias("c")).join(size, "ent").filter("c = n").select("ent").distinct()
    found = whole.agg(F.count(F.lit(1)).alias("contained"))
    return side_by_side(found, size.agg(F.count(F.lit(1)).alias("true_sets"))).select(
        "contained", "true_sets", F.when(F.col("true_sets") > 0, F.col("contained") / F.col("true_sets")).otherwise(F.lit(-1.0)).alias("sc")
    )

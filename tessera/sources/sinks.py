"""Result sinks: comparison tables, block sizes, risks and blocks as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a method's result row.
RESULT_COLUMNS = (
    "Method alice_num_recs bob_num_recs num_ref_val K rr pc pq dbo_time lu_time assess_time tot_time"
    " a_min_blk a_med_blk a_max_blk a_avg_blk a_std_dev b_min_blk b_med_blk b_max_blk b_avg_blk b_std_dev num_blocks num_cand_rec_pairs"
).split()


def result_row(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    """One result row; measures that weren't taken are null."""
    cell = lambda c: F.lit(values.get(c)).cast("string" if c == "Method" else "double").alias(c)
    return spark.range(1).select(*[cell(c) for c in RESULT_COLUMNS])


def append_result(row: DataFrame, path: str) -> None:
    row.write.mode("append").csv(path, header=True)


def write_results(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def update_result(table: DataFrame, row: DataFrame) -> DataFrame:
    """The table with the row in place of all rows of its method."""
    return table.join(row.select("Method").distinct(), "Method", "left_anti").unionByName(row)


def write_block_sizes(members: DataFrame, path: str) -> None:
    """Appends the size of every block of (block, rec_id)."""
    members.groupBy("block").agg(F.count(F.lit(1)).alias("size")).write.mode("append").csv(path, header=True)


def aligned_risks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Risks of both parties side by side: rec_id, arisk, brisk."""
    return a.select("rec_id", F.col("risk").alias("arisk")).join(b.select("rec_id", F.col("risk").alias("brisk")), "rec_id", "full_outer")


def block_lines(members: DataFrame) -> DataFrame:
    """A line ``key,id,id,...`` per block; ids ascending."""
    ids = members.groupBy("block").agg(F.array_sort(F.collect_list("rec_id")).alias("ids"))
    return ids.select(F.concat_ws(",", F.array(F.col("block").cast("string")), F.col("ids")).alias("value"))


def write_blocks(members: DataFrame, path: str) -> None:
    block_lines(members).write.mode("overwrite").text(path)

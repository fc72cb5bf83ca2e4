"""Queries behind the usual charts, over tables of result rows (``sinks.RESULT_COLUMNS``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variance(results: DataFrame) -> DataFrame:
    """Mean and population deviation of pc by method over all scales."""
    return results.groupBy("Method").agg(F.avg("pc").alias("mean_pc"), F.stddev_pop("pc").alias("std_pc"))


def scalability(results: DataFrame) -> DataFrame:
    """Index and match time by method and scale."""
    return results.groupBy("Method", "alice_num_recs").agg(F.sum(F.col("dbo_time") + F.col("lu_time")).alias("total_time"))


def correlation(results: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of two measures: guarantees against ratios."""
    return results.agg(F.corr(x, y).alias("correlation"))


def error_bars(results: DataFrame, party: str) -> DataFrame:
    """Block sizes of a party (``a`` or ``b``) by method: mean, deviation, and the way down and up from it."""
    avg, low, high = (F.col(f"{party}_{c}_blk") for c in ("avg", "min", "max"))
    return results.select("Method", avg.alias("mean"), F.col(f"{party}_std_dev").alias("std_dev"), (avg - low).alias("down"), (high - avg).alias("up"))


def ratios(results: DataFrame, without: str | None = None) -> DataFrame:
    """rr against pc by method, one method left out if named."""
    kept = results.filter(F.col("Method") != without) if without else results
    return kept.select("Method", "rr", "pc", "pq")


def runtimes(results: DataFrame) -> DataFrame:
    return results.select("Method", "dbo_time", "lu_time", (F.col("dbo_time") + F.col("lu_time")).alias("run_time"))


def subset_matching(results: DataFrame) -> DataFrame:
    """rr, completeness and time by the least number of parties."""
    return results.select("k", F.col("RR").alias("rr"), F.col("SC").alias("sc"), F.col("TOTAL_TIME").alias("total_time")).orderBy("k")

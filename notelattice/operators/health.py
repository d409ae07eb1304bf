"""Health and outcomes as folds over small tables: states of vaults, results of file operations, restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelattice.streaming.events import micros


def all_running(statuses: DataFrame) -> DataFrame:
    """ready: whether every vault's state is running; true without any."""
    return statuses.agg(F.coalesce(F.bool_and(F.col("state") == "running"), F.lit(True)).alias("ready"))


def unhealthy(statuses: DataFrame, threshold: int) -> DataFrame:
    """The vaults (slug, state, failures in a row) that failed or reached the threshold, with the
    reason; a threshold of 0 switches this off."""
    reason = F.when(F.lit(threshold) == 0, None).when(F.col("state") == "failed", "failed").when(F.col("failures") >= threshold, "failed_attempts")
    return statuses.withColumn("reason", reason).where("reason IS NOT NULL")


def outcomes(results: DataFrame, *keys: str) -> DataFrame:
    """indexed of each operation: every (ok, indexed) result is ok and some are indexed."""
    return results.groupBy(*keys).agg((F.bool_and("ok") & F.bool_or("indexed")).alias("indexed"))


def lock_keys(keys: Column) -> Column:
    """The keys to lock, each once, in the order in which everyone takes them."""
    return F.array_sort(F.array_distinct(keys))


def narrowed(statuses: DataFrame, slug: str) -> DataFrame:
    """The status that a scope sees: its own vault's."""
    return statuses.where(F.col("slug") == slug)


def over_ceiling(log: DataFrame, key: str, seconds: int, ceiling: int) -> DataFrame:
    """log (key, ts, event_id, kind) with `recent`, the crashes of the key in the window up to each
    row since it last recovered, and `over`: more of them than the ceiling."""
    so_far = W.partitionBy(key).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    lives = log.withColumn("life", F.count_if(F.col("kind") == "recovered").over(so_far))
    window = W.partitionBy(key, "life").orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    counted = lives.withColumn("recent", F.count_if(F.col("kind") == "crash").over(window))
    return counted.withColumn("over", F.col("recent") > ceiling).drop("life")


def file_set_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (gone or come) between two listings."""
    gone = before.select("path").exceptAll(after.select("path")).withColumn("change", F.lit("gone"))
    return gone.unionByName(after.select("path").exceptAll(before.select("path")).withColumn("change", F.lit("come")))

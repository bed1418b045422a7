"""Results as a keyed table, stored (``results_store``) or as frames: lookup, misses, upsert, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshots import SnapshotTable

KEY = ["collection", "symbol", "timeframe", "strategy", "params", "metric", "fingerprint", "fees", "slippage", "engine_version"]
LIST_ORDER = ["collection", "symbol", "timeframe", "strategy"]


def results_store(spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 32) -> SnapshotTable:
    """Results that outlive the session: ``upsert``, ``lookup``, ``read``, ``vacuum``; sorted for listing within a bucket."""
    keys = keys or KEY
    return SnapshotTable(spark, path, keys, order=[*(c for c in LIST_ORDER if c in keys), *(k for k in keys if k not in LIST_ORDER)], buckets=buckets)


def cache_lookup(candidates: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the stored value, null where there is none."""
    stored = results.select(*keys, F.col("metric_value").alias("stored_value"), F.lit(True).alias("hit"))
    return candidates.join(stored, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_misses(candidates: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(results.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace: the row of the highest ``version`` of each key, new rows before old ones.

    The run isn't part of the key, so a repeated result moves to the newest run.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(version).desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def list_by_run(results: DataFrame, run_id) -> DataFrame:
    return results.filter(F.col("run_id") == run_id).orderBy(*LIST_ORDER)

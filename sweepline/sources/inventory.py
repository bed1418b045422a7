"""An inventory of files that is kept up to date, and what of it is past its keep.

A listing (path, size, modified) is compared with the inventory by path and time: new and changed files are written, files that are gone are
marked, all others keep their rows and their buckets' files. Retention then reads the inventory, with given roots and a given clock.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import SnapshotTable

FILES = "path string, size long, modified timestamp_ntz, gone boolean, seen_at timestamp_ntz"


def inventory_store(spark: SparkSession, path: str, buckets: int = 16) -> SnapshotTable:
    return SnapshotTable(spark, path, ["path"], buckets=buckets)


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, size, modified) of all files under ``roots`` that aren't empty; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


def under(roots: list[str], path: str = "path") -> Column:
    """Whether a path lies under one of ``roots``; a root is a folder, so ``reports`` doesn't hold ``reports-old/a``."""
    found = F.lit(False)
    for root in roots:
        found = found | F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return found


def changes(known: DataFrame, listed: DataFrame, roots: list[str], now: datetime.datetime) -> DataFrame:
    """Rows of ``FILES`` to be written: new or changed files, and known ones under ``roots`` that aren't listed any more.

    A file that came back counts as changed; files under other roots are left alone. Of a path listed twice the newest counts.
    """
    once = listed.groupBy("path").agg(F.max_by(F.struct("size", "modified"), F.struct("modified", "size")).alias("l")).select("path", "l.*", F.lit(True).alias("listed"))
    old = known.filter(under(roots)).select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("gone").alias("_gone"))
    both = once.filter(under(roots)).join(old, "path", "full")
    same = F.col("_modified").eqNullSafe(F.col("modified")) & F.col("_size").eqNullSafe(F.col("size")) & ~F.coalesce("_gone", F.lit(True))
    lost = F.col("listed").isNull()
    changed = both.filter(F.when(lost, ~F.col("_gone")).otherwise(~same))
    stamp = F.lit(now).cast("timestamp_ntz")
    return changed.select("path", F.coalesce("size", "_size").alias("size"), F.coalesce("modified", "_modified").alias("modified"), lost.alias("gone"), stamp.alias("seen_at"))


def refresh(store: SnapshotTable, listed: DataFrame, roots: list[str], now: datetime.datetime) -> int:
    """Bring the inventory up to date; returns its version."""
    known = store.read() if store.versions() else store.spark.createDataFrame([], FILES)
    return store.upsert(changes(known, listed, roots, now), "seen_at")


def past_keep(files: DataFrame, roots: list[str], days: int, now: datetime.datetime) -> DataFrame:
    """(path, size, age_days) of files under ``roots`` that are at least ``days`` whole days old at ``now``; a file of exactly that age is past."""
    at = F.lit(now).cast("timestamp_ntz")
    past = F.col("modified") <= at - F.make_dt_interval(F.lit(days))
    age = F.extract(F.lit("DAY"), at - F.col("modified")).cast("int")  # by the wall clock
    return files.filter(~F.col("gone") & under(roots) & past).select("path", "size", age.alias("age_days"))

"""Run summaries kept as states that merge: a listing reads states, never results.

A state is a row for (run, batch): counts, the distinct names of each kind, and for each metric its count, sum, extremes and best row. States of one run add
up, whatever batches its results came in; recording a batch again replaces that batch's state, so a repeated write counts once.
Distinct names are exact sets: a run has as many as its configuration names (symbols, strategies), not as results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import not_nan
from ..sources.snapshots import SnapshotTable
from .summary import METRICS, PLACE, direction

KINDS = {"collections": "collection", "symbols": "symbol", "strategies": "strategy", "timeframes": "timeframe"}
#: What a metric's state holds; ``best`` carries its own rank, so states of different batches compare.
_METRIC = ("n", "total", "low", "high", "best")


def _rank(metric: str, value: Column) -> Column:
    return -value if metric == "pain_index" else value


def _metric_state(metric: str) -> Column:
    value = not_nan(metric)
    best = F.max(F.when(value.isNotNull(), F.struct(_rank(metric, value).alias("rank"), (-F.col("ordinal")).alias("first"), *PLACE, value.alias("value"))))
    return F.struct(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), best.alias("best")).alias(f"m_{metric}")


def run_states(results: DataFrame, batch: str | Column, metrics: list[str] = METRICS) -> DataFrame:
    """(run_id, batch, results, a set for each kind, a state for each metric); combined before the one shuffle."""
    name = F.lit(batch) if isinstance(batch, str) else batch
    sets = [F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias(k) for k, c in KINDS.items()]
    return results.groupBy("run_id", name.alias("batch")).agg(F.count("*").alias("results"), *sets, *map(_metric_state, metrics))


def _merged_metric(name: str) -> Column:
    at = lambda part: F.col(f"{name}.{part}")
    return F.struct(F.sum(at("n")).alias("n"), F.sum(at("total")).alias("total"), F.min(at("low")).alias("low"), F.max(at("high")).alias("high"), F.max(at("best")).alias("best")).alias(name)


def merged(states: DataFrame) -> DataFrame:
    """A state for each run."""
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in KINDS]
    return states.groupBy("run_id").agg(F.sum("results").alias("results"), *sets, *(_merged_metric(c) for c in states.columns if c.startswith("m_")))


def counts(state: DataFrame) -> DataFrame:
    """``summary.summary_counts`` by run."""
    return state.select("run_id", "results", *(F.size(k).cast("long").alias(k) for k in KINDS))


def _long(state: DataFrame) -> DataFrame:
    names = [c for c in state.columns if c.startswith("m_")]
    rows = F.inline(F.array(*(F.struct(F.lit(c[2:]).alias("metric"), F.col(c).alias("m")) for c in names)))
    return state.select("run_id", rows).filter("m.n > 0")


def metric_ranges(state: DataFrame) -> DataFrame:
    """``summary.summary_metrics`` by run."""
    long = _long(state)
    return long.select("run_id", "metric", (F.col("m.total") / F.col("m.n")).alias("mean"), F.col("m.low").alias("min"), F.col("m.high").alias("max"), direction(F.col("metric")).alias("direction"))


def best_rows(state: DataFrame) -> DataFrame:
    """``summary.summary_best`` by run."""
    return _long(state).select("run_id", "metric", *(F.col(f"m.best.{c}").alias(c) for c in PLACE), F.col("m.best.value").alias("value"))


def metrics_seen(state: DataFrame) -> DataFrame:
    """The metrics that any run has a number for."""
    return _long(state).select("metric").distinct()


def states_store(spark: SparkSession, path: str, buckets: int = 8) -> SnapshotTable:
    """The stored states, by (run, batch)."""
    return SnapshotTable(spark, path, ["run_id", "batch"], spread=["run_id"], buckets=buckets)


def record(store: SnapshotTable, results: DataFrame, batch: str) -> int:
    """Keep the states of a batch of results; other batches stay."""
    return store.replace(run_states(results, batch))

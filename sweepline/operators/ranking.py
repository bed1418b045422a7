"""Best rows, top-N and alerts. Every order ends in an ordinal, so ties go to the first row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, format_6f, is_positive, not_nan


def top_by(rows: DataFrame, keys: list[str], value: str = "metric_value", n: int = 1, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` rows of each key, highest value first, nulls and NaN last."""
    w = Window.partitionBy(*keys).orderBy(not_nan(value).desc_nulls_last(), F.col(ordinal))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_per_job(rows: DataFrame, keys: list[str], value: str = "metric_value", ordinal: str = "combo_id") -> DataFrame:
    """The best finite combination of every job; jobs without one go."""
    return top_by(rows.filter(finite(value).isNotNull()), keys, value, 1, ordinal).drop("rank")


def best_positive(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best row of each key, if its metric is over 0."""
    return top_by(rows, keys).filter(is_positive("metric_value")).drop("rank")


def best_per_strategy(rows: DataFrame) -> DataFrame:
    named = rows.filter("strategy is not null and strategy != ''").withColumn("collection", F.coalesce(F.nullif("collection", F.lit("")), F.lit("unknown")))
    return top_by(named, ["collection", "strategy"]).drop("rank")


def top_overall(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.orderBy(not_nan("metric_value").desc_nulls_last(), "ordinal").limit(n)


def results_sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce("metric_value", F.lit(0.0)).desc(), "ordinal")



def alert_message() -> Column:
    """The fixed text of an alert from a best row's columns."""
    number = lambda c: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.3f", F.col(c)))
    lines = [
        F.concat(F.lit("🚨 QUANT SIGNAL: "), F.col("symbol"), F.lit(" 📊")),
        F.concat(F.lit("Strategy: "), F.col("strategy")),
        F.concat(F.lit("Timeframe: "), F.col("timeframe")),
        F.concat(F.lit("📈 Sharpe: "), number("sharpe")),
        F.concat(F.lit("📊 Sortino: "), number("sortino")),
        F.concat(F.lit("⚖️ Calmar: "), number("calmar")),
        F.lit(""),
        F.lit("Price: {close}"),
        F.lit("Time: {timenow}"),
        F.lit("Action: {strategy.order.action}"),
        F.lit("Qty: {strategy.order.contracts}"),
        F.lit(""),
        F.concat(F.lit("#QuantTrading #"), F.col("symbol"), F.lit(" #"), F.col("strategy")),
    ]
    return F.concat_ws("\n", *lines)


def threshold_alert(rows: DataFrame, metric: str, threshold: float | None) -> DataFrame:
    """One row: the best candidate of the metric (of all rows if none has it) and why no alert goes out."""
    same = F.count_if(F.lower("metric") == metric.lower()) > 0
    marked = F.when(F.lower("metric") == metric.lower(), F.col("metric_value"))
    pick = lambda v: F.max_by(F.struct("collection", "symbol", "strategy", "timeframe", "metric_value"), F.struct(v, -F.col("ordinal")))
    best = rows.filter(not_nan("metric_value").isNotNull()).agg(F.when(same, pick(marked)).otherwise(pick(F.col("metric_value"))).alias("b"))
    value = F.col("b.metric_value")
    reason = F.when(value.isNull(), "no_results").when(value < F.lit(threshold), "below_threshold") if threshold is not None else F.when(value.isNull(), "no_results")
    return best.select(F.lit(metric).alias("metric"), "b.collection", "b.symbol", "b.strategy", "b.timeframe", value.alias("value"), reason.alias("reason"))


def csv_rows(rows: DataFrame, stats: list[str]) -> DataFrame:
    """The export projection: six decimals, missing statistics ``nan``, missing trades 0."""
    return rows.select(
        "collection", "symbol", "timeframe", "strategy", "metric", format_6f("metric_value").alias("metric_value"), "params", *(format_6f(s).alias(s) for s in stats), F.coalesce("trades", F.lit(0)).cast("long").alias("trades"), format_6f("max_drawdown").alias("max_drawdown")
    )

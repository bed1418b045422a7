"""Summaries of runs, highlights, histograms, comparisons and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, float_text, not_nan

# Names of the metrics, in the order that reports show them.
METRICS = ["sharpe", "sortino", "omega", "tail_ratio", "profit", "pain_index", "max_drawdown", "cagr", "calmar"]
HIGHLIGHTS = ["sharpe", "omega", "tail_ratio", "pain_index", "profit"]
TRACKED = ["sharpe", "sortino", "omega", "tail_ratio", "profit", "pain_index"]
FALLBACK_METRICS = ["omega", "tail_ratio", "pain_index", "profit", "sharpe"]
PLACE = ["collection", "symbol", "timeframe", "strategy"]


def direction(metric: Column) -> Column:
    return F.when(metric == "pain_index", "min").otherwise("max")


def long_stats(rows: DataFrame, metrics: list[str], ids: list[str]) -> DataFrame:
    """A row for each statistic that is a number."""
    return rows.unpivot(ids, metrics, "metric", "value").filter(not_nan("value").isNotNull())


def summary_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    distinct = lambda c: F.count_distinct(F.nullif(c, F.lit("")))
    return rows.groupBy(*by).agg(
        F.count("*").alias("results"), distinct("collection").alias("collections"), distinct("symbol").alias("symbols"), distinct("strategy").alias("strategies"), distinct("timeframe").alias("timeframes")
    )


def summary_metrics(rows: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    found = long_stats(rows, metrics, by).groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return found.withColumn("direction", direction(F.col("metric")))


def summary_best(rows: DataFrame, by: list[str], metrics: list[str] = METRICS, all_max: bool = False) -> DataFrame:
    """The row that attains the best value of every metric, the first on ties; ``all_max``: the largest of each."""
    stats = long_stats(rows, metrics, [*by, *PLACE, "ordinal"])
    rank = F.col("value") if all_max else F.when(F.col("metric") == "pain_index", -F.col("value")).otherwise(F.col("value"))
    best = stats.groupBy(*by, "metric").agg(F.max_by(F.struct(*PLACE, "value"), F.struct(rank, -F.col("ordinal"))).alias("b"))
    return best.select(*by, "metric", *(f"b.{c}" for c in PLACE), "b.value")


def highlights(rows: DataFrame, by: list[str]) -> DataFrame:
    """Best, else highest, else mean value of five metrics, with its place."""
    best = summary_best(rows, by, HIGHLIGHTS)
    metrics = summary_metrics(rows, by, HIGHLIGHTS)
    joined = metrics.join(best, [*by, "metric"], "left")
    value = F.coalesce(not_nan("value"), not_nan("max"), not_nan("mean"))
    return joined.select(*by, "metric", value.alias("value"), "direction", *PLACE).filter("value is not null")


def metric_histogram(rows: DataFrame, metric: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of a finite metric in ``bins`` equal bins; 0 and bins + 1 hold what lies outside."""
    value = finite(metric)
    return rows.filter(value.isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


COUNTERS = ["result_cache_hits", "result_cache_misses", "param_evals", "symbols_tested", "strategies_count"]


def _counters() -> list[Column]:
    job = F.struct("collection", "symbol", "timeframe", "strategy")
    return [
        F.count_if("hit").alias("result_cache_hits"),
        F.count_if(~F.col("hit")).alias("result_cache_misses"),
        F.count_if(~F.col("hit")).alias("param_evals"),
        F.count_distinct(job).alias("symbols_tested"),
        F.count_distinct("strategy").alias("strategies_count"),
    ]


def run_counters(evaluations: DataFrame) -> DataFrame:
    """(hit, collection, symbol, timeframe, strategy) of every evaluation -> one row of counters."""
    return evaluations.agg(*_counters())


def run_metrics_text(evaluations: DataFrame, at: Column) -> DataFrame:
    """Metrics text of a run: seconds from its first to its last evaluation, results and counters, a line each."""
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1_000_000
    row = evaluations.agg(float_text(seconds).alias("run_duration_seconds"), F.count("*").alias("results_count"), *_counters())
    return counters_text(row, ["run_duration_seconds", "results_count", *COUNTERS])


def run_summary(rows: DataFrame, failures: DataFrame, notifications: DataFrame | None = None, statuses: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """A row for each run: times, metric, counts, best values, counters, failures by kind, what the dashboard says, notifications and status.

    ``at`` is the time of a result; times have whole seconds, in UTC. ``failures``: (run_id, stage, error, and the place and params of a failed
    combination); they are listed by kind, with their number and the first one's place and params, so that a run's row grows with its
    kinds of failure alone (all records are in the failures themselves). ``notifications``: (run_id, channel, sent, reason). ``statuses``:
    (run_id, status, message). The list of runs is ``runs_history``'s, once, and in no run's row.
    """
    distinct = lambda c: F.count_distinct(F.nullif(c, F.lit("")))
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    times = [] if at is None else [iso(F.min(at)).alias("started_at"), iso(F.max(at)).alias("finished_at"), (F.unix_seconds(F.max(at)) - F.unix_seconds(F.min(at))).alias("duration_sec")]
    board = F.struct(distinct("collection").alias("collections"), distinct("symbol").alias("symbols"), distinct("strategy").alias("strategies"), distinct("timeframe").alias("timeframes"))
    found = rows.groupBy("run_id").agg(
        *times, F.min("metric").alias("metric"), F.count("*").alias("results_count"), F.max(not_nan("metric_value")).alias("best"), F.max(not_nan("sharpe")).alias("best_sharpe"), F.struct(*_counters()).alias("metrics"), board.alias("dashboard")
    )
    where = [c for c in (*PLACE, "params") if c in failures.columns]
    shown = F.struct("stage", "error", "count", *(F.col(f"first.{c}").alias(c) for c in where))
    order = F.struct("ordinal") if "ordinal" in failures.columns else F.struct(*where)
    kinds = failures.groupBy("run_id", "stage", "error").agg(F.count("*").alias("count"), F.min_by(F.struct(*where), order).alias("first"))
    listed = kinds.groupBy("run_id").agg(F.sum("count").alias("failures_count"), F.array_sort(F.collect_list(shown)).alias("failures"))
    out = found.join(listed, "run_id", "left").withColumn("failures_count", F.coalesce("failures_count", F.lit(0)))
    out = out.withColumn("failures", F.coalesce("failures", F.array().cast(dict(listed.dtypes)["failures"])))
    for name, events in (("notifications", notifications), ("manifest_refresh", statuses)):
        if events is not None:
            each = F.struct(*(c for c in events.columns if c != "run_id"))
            events = events.groupBy("run_id").agg(F.array_sort(F.collect_list(each)).alias(name))
            out = out.join(events, "run_id", "left").withColumn(name, F.coalesce(name, F.array().cast(dict(events.dtypes)[name])))
    return out


def counters_text(counters: DataFrame, names: list[str]) -> DataFrame:
    """``quant_<name> <value>`` lines."""
    stacked = counters.unpivot([], [F.col(n).cast("string").alias(n) for n in names], "name", "value")
    return stacked.select(F.concat(F.lit("quant_"), "name", F.lit(" "), "value").alias("line"))


def health_failures(failures: DataFrame) -> DataFrame:
    clean = F.trim(F.translate(F.coalesce("error", F.lit("")), "|", " "))
    every = failures.agg(F.count("*")).scalar()  # partial counts, one number; no window over all rows
    return failures.withColumn("error", clean).withColumn("failures", every)


def available_metrics(listed: DataFrame, by_run: DataFrame) -> DataFrame:
    """(metric, position): listed ones first, then those of runs, then the fallback list, each once."""
    spark = listed.sparkSession
    fallback = spark.createDataFrame([(m, i) for i, m in enumerate(FALLBACK_METRICS)], "metric string, position long")
    parts = [listed.select("metric", F.lit(0).alias("part"), F.col("position").cast("string").alias("at")), by_run.select("metric", F.lit(1), F.col("metric")), fallback.select("metric", F.lit(2), F.col("position").cast("string"))]
    union = parts[0].union(parts[1]).union(parts[2])
    first = union.groupBy("metric").agg(F.min(F.struct("part", "at")).alias("at"))
    return first.select("metric", F.row_number().over(Window.orderBy("at.part", "at.at", "metric")).cast("long").alias("position"))


def compare_matrix(rows: DataFrame, metric: str = "sharpe") -> DataFrame:
    """A row for each run: the chosen metric, omega, tail ratio, pain index and profit (best, else max, else mean; finite)."""
    columns = [metric, *(m for m in ("omega", "tail_ratio", "pain_index", "profit") if m != metric)]

    def value(m: str) -> Column:
        x = not_nan(m)
        best = F.min(x) if m == "pain_index" else F.max(x)
        return F.coalesce(finite(best), finite(F.max(x)), finite(F.avg(x))).alias(m)

    some = F.array_max(F.array(*(not_nan(m).isNotNull() for m in columns)))  # a run without any number has no row
    return rows.filter(some).groupBy("run_id").agg(*map(value, columns))


def runs_history(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Past runs that have a summary or a dashboard, the current one in place of its stored entry, newest first."""
    past = runs.filter("has_summary or has_dashboard").join(current.select("run_id"), "run_id", "left_anti")
    return past.select(current.columns).unionByName(current).orderBy(F.col("run_id").desc())


def latest_run_status(statuses: DataFrame, run_id: str | None = None) -> DataFrame:
    """Status rows that the run of the greatest name recorded (column ``recorded_in``), or those of ``run_id``.

    A ``run_id`` that recorded nothing is a LookupError; without any row the result is empty.
    """
    if run_id is None:
        latest = statuses.agg(F.max("recorded_in").alias("recorded_in"))
        return statuses.join(F.broadcast(latest), "recorded_in", "left_semi")  # one row
    found = statuses.filter(F.col("recorded_in") == run_id)
    if found.isEmpty():
        raise LookupError(f"Run not found: {run_id}")
    return found


def compare_runs(rows: DataFrame, run_ids: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each wanted run beside its counts; ``run_ids`` are split at commas, unknown ones left out.

    No id is a ValueError, no known one a LookupError.
    """
    wanted = list(dict.fromkeys(r.strip() for r in run_ids.split(",") if r.strip()))
    if not wanted:
        raise ValueError("Provide at least one run id")
    own = rows.filter(F.col("run_id").isin(wanted))
    if own.isEmpty():
        raise LookupError("No runs found")
    counts = summary_counts(own, ["run_id"])
    return first_rows(own, "run_id", n, ["ordinal"]).join(F.broadcast(counts), "run_id")  # at most a row for each wanted id


def run_manifest_status(runs: DataFrame, results: DataFrame, csv_rows: DataFrame, current_run: str) -> DataFrame:
    """Status of every run directory: what its dashboard is, or what it can be rebuilt from."""
    stored = results.select("run_id").distinct().withColumn("stored", F.lit(True))
    in_csv = csv_rows.select("run_id").distinct().withColumn("in_csv", F.lit(True))
    joined = runs.join(stored, "run_id", "left").join(in_csv, "run_id", "left")
    has_cache = F.coalesce("stored", F.lit(False)) & (F.coalesce("results_count", F.lit(0)) > 0)
    has_csv = F.coalesce("in_csv", F.lit(False))
    usable = F.col("metric").isNotNull() & (F.col("metric") != "")
    status = (
        F.when(F.col("has_dashboard") & ~F.col("has_highlights"), "existing_updated")
        .when(F.col("has_dashboard"), "existing")
        .when(F.col("run_id") == current_run, "current_saved")
        .when(~F.col("has_summary"), "missing_summary")
        .when(usable & (has_cache | has_csv), "created")
        .otherwise("failed")
    )
    source = F.when(has_cache, "cache").when(has_csv, "csv")
    # The messages.
    message = (
        F.when(F.col("status") == "missing_summary", "Summary file missing; unable to rebuild dashboard")
        .when(F.col("status") == "failed", "Unable to rebuild dashboard from summary")
        .when(F.col("source") == "csv", "Dashboard regenerated using CSV fallback")
        .when(F.col("source") == "cache", "Dashboard regenerated from results cache")
    )
    marked = joined.withColumn("status", status).withColumn("source", F.when(F.col("status") == "created", source))
    return marked.select("run_id", "status", "source", message.alias("message"))


def first_rows(rows: DataFrame, by: str, n: int, order: list) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= n)

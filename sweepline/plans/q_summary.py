"""Summaries, highlights, runs and comparisons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import run_states as RS
from ..operators import sketches as K
from ..operators import summary as U
from ..sources import storage
from . import fixtures as X
from .base import query

RES = f"WITH {X.RESULTS_SQL}"
PLACE = "collection, symbol, timeframe, strategy"


def _long(metrics: list[str]) -> str:
    selects = " UNION ALL ".join(f"SELECT run_id, {PLACE}, ordinal, '{m}' AS name, {m} AS value FROM results WHERE {m} IS NOT NULL AND NOT isnan({m})" for m in metrics)
    return f"long AS ({selects})"


_COUNTS = "count(*) AS results, count(DISTINCT collection) AS collections, count(DISTINCT symbol) AS symbols, count(DISTINCT strategy) AS strategies, count(DISTINCT timeframe) AS timeframes"


@query("summary_counts", f"{RES} SELECT run_id, {_COUNTS} FROM results GROUP BY run_id")
def summary_counts(spark, d):
    return U.summary_counts(X.results(spark, d), ["run_id"])


_DIRECTION = "CASE WHEN name = 'pain_index' THEN 'min' ELSE 'max' END AS direction"
_METRICS_SQL = f"{RES}, {_long(U.METRICS)} SELECT run_id, name AS metric, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, {_DIRECTION} FROM long GROUP BY run_id, name"


@query("summary_metrics", _METRICS_SQL)
def summary_metrics(spark, d):
    return U.summary_metrics(X.results(spark, d), ["run_id"]).withColumn("mean", F.round("mean", 6))


def _best_sql(metrics: list[str], order: str) -> str:
    return f"{RES}, {_long(metrics)}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY {order}, ordinal) AS n FROM long) WHERE n = 1)"


_BY_DIRECTION = "CASE WHEN name = 'pain_index' THEN -value ELSE value END DESC"


@query("summary_best_entry", f"{_best_sql(U.METRICS, _BY_DIRECTION)} SELECT run_id, name AS metric, {PLACE}, value FROM best")
def summary_best_entry(spark, d):
    return U.summary_best(X.results(spark, d), ["run_id"])


@query("highlights", f"{_best_sql(U.HIGHLIGHTS, _BY_DIRECTION)} SELECT run_id, name AS metric, value, {_DIRECTION}, {PLACE} FROM best")
def highlights(spark, d):
    return U.highlights(X.results(spark, d), ["run_id"])


@query("metric_highlights_max", f"{_best_sql(U.TRACKED, 'value DESC')} SELECT run_id, name AS metric, {PLACE}, value FROM best")
def metric_highlights_max(spark, d):
    return U.summary_best(X.results(spark, d), ["run_id"], U.TRACKED, all_max=True)


@query("metric_histogram", f"{RES} SELECT CASE WHEN sharpe < -2.5 THEN 0 WHEN sharpe >= 2.5 THEN 21 ELSE floor((sharpe + 2.5) * 20 / 5.0)::INTEGER + 1 END::INTEGER AS bin, count(*) AS n FROM results WHERE isfinite(sharpe) GROUP BY 1")
def metric_histogram(spark, d):
    return U.metric_histogram(X.results(spark, d), "sharpe", -2.5, 2.5, 20)


_COUNTERS = f"count(*) FILTER (WHERE hit) AS result_cache_hits, count(*) FILTER (WHERE NOT hit) AS result_cache_misses, count(*) FILTER (WHERE NOT hit) AS param_evals, count(DISTINCT ({PLACE})) AS symbols_tested, count(DISTINCT strategy) AS strategies_count"


@query("run_counters", f"{RES} SELECT {_COUNTERS} FROM results")
def run_counters(spark, d):
    return U.run_counters(X.results(spark, d))


@query("run_counters_prom", f"{RES}, c AS (SELECT (max(ordinal) - min(ordinal))::DOUBLE AS run_duration_seconds, count(*) AS results_count, {_COUNTERS} FROM results) " + " UNION ALL ".join(f"SELECT 'quant_{n} ' || {n} AS line FROM c" for n in ["run_duration_seconds", "results_count", *U.COUNTERS]))
def run_counters_prom(spark, d):
    return U.run_metrics_text(X.results(spark, d), F.timestamp_seconds("ordinal"))


_RUNS_SQL = """runs AS (
  SELECT 'run-' || k AS run_id, CASE WHEN k <> 7 THEN 'sharpe' END AS metric, n AS results_count,
         k % 5 = 0 AS has_dashboard, k % 10 = 0 AS has_highlights, k % 3 <> 1 AS has_summary
  FROM (SELECT o_custkey % 12 AS k, count(*) AS n FROM orders GROUP BY 1))"""


def _runs(spark, d):
    k = F.col("k")
    return X.table(spark, d, "orders").groupBy((F.col("o_custkey") % 12).alias("k")).agg(F.count("*").alias("results_count")).select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run_id"),
        F.when(k != 7, "sharpe").alias("metric"),
        "results_count",
        (k % 5 == 0).alias("has_dashboard"),
        (k % 10 == 0).alias("has_highlights"),
        (k % 3 != 1).alias("has_summary"),
    )


@query("runs_history", f"WITH {_RUNS_SQL} SELECT run_id, results_count FROM runs WHERE (has_summary OR has_dashboard) AND run_id <> 'run-3' UNION ALL SELECT 'run-3', 5")
def runs_history(spark, d):
    current = spark.createDataFrame([("run-3", 5)], "run_id string, results_count long")
    return U.runs_history(_runs(spark, d), current)


@query("api_runs_list", f"{RES} SELECT run_id, {_COUNTS} FROM results GROUP BY run_id")
def api_runs_list(spark, d):
    return U.summary_counts(X.results(spark, d), ["run_id"]).orderBy(F.col("run_id").desc())


@query("available_metrics_union", f"{RES}, {_long(['calmar', 'sharpe', 'cagr'])} SELECT metric, row_number() OVER (ORDER BY p, a, metric) AS position FROM (SELECT metric, min(p) AS p, arg_min(a, p) AS a FROM (SELECT 'sharpe' AS metric, 0 AS p, '0' AS a UNION ALL SELECT 'sortino', 0, '1' UNION ALL SELECT DISTINCT name, 1, name FROM long UNION ALL SELECT * FROM (VALUES ('omega', 2, '0'), ('tail_ratio', 2, '1'), ('pain_index', 2, '2'), ('profit', 2, '3'), ('sharpe', 2, '4'))) GROUP BY metric)")
def available_metrics_union(spark, d):
    listed = spark.createDataFrame([("sharpe", 0), ("sortino", 1)], "metric string, position long")
    by_run = U.long_stats(X.results(spark, d), ["calmar", "sharpe", "cagr"], ["run_id"]).select("metric").distinct()
    return U.available_metrics(listed, by_run)


@query("compare_runs", f"{RES}, c AS (SELECT run_id, {_COUNTS} FROM results GROUP BY run_id) SELECT run_id, ordinal, metric_value, n::INTEGER AS row, results, collections, symbols, strategies, timeframes FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM results WHERE run_id IN ('run-0', 'run-2')) JOIN c USING (run_id) WHERE n <= 10")
def compare_runs(spark, d):
    out = U.compare_runs(X.results(spark, d), "run-0, ,run-2,unknown")
    return out.select("run_id", "ordinal", "metric_value", "row", "results", "collections", "symbols", "strategies", "timeframes")


@query("summary_csv_head", f"{RES} SELECT run_id, ordinal, n::INTEGER AS row FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM results) WHERE n <= 5")
def summary_csv_head(spark, d):
    return U.first_rows(X.results(spark, d), "run_id", 5, ["ordinal"]).select("run_id", "ordinal", "row")


_COMPARED = ["sharpe", "omega", "tail_ratio", "pain_index", "profit"]


@query("compare_matrix", f"{_best_sql(_COMPARED, _BY_DIRECTION)} SELECT run_id, " + ", ".join(f"max(value) FILTER (WHERE name = '{m}') AS {m}" for m in _COMPARED) + " FROM best GROUP BY run_id")
def compare_matrix(spark, d):
    return U.compare_matrix(X.results(spark, d))


_STATUS_WITH = f"""{RES}, {_RUNS_SQL}, s AS (
  SELECT r.run_id, r.run_id IN (SELECT run_id FROM results WHERE run_id <> 'run-2') AS stored, r.run_id IN ('run-2', 'run-6', 'run-11') AS in_csv, r.* EXCLUDE (run_id) FROM runs r
), m AS (
  SELECT run_id, CASE WHEN has_dashboard AND NOT has_highlights THEN 'existing_updated' WHEN has_dashboard THEN 'existing' WHEN run_id = 'run-9' THEN 'current_saved'
    WHEN NOT has_summary THEN 'missing_summary' WHEN metric IS NOT NULL AND (stored OR in_csv) THEN 'created' ELSE 'failed' END AS status, CASE WHEN stored THEN 'cache' WHEN in_csv THEN 'csv' END AS src FROM s)"""

_STATUS_COLUMNS = """status, CASE WHEN status = 'created' THEN src END AS source, CASE status WHEN 'missing_summary' THEN 'Summary file missing; unable to rebuild dashboard' WHEN 'failed' THEN 'Unable to rebuild dashboard from summary'
  WHEN 'created' THEN CASE src WHEN 'csv' THEN 'Dashboard regenerated using CSV fallback' ELSE 'Dashboard regenerated from results cache' END END AS message"""


def _status(spark, d):
    stored = X.results(spark, d).filter("run_id != 'run-2'")
    in_csv = spark.createDataFrame([("run-2",), ("run-6",), ("run-11",)], "run_id string")
    return U.run_manifest_status(_runs(spark, d), stored, in_csv, "run-9")


@query("run_manifest_status", f"{_STATUS_WITH} SELECT run_id, {_STATUS_COLUMNS} FROM m")
def run_manifest_status(spark, d):
    return _status(spark, d)


@query("latest_run", f"{_STATUS_WITH} SELECT 'run-3' AS recorded_in, run_id, {_STATUS_COLUMNS} FROM m WHERE run_id IN ('run-3', 'run-7', 'run-11')")
def latest_run(spark, d):
    written = F.concat(F.lit("run-"), (F.substring_index("run_id", "-", -1).cast("int") % 4).cast("string"))
    return U.latest_run_status(_status(spark, d).withColumn("recorded_in", written))


@query("run_manifest_join", f"{_STATUS_WITH} SELECT status, count(*) AS runs FROM m GROUP BY status")
def run_manifest_join(spark, d):
    return _status(spark, d).groupBy("status").agg(F.count("*").alias("runs"))


@query("rebuild_summary", _METRICS_SQL.replace("FROM long GROUP", "FROM long WHERE run_id = 'run-2' GROUP"))
def rebuild_summary(spark, d):
    rows = X.results(spark, d).filter("run_id = 'run-2'")
    return U.summary_metrics(rows, ["run_id"]).withColumn("mean", F.round("mean", 6))


_FAILED = "CASE ordinal % 9 WHEN 0 THEN 'fetch' ELSE 'generate_signals' END AS stage, CASE ordinal % 9 WHEN 0 THEN 'cache | miss' ELSE 'bad window' END AS error"
_SUMMARY_SQL = f"""{RES}, c AS (
  SELECT run_id, min(metric) AS metric, count(*) AS n, max(metric_value) AS best, max(sharpe) FILTER (WHERE NOT isnan(sharpe)) AS best_sharpe, min(ordinal) AS t0, max(ordinal) AS t1, {_COUNTERS},
         count(DISTINCT collection) AS collections, count(DISTINCT symbol) AS symbols, count(DISTINCT strategy) AS strategies, count(DISTINCT timeframe) AS timeframes FROM results GROUP BY run_id
), f AS (
  SELECT run_id, sum(n)::BIGINT AS n, list({{'stage': stage, 'error': error, 'count': n, 'collection': one.collection, 'symbol': one.symbol, 'timeframe': one.timeframe, 'strategy': one.strategy, 'params': one.params}} ORDER BY stage) AS failures
  FROM (SELECT run_id, stage, error, count(*) AS n, arg_min(struct_pack(collection, symbol, timeframe, strategy, params), ordinal) AS one FROM (SELECT *, {_FAILED} FROM results WHERE ordinal % 9 < 2) GROUP BY ALL) GROUP BY run_id
), a AS (
  SELECT run_id, list({{'channel': channel, 'sent': best >= bound, 'reason': CASE WHEN best < bound THEN 'below_threshold' END}} ORDER BY channel) AS notifications
  FROM c, (VALUES ('chat', 2.0), ('mail', 9.0)) v(channel, bound) GROUP BY run_id)
SELECT run_id, to_json({{'run_id': run_id, 'started_at': strftime(make_timestamp(t0 * 1000000), '%Y-%m-%dT%H:%M:%SZ'), 'finished_at': strftime(make_timestamp(t1 * 1000000), '%Y-%m-%dT%H:%M:%SZ'), 'duration_sec': t1 - t0,
  'metric': metric, 'results_count': c.n, 'best': best, 'best_sharpe': best_sharpe,
  'metrics': {{{", ".join(f"'{n}': {n}" for n in U.COUNTERS)}}}, 'dashboard': {{'collections': collections, 'symbols': symbols, 'strategies': strategies, 'timeframes': timeframes}},
  'failures_count': coalesce(f.n, 0), 'failures': coalesce(failures, []), 'notifications': notifications, 'manifest_refresh': [{{'status': 'current_saved', 'message': NULL::VARCHAR}}]}})::VARCHAR AS json
FROM c LEFT JOIN f USING (run_id) JOIN a USING (run_id)"""


@query("run_summary_json", _SUMMARY_SQL)
def run_summary_json(spark, d):
    rows, bad = X.results(spark, d), F.col("ordinal") % 9
    failures = rows.filter(bad < 2).withColumns({"stage": F.when(bad == 0, "fetch").otherwise("generate_signals"), "error": F.when(bad == 0, "cache | miss").otherwise("bad window")})
    best = rows.groupBy("run_id").agg(F.max("metric_value").alias("best"))
    channels = F.inline(F.array(*(F.struct(F.lit(n).alias("channel"), F.lit(t).alias("at")) for n, t in (("chat", 2.0), ("mail", 9.0)))))
    sent = F.col("best") >= F.col("at")
    events = best.select("run_id", "best", channels).select("run_id", "channel", sent.alias("sent"), F.when(~sent, "below_threshold").alias("reason"))
    statuses = best.select("run_id", F.lit("current_saved").alias("status"), F.lit(None).cast("string").alias("message"))
    summary = U.run_summary(rows, failures, events, statuses, F.timestamp_seconds("ordinal"))
    columns = ["run_id", "started_at", "finished_at", "duration_sec", "metric", "results_count", "best", "best_sharpe", "metrics", "dashboard", "failures_count", "failures", "notifications", "manifest_refresh"]
    return S.with_json(summary, columns, "json").select("run_id", "json")


# --- states that merge, sketches


def _states(spark, d):
    """The merged states of runs whose results came in three batches, one of them recorded twice."""
    store = RS.states_store(spark, storage.shared_folder(spark, "states"))
    rows = X.results(spark, d)
    for batch in (0, 1, 2, 1):
        RS.record(store, rows.filter(F.col("ordinal") % 3 == batch), f"batch-{batch}")
    return RS.merged(store.read())


@query("run_state_counts", f"{RES} SELECT run_id, {_COUNTS} FROM results GROUP BY run_id")
def run_state_counts(spark, d):
    """The listing of runs, from states alone."""
    return RS.counts(_states(spark, d))


@query("run_state_metrics", _METRICS_SQL)
def run_state_metrics(spark, d):
    return RS.metric_ranges(_states(spark, d)).withColumn("mean", F.round("mean", 6))


@query("run_state_best", f"{_best_sql(U.METRICS, _BY_DIRECTION)} SELECT run_id, name AS metric, {PLACE}, value FROM best")
def run_state_best(spark, d):
    return RS.best_rows(_states(spark, d))


_G = (1 + K.ERROR) / (1 - K.ERROR)
_VALUE = f"CASE WHEN sg = 0 THEN 0.0 ELSE sg * 2 * power({_G!r}::DOUBLE, sg * b) / ({_G!r}::DOUBLE + 1) END"
_SKETCH_SQL = f"""{RES}, sketch AS (
  SELECT run_id, sg, sg * i AS b, count(*) AS n FROM (
    SELECT run_id, CASE WHEN abs(sharpe) < {K.TINY} THEN 0 ELSE sign(sharpe)::BIGINT END AS sg, CASE WHEN abs(sharpe) < {K.TINY} THEN 0 ELSE ceil(ln(abs(sharpe)) / {math.log(_G)!r}::DOUBLE)::BIGINT END AS i
    FROM results WHERE isfinite(sharpe)) GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY sg, b) AS upto, sum(n) OVER (PARTITION BY run_id) AS total, {_VALUE} AS v FROM sketch
), asked AS (
  SELECT run_id, i, v FROM ranked, (SELECT unnest(range(0, 9)) AS i) WHERE upto > floor(i / 8.0::DOUBLE * (total - 1)) AND upto - n <= floor(i / 8.0::DOUBLE * (total - 1)))"""


@query("metric_quantiles", f"{_SKETCH_SQL} SELECT run_id, round(i / 8.0, 6)::DOUBLE AS share, round(v, 6) AS value FROM asked")
def metric_quantiles(spark, d):
    """Quantiles from sketches of two halves that are merged."""
    rows = X.results(spark, d)
    halves = [K.sketch(rows.filter(F.col("ordinal") % 2 == i), ["run_id"], "sharpe") for i in (0, 1)]
    both = K.merged_sketch(halves[0].unionByName(halves[1]), ["run_id"])
    return K.quantiles(both, ["run_id"], [i / 8 for i in range(9)]).select("run_id", F.round("share", 6).alias("share"), F.round("value", 6).alias("value"))


@query(
    "histogram_from_data",
    f"""{_SKETCH_SQL}, edges AS (SELECT run_id, list(v ORDER BY i) AS e FROM asked GROUP BY run_id),
    placed AS (SELECT run_id, least(len(list_filter(e, lambda x: x <= v)), 8)::INTEGER AS bin, e, n FROM ranked JOIN edges USING (run_id))
    SELECT run_id, bin, round(e[bin], 6) AS low, round(e[bin + 1], 6) AS high, sum(n)::BIGINT AS n FROM placed GROUP BY ALL""",
)
def histogram_from_data(spark, d):
    found = K.histogram(X.results(spark, d), ["run_id"], "sharpe", 8)
    return found.select("run_id", F.col("bin").cast("int").alias("bin"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")

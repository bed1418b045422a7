"""Jobs, grids, guards and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import jobs as J
from ..operators import ranking as R
from ..operators import store, sweeps
from ..operators.positions import evaluate
from ..sources import storage
from . import fixtures as X
from .q_bars import TS_SQL, ts_text
from .base import query


@query(
    "best_per_job",
    f"WITH {X.STATS_SQL} SELECT symbol, combo_id, round(sharpe, 6) AS sharpe, round(omega, 6) AS omega, trades FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, combo_id) AS n FROM stats WHERE isfinite(sharpe)) WHERE n = 1",
)
def best_per_job(spark, d):
    best = R.best_per_job(X.statistics(spark, d), ["symbol"], "sharpe")
    return best.select("symbol", "combo_id", F.round("sharpe", 6).alias("sharpe"), F.round("omega", 6).alias("omega"), "trades")


#: Every pair of a fast and a slow average, with lengths that recur.
SWEEP = [(f, f + s) for f in (3, 5, 8, 12) for s in (5, 15, 40)]


@query(
    "sweep_statistics",
    f"WITH {X.stats_sql(SWEEP)} SELECT symbol, combo_id, trades, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in X.STATS) + " FROM stats",
)
def sweep_statistics(spark, d):
    found = sweeps.sweep_statistics(X.bars_orders(spark, d), sweeps.combos_table(spark, SWEEP), ["symbol"], fee=X.FEE)
    return found.select("symbol", "combo_id", "trades", *(F.round(c, 6).alias(c) for c in X.STATS))


@query(
    "sweep_best",
    f"WITH {X.stats_sql(SWEEP)} SELECT symbol, combo_id, round(sortino, 6) AS sortino, trades FROM stats WHERE isfinite(sortino) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sortino DESC, combo_id) = 1",
)
def sweep_best(spark, d):
    found = sweeps.sweep_statistics(X.bars_orders(spark, d), sweeps.combos_table(spark, SWEEP), ["symbol"], fee=X.FEE)
    return R.best_per_job(found, ["symbol"], "sortino").select("symbol", "combo_id", F.round("sortino", 6).alias("sortino"), "trades")


_COLLECTIONS = "SELECT c_mktsegment AS collection, 'N' || c_nationkey AS symbol FROM customer GROUP BY ALL"


def _symbols(spark, d):
    return X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("collection"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("symbol")).distinct()


@query("job_cross", f"SELECT collection, symbol, timeframe, strategy FROM ({_COLLECTIONS}), (VALUES ('1d'), ('1h')) t(timeframe), (VALUES ('sma'), ('flip')) s(strategy)")
def job_cross(spark, d):
    collections = _symbols(spark, d).groupBy("collection").agg(F.collect_list("symbol").alias("symbols"))
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    return J.job_cross(collections, frame(["1d", "1h"], "timeframe"), frame(["sma", "flip"], "strategy"))


def _grids(spark, d):
    """A grid for each nation: its region's number of options for ``a``, three for ``b``, none in region 4."""
    options = lambda n, step: F.transform(F.sequence(F.lit(1), n), lambda i: (i * step).cast("string"))
    key = F.col("n_regionkey").cast("int")
    grid = F.when(key == 4, F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("b"), options(F.lit(3), 10), F.lit("a"), options(key + 1, 5)))
    return X.table(spark, d, "nation").select(F.col("n_name").alias("strategy"), grid.alias("grid"))


_GRID_SQL = """WITH g AS (SELECT n_name AS strategy, a, b FROM nation, LATERAL (SELECT unnest(range(1, n_regionkey + 2)) AS a), (VALUES (1), (2), (3)) v(b) WHERE n_regionkey < 4)
SELECT strategy, (row_number() OVER (PARTITION BY strategy ORDER BY a, b) - 1)::INTEGER AS grid_ordinal, '{"a":"' || (a * 5) || '","b":"' || (b * 10) || '"}' AS params FROM g
UNION ALL SELECT n_name, 0, '{}' FROM nation WHERE n_regionkey = 4"""


@query("grid_cross", _GRID_SQL)
def grid_cross(spark, d):
    return J.grid_cross(_grids(spark, d)).select("strategy", "grid_ordinal", S.params_json(F.col("params")).alias("params"))


@query("params_json", "SELECT o_orderkey AS ordinal, '{\"fast\":\"' || (o_orderkey % 7) || '\",\"slow\":\"' || (o_orderkey % 11) || '\"}' AS params FROM orders")
def params_json(spark, d):
    k = F.col("o_orderkey")
    fast, slow = (F.lit("fast"), (k % 7).cast("string")), (F.lit("slow"), (k % 11).cast("string"))
    either_order = F.when(k % 2 == 0, F.create_map(*fast, *slow)).otherwise(F.create_map(*slow, *fast))
    return X.table(spark, d, "orders").select(k.alias("ordinal"), S.params_json(either_order).alias("params"))


@query(
    "strategy_override_join",
    """SELECT n_name AS strategy, CASE WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_regionkey = 4 THEN CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END ELSE 2 + CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END END AS n_keys,
       CASE WHEN n_nationkey % 3 = 0 THEN '7' ELSE CASE WHEN n_regionkey < 4 THEN '5' END END AS first_a, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS n_static FROM nation""",
)
def strategy_override_join(spark, d):
    nation = X.table(spark, d, "nation")
    none = F.lit(None).cast("map<string,array<string>>")
    one = lambda k, v: F.create_map(F.lit(k), F.array(F.lit(v)))
    mod = F.col("n_nationkey") % 3
    overrides = nation.filter(mod < 2).select(
        F.col("n_name").alias("strategy"), F.when(mod == 0, one("a", "7")).otherwise(none).alias("override_grid"), one("bias", "0.1").alias("params")
    )
    out = J.strategy_overrides(_grids(spark, d), overrides)
    return out.select("strategy", F.size("grid").alias("n_keys"), F.get(F.col("grid")["a"], F.lit(0)).alias("first_a"), F.size("static_params").alias("n_static"))


@query("search_space_split", "SELECT n_name AS strategy, CASE WHEN n_regionkey = 4 THEN '' WHEN n_regionkey = 0 THEN 'b' ELSE 'a,b' END AS search, CASE WHEN n_regionkey = 0 THEN 'a,stop' ELSE 'stop' END AS fixed FROM nation")
def search_space_split(spark, d):
    lists = F.to_json("grid")
    text = F.concat(F.lit('{"stop":0.1'), F.when(lists != "{}", F.lit(",")).otherwise(""), F.expr("substring(to_json(grid), 2)"))  # a number beside the lists
    search, fixed = J.search_space(J.grid_of_json(text))
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return _grids(spark, d).select("strategy", names(search).alias("search"), names(fixed).alias("fixed"))


@query(
    "min_bars_guard",
    f"WITH {X.BARS_SQL}, n AS (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) SELECT symbol, p AS n_params, p > 0 AND bars < greatest(1700, 900 * p) AS skipped, CASE WHEN p > 0 AND bars < greatest(1700, 900 * p) THEN 'insufficient_bars_for_optimization' END AS reason, greatest(1700, 900 * p)::BIGINT AS min_bars_required, bars AS bars_available FROM n, (VALUES (0), (1), (2)) v(p)",
)
def min_bars_guard(spark, d):
    bars = X.bars_orders(spark, d).groupBy("symbol").agg(F.count("*").alias("bars")).select("symbol", "bars", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n_params"))
    return J.min_bars_guard(bars, 1700, 900).drop("bars")


@query("empty_series_skip", f"WITH {X.BARS_SQL}, s AS (SELECT DISTINCT symbol FROM bars WHERE close_key % 7 < 3), j AS (SELECT DISTINCT symbol FROM bars UNION SELECT 'NONE') SELECT j.symbol FROM j JOIN s USING (symbol)")
def empty_series_skip(spark, d):
    bars = X.bars_orders(spark, d)
    jobs = bars.select("symbol").distinct().unionByName(spark.createDataFrame([("NONE",)], "symbol string"))
    found, _ = B.only_cached(jobs, bars.filter("close_key % 7 < 3"), "symbol")
    return found.select("symbol").distinct()


@query("scan_only_cached", f"WITH {X.BARS_SQL}, j AS (SELECT DISTINCT symbol, t.tf AS timeframe FROM bars, (VALUES ('1d'), ('1h')) t(tf)) SELECT symbol, timeframe, 'cache miss' AS error FROM j WHERE timeframe = '1h'")
def scan_only_cached(spark, d):
    bars = X.bars_orders(spark, d).withColumn("timeframe", F.lit("1d"))
    jobs = bars.select("symbol").distinct().select("symbol", F.explode(F.array(F.lit("1d"), F.lit("1h"))).alias("timeframe"))
    _, missing = B.only_cached(jobs, bars, "symbol", "timeframe")
    return missing.withColumn("error", F.lit("cache miss"))


@query("ingest_report", f"WITH {X.BARS_SQL}, j AS (SELECT DISTINCT symbol, t.tf AS timeframe FROM bars, (VALUES ('1d'), ('1h')) t(tf)), n AS (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) SELECT j.symbol, timeframe, CASE WHEN timeframe = '1d' THEN n.bars ELSE 0 END AS bars, CASE WHEN timeframe = '1d' THEN 'ok' ELSE 'failed' END AS status FROM j JOIN n USING (symbol)")
def ingest_report(spark, d):
    bars = X.bars_orders(spark, d).withColumn("timeframe", F.lit("1d"))
    jobs = bars.select("symbol").distinct().select("symbol", F.explode(F.array(F.lit("1d"), F.lit("1h"))).alias("timeframe"))
    return B.ingest_report(jobs, bars, "symbol", "timeframe")


@query("budgeted_search", f"SELECT strategy, grid_ordinal, params FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY md5('0:' || strategy || ':' || grid_ordinal), grid_ordinal) AS n FROM ({_GRID_SQL})) WHERE n <= 5")
def budgeted_search(spark, d):
    grid = J.budgeted_search(J.grid_cross(_grids(spark, d)), 5)
    return grid.select("strategy", "grid_ordinal", S.params_json(F.col("params")).alias("params"))


def _momentum(frame, params):
    n = int(params["a"])
    if n > 15:
        raise ValueError("window too long")
    moved = frame["close"].diff(n)
    return moved > 0, moved < 0


def _pandas_rows(spark, d):
    bars = X.bars_orders(spark, d)
    grid = spark.createDataFrame([(0, {"a": "5"}), (1, {"a": "15"}), (2, {"a": "20"})], "grid_ordinal int, params map<string,string>")
    return sweeps.pandas_strategy(bars, grid, ["symbol"], _momentum)


_LAG = "(SELECT *, close - lag(close, {n}) OVER (PARTITION BY symbol ORDER BY ts) AS m FROM bars)"
_MOMENTUM_SQL = f"WITH {X.BARS_SQL} " + " UNION ALL ".join(
    f"SELECT symbol, {i} AS grid_ordinal, {TS_SQL}, coalesce(m > 0, false) AS entry, coalesce(m < 0, false) AS exit FROM {_LAG.format(n=n)}" for i, n in ((0, 5), (1, 15))
)


@query("strategy_pandas", _MOMENTUM_SQL)
def strategy_pandas(spark, d):
    return _pandas_rows(spark, d).filter("error is null").select("symbol", "grid_ordinal", ts_text(), "entry", "exit")


@query("strategy_callable", _MOMENTUM_SQL)
def strategy_callable(spark, d):
    class Momentum:
        def generate_signals(self, frame, params):
            moved = frame["close"].diff(int(params["a"]))
            return moved > 0, moved < 0

    grid = spark.createDataFrame([(0, {"a": "5"}), (1, {"a": "15"})], "grid_ordinal int, params map<string,string>")
    return sweeps.pandas_strategy(X.bars_orders(spark, d), grid, ["symbol"], Momentum()).select("symbol", "grid_ordinal", ts_text(), "entry", "exit")


@query("strategy_error_capture", f"WITH {X.BARS_SQL} SELECT symbol, 2 AS grid_ordinal, 'generate_signals' AS stage, 'ValueError: window too long' AS error, count(*) AS bars FROM bars GROUP BY symbol")
def strategy_error_capture(spark, d):
    failed = _pandas_rows(spark, d).filter("error is not null")
    return failed.groupBy("symbol", "grid_ordinal", F.lit("generate_signals").alias("stage"), "error").agg(F.count("*").alias("bars"))


@query("finite_metric_filter", f"WITH {X.RESULTS_SQL} SELECT ordinal, sharpe FROM results WHERE isfinite(sharpe)")
def finite_metric_filter(spark, d):
    return X.results(spark, d).filter(S.finite("sharpe").isNotNull()).select("ordinal", "sharpe")


CACHE_KEYS = ["collection", "symbol", "timeframe", "strategy", "ordinal"]


@query("cache_lookup", f"WITH {X.RESULTS_SQL}, s AS (SELECT * FROM results WHERE ordinal % 3 = 0) SELECT r.ordinal, s.metric_value AS stored_value, s.ordinal IS NOT NULL AS hit FROM results r LEFT JOIN s USING (ordinal)")
def cache_lookup(spark, d):
    """Looked up in a stored table, of which the candidates' buckets are opened."""
    rows = X.results(spark, d)
    stored = store.results_store(spark, storage.shared_folder(spark, "results"), CACHE_KEYS)
    stored.upsert(rows.filter("ordinal % 3 = 0").select(*CACHE_KEYS, "run_id", "metric_value"), "metric_value")
    return stored.lookup(rows.select(*CACHE_KEYS), "metric_value").select("ordinal", "stored_value", "hit")


@query("cache_miss_antijoin", f"WITH {X.RESULTS_SQL} SELECT ordinal, collection, symbol FROM results WHERE ordinal % 3 <> 0")
def cache_miss_antijoin(spark, d):
    rows = X.results(spark, d)
    return store.cache_misses(rows.select(*CACHE_KEYS), rows.filter("ordinal % 3 = 0"), CACHE_KEYS).select("ordinal", "collection", "symbol")


@query(
    "cache_upsert",
    f"WITH {X.RESULTS_SQL}, u AS (SELECT collection, symbol, timeframe, strategy, run_id, metric_value, ordinal, (ordinal % 2)::INTEGER AS batch FROM results) SELECT collection, symbol, timeframe, strategy, run_id, metric_value, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY collection, symbol, timeframe, strategy ORDER BY batch DESC, ordinal DESC) AS n FROM u) WHERE n = 1",
)
def cache_upsert(spark, d):
    """Two writes to a stored table, then its newest snapshot."""
    rows = X.results(spark, d).select("collection", "symbol", "timeframe", "strategy", "run_id", "metric_value", "ordinal")
    stored = store.results_store(spark, storage.shared_folder(spark, "results"), store.LIST_ORDER)
    for batch in (0, 1):
        stored.upsert(rows.filter(F.col("ordinal") % 2 == batch), "ordinal")
    return stored.read()


@query("list_by_run", f"WITH {X.RESULTS_SQL} SELECT collection, symbol, timeframe, strategy, ordinal, metric_value FROM results WHERE run_id = 'run-1'")
def list_by_run(spark, d):
    return store.list_by_run(X.results(spark, d), "run-1").select("collection", "symbol", "timeframe", "strategy", "ordinal", "metric_value")


@query(
    "timeframe_bars_per_year",
    """WITH t AS (SELECT o_orderkey, (o_orderkey % 24 + 1) || ['d', 'h', 'm', 'w', 's', 'wk', 'mo', 'M', ''][(o_orderkey // 24 % 9)::INTEGER + 1] AS tf FROM orders),
    p AS (SELECT tf, CAST(regexp_extract(tf, '^[0-9]+') AS INTEGER) AS v, CASE lower(regexp_replace(tf, '[0-9]', '', 'g')) WHEN 'd' THEN 252 WHEN '' THEN 252 WHEN 'w' THEN 52 WHEN 'h' THEN 8760 WHEN 'm' THEN 525600 WHEN 's' THEN 31536000 END AS n FROM t)
    SELECT tf AS timeframe, CASE WHEN n IS NULL THEN 252 ELSE greatest(1, round_even(n / v, 0)::INTEGER) END AS bars, count(*) AS n_rows FROM p GROUP BY ALL""",
)
def timeframe_bars_per_year(spark, d):
    units = F.array(*map(F.lit, ("d", "h", "m", "w", "s", "wk", "mo", "M", "")))
    k = F.col("o_orderkey")
    tf = F.concat((k % 24 + 1).cast("string"), F.get(units, (F.floor(k / 24) % 9).cast("int")))
    return X.table(spark, d, "orders").select(tf.alias("timeframe")).groupBy("timeframe").agg(F.count("*").alias("n_rows")).select("timeframe", S.bars_per_year(F.col("timeframe")).alias("bars"), "n_rows")


@query(
    "fees_slippage",
    """WITH s AS (SELECT o_orderkey AS ordinal, ['binance', 'Bybit', 'ccxt', 'polygon', 'yfinance'][(o_orderkey % 5)::INTEGER + 1] AS source, CASE WHEN o_orderkey % 3 = 0 THEN 0.002 END AS f, CASE WHEN o_orderkey % 4 = 0 THEN 0.003 END AS sl FROM orders)
    SELECT ordinal, (CASE WHEN f IS NOT NULL OR sl IS NOT NULL THEN coalesce(f, 0.001) WHEN lower(source) IN ('binance', 'bybit', 'ccxt') THEN 0.0006 ELSE 0.0005 END)::DOUBLE AS fees, (CASE WHEN f IS NOT NULL OR sl IS NOT NULL THEN coalesce(sl, 0.0007) ELSE 0.0005 END)::DOUBLE AS slippage FROM s""",
)
def fees_slippage(spark, d):
    k = F.col("o_orderkey")
    source = F.get(F.array(*map(F.lit, ("binance", "Bybit", "ccxt", "polygon", "yfinance"))), (k % 5).cast("int"))
    both = S.fees_slippage(source, F.when(k % 3 == 0, F.lit(0.002)), F.when(k % 4 == 0, F.lit(0.003)), 0.001, 0.0007)
    return X.table(spark, d, "orders").select(k.alias("ordinal"), both.alias("x")).select("ordinal", "x.fees", "x.slippage")


@query("fractional_flag", f"WITH {X.TICKERS_SQL}, s AS (SELECT exchange, replace(symbol, '/', CASE WHEN exchange = 'A' THEN '' ELSE '/' END) AS symbol FROM tickers) SELECT exchange, symbol, (exchange = 'R') OR contains(symbol, '/') OR symbol LIKE '%USDT' AS fractional FROM s")
def fractional_flag(spark, d):
    plain = F.when(F.col("exchange") == "A", F.replace("symbol", F.lit("/"), F.lit(""))).otherwise(F.col("symbol"))
    rows = X.tickers(spark, d).select("exchange", plain.alias("symbol"))
    source = F.when(F.col("exchange") == "R", "binance").otherwise("polygon")
    return rows.select("exchange", "symbol", S.fractional(source, F.col("symbol")).alias("fractional"))


@query("is_positive", f"WITH {X.RESULTS_SQL} SELECT ordinal, coalesce(NOT isnan(sharpe) AND sharpe > 0, false) AS positive FROM results")
def is_positive(spark, d):
    return X.results(spark, d).select("ordinal", S.is_positive("sharpe").alias("positive"))


def flip_evaluated(spark, d):
    return evaluate(X.signals_flip(spark, d), X.KEYS, X.FEE, fill_delay=0)

"""Rankings, exports, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import symbols as Y
from ..operators import ranking as R
from ..operators import summary as U
from ..operators import universe as V
from . import fixtures as X
from .base import query

PLACE = "collection, symbol, timeframe, strategy"
RES = f"WITH {X.RESULTS_SQL}"


def _ranked_sql(keys: str, where: str, extra: str = "") -> str:
    return f"{RES} SELECT {PLACE}, ordinal, metric_value{extra} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY metric_value DESC, ordinal) AS n FROM results) WHERE {where}"


def _row(df):
    return df.select("collection", "symbol", "timeframe", "strategy", "ordinal", "metric_value")


@query("best_per_symbol", _ranked_sql("collection, symbol", "n = 1 AND metric_value > 0"))
def best_per_symbol(spark, d):
    return _row(R.best_positive(X.results(spark, d), ["collection", "symbol"])).orderBy("collection", "symbol")


@query("best_per_symbol_timeframe", _ranked_sql("collection, symbol, timeframe", "n = 1 AND metric_value > 0"))
def best_per_symbol_timeframe(spark, d):
    return _row(R.best_positive(X.results(spark, d), ["collection", "symbol", "timeframe"]))


@query("top_n_per_symbol", _ranked_sql("collection, symbol", "n <= 3", ", n::INTEGER AS rank"))
def top_n_per_symbol(spark, d):
    return R.top_by(X.results(spark, d), ["collection", "symbol"], n=3).select("collection", "symbol", "timeframe", "strategy", "ordinal", "metric_value", "rank")


@query("top_n_overall", f"{RES} SELECT {PLACE}, ordinal, metric_value FROM results ORDER BY metric_value DESC, ordinal LIMIT 5")
def top_n_overall(spark, d):
    return _row(R.top_overall(X.results(spark, d)))


@query("best_per_strategy", _ranked_sql("collection, strategy", "n = 1"))
def best_per_strategy(spark, d):
    return _row(R.best_per_strategy(X.results(spark, d)))


@query("results_sorted", f"{RES} SELECT ordinal, omega FROM results")
def results_sorted(spark, d):
    rows = X.results(spark, d).select("ordinal", F.col("omega").alias("metric_value"))
    return R.results_sorted(rows).withColumnRenamed("metric_value", "omega")


@query("best_columns_project", f"{RES} SELECT {PLACE}, params, metric, metric_value FROM results")
def best_columns_project(spark, d):
    stored = X.results(spark, d).withColumnRenamed("metric", "metric_name")
    return stored.select("collection", "symbol", "timeframe", "strategy", "params", F.col("metric_name").alias("metric"), "metric_value")


@query("chart_points", f"{RES} SELECT {PLACE}, metric, metric_value, sharpe FROM results WHERE NOT isnan(sharpe) AND metric_value IS NOT NULL")
def chart_points(spark, d):
    kept = X.results(spark, d).filter(S.not_nan("metric_value").isNotNull() & S.not_nan("sharpe").isNotNull())
    return kept.select("collection", "symbol", "timeframe", "strategy", "metric", "metric_value", "sharpe")


@query("scatter_points", f"{RES} SELECT ordinal, omega AS x, tail_ratio AS y, CASE WHEN isfinite(sharpe) THEN sharpe ELSE 0.0 END AS color FROM results WHERE omega IS NOT NULL AND tail_ratio IS NOT NULL")
def scatter_points(spark, d):
    rows = X.results(spark, d).select("ordinal", S.finite("omega").alias("x"), S.finite("tail_ratio").alias("y"), F.coalesce(S.finite("sharpe"), F.lit(0.0)).alias("color"))
    return rows.filter("x is not null and y is not null")


@query("search_filter", f"{RES} SELECT ordinal FROM results WHERE contains(lower(concat_ws(' ', collection, symbol, timeframe, strategy, metric)), 'auto')")
def search_filter(spark, d):
    text = S.search_text("collection", "symbol", "timeframe", "strategy", "metric")
    return X.results(spark, d).filter(text.contains("  AUTO ".strip().lower())).select("ordinal")


_SIX = ("sharpe", "sortino", "omega", "tail_ratio", "profit", "pain_index")


def _text6(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 'nan' ELSE printf('%.6f', {c}) END AS {c}"


@query("results_csv_sink", f"{RES} SELECT {PLACE}, metric, params, coalesce(trades, 0)::BIGINT AS trades, {', '.join(map(_text6, ('metric_value', *_SIX, 'max_drawdown')))} FROM results")
def results_csv_sink(spark, d):
    return R.csv_rows(X.results(spark, d), list(_SIX))


@query("format_6f", f"{RES} SELECT ordinal, {_text6('omega')} FROM results")
def format_6f(spark, d):
    return X.results(spark, d).select("ordinal", S.format_6f("omega").alias("omega"))


_QUARTERS = "floor({0} * 4) / 4"


@query(
    "json_sanitize",
    f"""{RES} SELECT ordinal, to_json({{'stats': {{'sharpe': CASE WHEN isfinite(sharpe) THEN {_QUARTERS.format("sharpe")} END, 'strategy': strategy}},
    'values': [CASE WHEN ordinal % 5 <> 0 THEN {_QUARTERS.format("sortino")} END, {_QUARTERS.format("profit")}], 'by': {{'omega': {_QUARTERS.format("omega")}}}}})::VARCHAR AS json
    FROM (SELECT * REPLACE (CASE WHEN isnan(sharpe) THEN NULL ELSE sharpe END AS sharpe) FROM results)""",
)
def json_sanitize(spark, d):
    quarters = lambda c: F.floor(F.col(c) * 4) / 4
    sharpe = F.when(F.isnan("sharpe"), F.col("sharpe")).otherwise(quarters("sharpe"))
    sortino = F.when(F.col("ordinal") % 5 == 0, F.lit(float("-inf"))).otherwise(quarters("sortino"))
    rows = X.results(spark, d).select(
        "ordinal",
        F.struct(sharpe.alias("sharpe"), "strategy").alias("stats"),
        F.array(sortino, quarters("profit")).alias("values"),
        F.create_map(F.lit("omega"), quarters("omega")).alias("by"),
    )
    return S.with_json(rows, ["stats", "values", "by"], "json").select("ordinal", "json")


@query("json_parse", f"{RES} SELECT ordinal, CAST(json_extract_string(params, '$.fast') AS INTEGER) AS fast FROM results")
def json_parse(spark, d):
    parsed = F.from_json("params", "map<string,string>")
    return X.results(spark, d).select("ordinal", parsed["fast"].cast("int").alias("fast"))


@query("lenient_double", f"{RES} SELECT ordinal, TRY_CAST(CASE WHEN ordinal % 4 = 0 THEN 'n/a' ELSE printf('%.5f', metric_value) END AS DOUBLE) AS value FROM results")
def lenient_double(spark, d):
    text = F.when(F.col("ordinal") % 4 == 0, "n/a").otherwise(F.format_string("%.5f", "metric_value"))
    return X.results(spark, d).select("ordinal", S.lenient_double(text).alias("value"))


@query("run_id_format", "SELECT o_orderkey AS ordinal, strftime(o_orderdate, '%Y%m%d-%H%M%S') AS run_id FROM orders")
def run_id_format(spark, d):
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), S.run_id_of("o_orderdate").alias("run_id"))


@query(
    "alert_message",
    f"""{RES} SELECT collection, symbol, timeframe, '🚨 QUANT SIGNAL: ' || symbol || ' 📊' || chr(10) || 'Strategy: ' || strategy || chr(10) || 'Timeframe: ' || timeframe || chr(10)
    || '📈 Sharpe: ' || CASE WHEN isnan(sharpe) THEN 'NaN' ELSE printf('%.3f', round(sharpe, 3)) END || chr(10) || '📊 Sortino: ' || printf('%.3f', round(sortino, 3)) || chr(10) || '⚖️ Calmar: ' || coalesce(printf('%.3f', round(calmar, 3)), 'N/A') || chr(10) || chr(10)
    || 'Price: {{close}}' || chr(10) || 'Time: {{timenow}}' || chr(10) || 'Action: {{strategy.order.action}}' || chr(10) || 'Qty: {{strategy.order.contracts}}' || chr(10) || chr(10) || '#QuantTrading #' || symbol || ' #' || strategy AS message
    FROM (SELECT *, row_number() OVER (PARTITION BY collection, symbol, timeframe ORDER BY metric_value DESC, ordinal) AS n FROM results) WHERE n = 1 AND metric_value > 0""".replace("{{", "{").replace("}}", "}"),
)
def alert_message(spark, d):
    best = R.best_positive(X.results(spark, d), ["collection", "symbol", "timeframe"])
    return best.select("collection", "symbol", "timeframe", R.alert_message().alias("message"))


@query("threshold_alert", f"{RES}, b AS (SELECT * FROM results ORDER BY metric_value DESC, ordinal LIMIT 1) SELECT 'Sharpe' AS metric, {PLACE}, metric_value AS value, 'below_threshold' AS reason FROM b")
def threshold_alert(spark, d):
    return R.threshold_alert(X.results(spark, d), "Sharpe", 3.0)


# --- set operations and failures


@query(
    "failures_union",
    f"{RES} SELECT ordinal, collection, symbol, 'cache | miss' AS error, NULL::VARCHAR AS params, NULL::VARCHAR AS stage FROM results WHERE ordinal % 9 = 0 UNION ALL SELECT ordinal, collection, symbol, 'bad window', params, 'generate_signals' FROM results WHERE ordinal % 9 = 1",
)
def failures_union(spark, d):
    rows = X.results(spark, d)
    fetch = rows.filter("ordinal % 9 = 0").select("ordinal", "collection", "symbol", F.lit("cache | miss").alias("error"))
    signal = rows.filter("ordinal % 9 = 1").select("ordinal", "collection", "symbol", "params", F.lit("generate_signals").alias("stage"), F.lit("bad window").alias("error"))
    return fetch.unionByName(signal, allowMissingColumns=True)


@query("health_failures", f"{RES} SELECT ordinal, collection, symbol, CASE WHEN ordinal % 9 = 0 THEN 'cache   miss' ELSE 'bad window' END AS error, count(*) OVER () AS failures FROM results WHERE ordinal % 9 < 2")
def health_failures(spark, d):
    return U.health_failures(failures_union(spark, d).select("ordinal", "collection", "symbol", "error"))


@query("best_fallback", f"{RES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, collection ORDER BY metric_value DESC, ordinal) AS n FROM results) WHERE n = 1) SELECT run_id, collection, ordinal FROM results WHERE run_id IN ('run-0', 'run-1') UNION ALL SELECT run_id, collection, ordinal FROM best WHERE run_id NOT IN ('run-0', 'run-1')")
def best_fallback(spark, d):
    rows = X.results(spark, d)
    stored = rows.filter(F.col("run_id").isin("run-0", "run-1"))
    best = R.top_by(rows, ["run_id", "collection"])
    columns = ["run_id", "collection", "ordinal"]
    return stored.select(columns).unionByName(best.join(stored.select("run_id").distinct(), "run_id", "left_anti").select(columns))


# --- universe

TIC = f"WITH {X.TICKERS_SQL}"


@query("universe_union", f"{TIC} SELECT exchange, symbol, volume FROM tickers")
def universe_union(spark, d):
    return X.tickers(spark, d).filter(F.col("exchange").isin("A", "N", "R"))  # one scan


_VOLUMES = "SELECT l_returnflag AS exchange, p_brand AS symbol, sum(l_extendedprice) FILTER (WHERE l_quantity > 45) AS quote_volume, sum(l_quantity) FILTER (WHERE l_discount > 0.02) AS base_volume, p_brand < 'Brand#3' AS has_quote FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


@query("ticker_volume", f"SELECT exchange, symbol, round(CASE WHEN has_quote THEN coalesce(quote_volume, 0) ELSE coalesce(base_volume, 0) END, 4) AS volume FROM ({_VOLUMES})")
def ticker_volume(spark, d):
    li, p = X.table(spark, d, "lineitem"), X.table(spark, d, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_returnflag").alias("exchange"), F.col("p_brand").alias("symbol")).agg(
        F.sum(F.when(F.col("l_quantity") > 45, F.col("l_extendedprice"))).alias("quote_volume"), F.sum(F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))).alias("base_volume")
    )
    rows = rows.withColumn("has_quote", F.col("symbol") < "Brand#3")
    return rows.select("exchange", "symbol", F.round(V.volume_of("quote_volume", "base_volume", "has_quote"), 4).alias("volume"))


_MERGED = "merged AS (SELECT symbol, exchange, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, exchange DESC) AS n FROM tickers) WHERE n = 1)"


@query("universe_merge", f"{TIC}, {_MERGED} SELECT symbol, exchange, volume FROM merged")
def universe_merge(spark, d):
    return V.universe_merge(X.tickers(spark, d), ["R", "N", "A"])


@query("exclude_symbols", f"{TIC} SELECT exchange, symbol, volume FROM tickers WHERE symbol <> 'Brand#11/USD' AND NOT regexp_matches(symbol, '^Brand#2./USDT$') AND NOT regexp_matches(symbol, '^Brand#[34]5.*$')")
def exclude_symbols(spark, d):
    return V.exclude_symbols(X.tickers(spark, d), ["Brand#11/USD"], ["Brand#2?/USDT", "Brand#[34]5*"])


@query("universe_top_n", f"{TIC}, {_MERGED} SELECT symbol, exchange, volume FROM merged ORDER BY volume DESC, symbol LIMIT 10")
def universe_top_n(spark, d):
    return V.universe_top_n(universe_merge(spark, d), 10)


@query("extras_antijoin", f"{TIC}, {_MERGED}, top AS (SELECT * FROM merged ORDER BY volume DESC, symbol LIMIT 10) SELECT symbol, exchange, volume FROM top UNION ALL SELECT 'MANUAL/USDT', 'manual', 0.0")
def extras_antijoin(spark, d):
    return V.add_extras(universe_top_n(spark, d), ["MANUAL/USDT", "MANUAL/USDT"])


@query(
    "discover_top_volume",
    f"{TIC}, both_ AS (SELECT exchange, symbol, volume FROM tickers WHERE exchange <> 'R' AND upper(split_part(symbol, '/', 2)) = 'USDT' AND volume >= 100 UNION ALL SELECT exchange, symbol, 0.0 FROM tickers WHERE exchange = 'R' AND symbol LIKE '%/USDT') SELECT exchange, symbol, volume FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY volume DESC, symbol) AS n FROM both_) WHERE n <= 8",
)
def discover_top_volume(spark, d):
    rows = X.tickers(spark, d)
    markets = rows.select("exchange", "symbol", F.lit(None).cast("boolean").alias("active"), F.lit(True).alias("spot"), F.split("symbol", "/")[1].alias("quote"))
    found = V.discover_top_volume(rows.filter("exchange != 'R'"), markets, "usdt", 8, 100.0)
    return found.select("exchange", "symbol", "volume")


# --- symbol and timeframe mapping: names made from the table of nations and parts

_NAMES_SQL = """names AS (
  SELECT upper(substr(n_name, 1, 3)) || ['USD', '/EUR', 'USDT', '/USDT', '-B', '=F', '.B', ''][u] AS s FROM nation, (SELECT unnest(range(1, 9)) AS u)
  UNION ALL SELECT unnest(['BRK.B', 'spx', 'GC', 'zw', '^GSPC', 'btcusd', 'FTSE']))"""


def _names(spark, d):
    ends = F.explode(F.array(*map(F.lit, ("USD", "/EUR", "USDT", "/USDT", "-B", "=F", ".B", "")))).alias("e")
    nation = X.table(spark, d, "nation").select(F.upper(F.substring("n_name", 1, 3)).alias("n"), ends).select(F.concat("n", "e").alias("s"))
    return nation.unionByName(spark.createDataFrame([(s,) for s in ("BRK.B", "spx", "GC", "zw", "^GSPC", "btcusd", "FTSE")], "s string"))


def _mapped(name: str, provider: str, expression: str) -> None:
    @query(name, f"WITH {_NAMES_SQL} SELECT s AS symbol, {expression} AS mapped FROM names")
    def run(spark, d):
        return _names(spark, d).select(F.col("s").alias("symbol"), Y.map_symbol(provider, F.col("s")).alias("mapped"))


_FUTURES_SQL = ", ".join(f"'{r}'" for r in Y.FUTURES)
_CASES = "".join(f" WHEN upper(s) = '{k}' THEN '{v}'" for k, v in (Y.SHARE_CLASSES | Y.INDICES).items())
_mapped("map_symbol_yahoo", "yfinance", f"CASE{_CASES} WHEN regexp_full_match(s, '[A-Z]{{6}}') THEN s || '=X' WHEN regexp_full_match(s, '[A-Z]{{3}}/[A-Z]{{3}}') THEN replace(s, '/', '') || '=X' WHEN upper(s) IN ({_FUTURES_SQL}) THEN s || '=F' WHEN regexp_full_match(upper(s), '[A-Z]{{2,6}}USDT?') THEN regexp_replace(upper(s), 'USDT?$', '') || '-USD' WHEN regexp_matches(upper(s), '/USDT?$') THEN split_part(upper(s), '/', 1) || '-USD' ELSE s END")
_mapped("map_symbol_finnhub", "finnhub", r"regexp_replace(upper(s), '^([A-Z]{3})/?([A-Z]{3})$', 'OANDA:\1_\2')")
_mapped("map_symbol_twelvedata", "twelvedata", r"regexp_replace(upper(s), '^([A-Z]{3})([A-Z]{3})$', '\1/\2')")
_mapped("strip_yahoo_decoration", "polygon", r"regexp_replace(regexp_replace(regexp_replace(s, '^\^', ''), '(=F|=X)$', ''), '^([A-Z]{1,5})-([A-Z])$', '\1.\2')")
_mapped("map_symbol_alphavantage", "alphavantage", "trim(s)")


@query("alpaca_crypto_symbol", f"WITH {_NAMES_SQL}, u AS (SELECT s, replace(upper(s), 'USDT', 'USD') AS x FROM names) SELECT s AS symbol, contains(upper(s), '/') OR upper(s) LIKE '%USD' OR upper(s) LIKE '%USDT' AS is_crypto, CASE WHEN contains(x, '/') THEN x ELSE regexp_replace(x, 'USD$', '/USD') END AS mapped, regexp_full_match(upper(replace(s, '/', '')), '[A-Z]{{6}}') AS is_fx FROM u")
def alpaca_crypto_symbol(spark, d):
    s = F.col("s")
    return _names(spark, d).select(s.alias("symbol"), Y.alpaca_is_crypto(s).alias("is_crypto"), Y.alpaca_crypto(s).alias("mapped"), Y.is_fx(s).alias("is_fx"))


_TF_SQL = """tfs AS (SELECT DISTINCT (o_orderkey % 60 + 1) || ['m', 'h', 'd', 'w', 'M'][(o_orderkey % 5)::INTEGER + 1] AS tf FROM orders)"""


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key}" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_N = "regexp_extract(lower(tf), '^[0-9]+')"
_VENDOR_SQL = {
    "alpaca": f"CASE WHEN lower(tf) LIKE '%d' THEN '1Day' WHEN lower(tf) LIKE '%m' THEN {_N} || 'Min' WHEN lower(tf) LIKE '%h' THEN {_N} || 'Hour' END",
    "polygon": f"CASE WHEN lower(tf) LIKE '%m' THEN {_N} || ' minute' WHEN lower(tf) LIKE '%h' THEN {_N} || ' hour' WHEN lower(tf) LIKE '%d' THEN {_N} || ' day' END",
    "tiingo": f"CASE WHEN lower(tf) LIKE '%d' THEN 'daily' WHEN lower(tf) LIKE '%m' THEN {_N} || 'min' WHEN lower(tf) LIKE '%h' THEN (CAST({_N} AS INTEGER) * 60) || 'min' END",
    "finnhub": _case(Y.TIMEFRAMES["finnhub"], "lower(tf)"),
    "twelvedata": _case(Y.TIMEFRAMES["twelvedata"], "lower(tf)"),
    "yahoo": _case(Y.TIMEFRAMES["yahoo"], "lower(tf)"),
    "ccxt": _case(Y.TIMEFRAMES["ccxt"], "tf"),
}


@query("vendor_timeframes", f"WITH {_TF_SQL} SELECT tf AS timeframe, " + ", ".join(f"{sql} AS {v}" for v, sql in _VENDOR_SQL.items()) + " FROM tfs")
def vendor_timeframes(spark, d):
    k = F.col("o_orderkey")
    tf = F.concat((k % 60 + 1).cast("string"), F.get(F.array(*map(F.lit, ("m", "h", "d", "w", "M"))), (k % 5).cast("int")))
    rows = X.table(spark, d, "orders").select(tf.alias("timeframe")).distinct()
    return rows.select("timeframe", *(Y.vendor_timeframe(v, F.col("timeframe")).alias(v) for v in _VENDOR_SQL))


# --- groups of scalar functions


@query(
    "fn_text",
    f"""{TIC} SELECT exchange, symbol, split_part(symbol, '/', 1) AS base, upper(split_part(symbol, '/', 2)) AS quote, trim('  ' || lower(symbol) || ' ') AS low,
    symbol LIKE '%USDT' AS is_usdt, replace(symbol, '/', '-') AS dashed, symbol GLOB 'Brand#[1-3]*/USD' AS matched FROM tickers""",
)
def fn_text(spark, d):
    pair = F.split("symbol", "/")
    return X.tickers(spark, d).select(
        "exchange", "symbol", F.get(pair, 0).alias("base"), F.upper(F.get(pair, 1)).alias("quote"), F.trim(F.concat(F.lit("  "), F.lower("symbol"), F.lit(" "))).alias("low"),
        F.col("symbol").endswith("USDT").alias("is_usdt"), F.replace("symbol", F.lit("/"), F.lit("-")).alias("dashed"), F.col("symbol").rlike(V.glob_regex("Brand#[1-3]*/USD")).alias("matched"),
    )


@query(
    "fn_math",
    f"""{RES} SELECT ordinal, round(sqrt(abs(metric_value)), 6) AS root, round(power(abs(metric_value), 1.5), 6) AS powered, round_even(ordinal / 4.0, 0)::BIGINT AS half_even,
    abs(metric_value - round(metric_value, 8)) <= 1e-8 AS close, isnan(sharpe) AS missing, isfinite(sharpe) AS finite, greatest(metric_value, omega) AS larger, least(metric_value, tail_ratio) AS smaller FROM results""",
)
def fn_math(spark, d):
    m = F.col("metric_value")
    return X.results(spark, d).select(
        "ordinal", F.round(F.sqrt(F.abs(m)), 6).alias("root"), F.round(F.power(F.abs(m), F.lit(1.5)), 6).alias("powered"), F.bround(F.col("ordinal") / 4, 0).cast("long").alias("half_even"),
        S.close_to_zero(m - F.round(m, 8)).alias("close"), F.isnan("sharpe").alias("missing"), S.finite("sharpe").isNotNull().alias("finite"), F.greatest(m, F.col("omega")).alias("larger"), F.least(m, F.col("tail_ratio")).alias("smaller"),
    )


_PER_USER = """e AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(round(value, 4) ORDER BY event_id) AS vals FROM events WHERE event_id % 5 = 0 GROUP BY user_id)"""


@query(
    "fn_array",
    f"""WITH {_PER_USER} SELECT user_id, ids[1:3] AS head, list_filter(ids, lambda x, i: (i - 1) % greatest(1, len(ids) // 4) = 0) AS sampled, list_transform(list_zip(ids[1:2], vals[1:2]), lambda z: z[1] || ':' || z[2]) AS zipped, list_contains(ids, 25) AS has_25 FROM e""",
)
def fn_array(spark, d):
    rows = X.table(spark, d, "events").filter("event_id % 5 = 0").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("value", 4).alias("v")))).alias("e"))
    ids, step = F.col("e.event_id"), F.greatest(F.lit(1), F.floor(F.size("e") / 4)).cast("int")
    pairs = F.arrays_zip(F.slice(ids, 1, 2).alias("i"), F.slice(F.col("e.v"), 1, 2).alias("v"))
    return rows.select(
        "user_id", F.slice(ids, 1, 3).alias("head"), F.filter(ids, lambda x, i: F.pmod(i, step) == 0).alias("sampled"),
        F.transform(pairs, lambda p: F.concat_ws(":", p["i"].cast("string"), p["v"].cast("string"))).alias("zipped"), F.array_contains(ids, 25).alias("has_25"),
    )


@query(
    "fn_map",
    """SELECT n_nationkey AS id, '{"a":"' || (n_nationkey % 3) || '","b":"right","c":"' || n_name || '"}' AS merged, '{"c":"' || n_name || '"}' AS kept, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'none') AS looked_up FROM nation""",
)
def fn_map(spark, d):
    name, k = F.col("n_name"), F.col("n_nationkey")
    left = F.create_map(F.lit("c"), name, F.lit("b"), F.lit("left"))
    right = F.create_map(F.lit("b"), F.lit("right"), F.lit("a"), (k % 3).cast("string"))
    merged = F.map_concat(F.map_filter(left, lambda key, _: ~F.map_contains_key(right, key)), right)
    some = F.when(k % 2 == 0, F.create_map(F.lit("n"), name)).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(merged, lambda key, _: key.isin("c", "z"))
    return X.table(spark, d, "nation").select(k.alias("id"), S.params_json(merged).alias("merged"), S.params_json(kept).alias("kept"), F.coalesce(F.try_element_at(some, F.lit("n")), F.lit("none")).alias("looked_up"))

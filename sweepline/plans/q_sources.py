"""Vendor payloads, made from bars and read back; file scans and sinks."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators.bars import ticks_to_bars
from ..sources import payloads as L
from ..sources import inventory, storage
from . import fixtures as X
from .q_bars import OHLCV, TS_SQL, ts_text, r6, r6_sql
from .base import query

BACK_SQL = f"WITH {X.BARS_SQL} SELECT symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM bars"


def _seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def _back(df):
    return df.select("symbol", ts_text(), *r6(*OHLCV))


def _bars(spark, d):
    return X.bars_orders(spark, d)


def _list(*columns):
    """All bars of a symbol in order, as one array."""
    return F.array_sort(F.collect_list(F.struct("ts", *columns)))


def _iso(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _short(*names):
    return [F.col(c).alias(c[0]) for c in names]


def payload_yahoo(spark, d):
    g = _bars(spark, d).withColumn("t", _seconds()).groupBy("symbol").agg(_list("t", *OHLCV).alias("b"))
    quote = F.struct(*(F.col(f"b.{c}").alias(c) for c in OHLCV))
    result = F.struct(F.col("b.t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return g.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


@query("norm_yahoo_chart", BACK_SQL)
def norm_yahoo_chart(spark, d):
    return _back(L.norm_yahoo_chart(payload_yahoo(spark, d)))


@query("norm_yahoo_history", BACK_SQL)
def norm_yahoo_history(spark, d):
    frame = _bars(spark, d).select(F.col("symbol").alias("Symbol"), F.col("ts").alias("Date"), F.col("open").alias("Open X"), F.col("high").alias("High X"), F.col("low").alias("Low X"), F.col("close").alias("Close X"), F.col("volume").alias("Volume X"))
    return _back(L.norm_yahoo_history(frame, "Date"))


def payload_alpaca(spark, d):
    g = _bars(spark, d).withColumn("t", _iso()).select("symbol", "ts", "t", *_short(*OHLCV)).groupBy("symbol").agg(_list("t", *"ohlcv").alias("b"))
    bars = F.transform("b", lambda x: F.struct(*(x[c].alias(c) for c in "tohlcv")))
    return g.select("symbol", F.to_json(F.struct(F.create_map("symbol", bars).alias("bars"))).alias("payload"))


@query("norm_alpaca", BACK_SQL)
def norm_alpaca(spark, d):
    return _back(L.norm_alpaca(payload_alpaca(spark, d)))


def payload_ccxt(spark, d):
    g = _bars(spark, d).withColumn("t", (_seconds() * 1000).cast("double")).groupBy("symbol").agg(_list("t", *OHLCV).alias("b"))
    rows = F.transform("b", lambda x: F.array(x["t"], *(x[c] for c in OHLCV)))
    return g.select("symbol", F.to_json(rows).alias("payload"))


@query("norm_ccxt", BACK_SQL)
def norm_ccxt(spark, d):
    return _back(L.norm_ccxt(payload_ccxt(spark, d)))


def payload_tiingo(spark, d):
    g = _bars(spark, d).withColumn("date", _iso()).groupBy("symbol").agg(_list("date", *OHLCV).alias("b"))
    rows = F.transform("b", lambda x: F.struct(*(x[c].alias(c) for c in ("date", *OHLCV))))
    return g.select("symbol", F.to_json(rows).alias("payload"))


@query("norm_tiingo", BACK_SQL)
def norm_tiingo(spark, d):
    return _back(L.norm_tiingo(payload_tiingo(spark, d)))


def payload_polygon(spark, d):
    g = _bars(spark, d).select("symbol", "ts", (_seconds() * 1000).alias("t"), *_short(*OHLCV)).groupBy("symbol").agg(_list("t", *"ohlcv").alias("b"))
    rows = F.transform("b", lambda x: F.struct(*(x[c].alias(c) for c in "tohlcv")))
    return g.select("symbol", F.to_json(F.struct(rows.alias("results"))).alias("payload"))


@query("norm_polygon", BACK_SQL)
def norm_polygon(spark, d):
    return _back(L.norm_polygon(payload_polygon(spark, d)))


def payload_finnhub(spark, d):
    g = _bars(spark, d).select("symbol", "ts", _seconds().alias("t"), *_short(*OHLCV)).groupBy("symbol").agg(_list("t", *"ohlcv").alias("b"))
    longer = F.concat(F.col("b.t"), F.array(F.lit(1).cast("bigint")))  # one stamp too many: zipped to the shortest
    return g.select("symbol", F.to_json(F.struct(F.lit("ok").alias("s"), longer.alias("t"), *(F.col(f"b.{c}").alias(c) for c in "ohlcv"))).alias("payload"))


@query("norm_finnhub", BACK_SQL)
def norm_finnhub(spark, d):
    bad = payload_finnhub(spark, d).withColumn("payload", F.lit('{"s":"no_data"}'))
    return _back(L.norm_finnhub(payload_finnhub(spark, d).unionByName(bad)))


def payload_twelvedata(spark, d):
    text = _bars(spark, d).withColumn("datetime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).withColumns({c: F.format_string("%.6f", c) for c in OHLCV})
    g = text.groupBy("symbol").agg(_list("datetime", *OHLCV).alias("b"))
    rows = F.transform("b", lambda x: F.struct(*(x[c].alias(c) for c in ("datetime", *OHLCV))))
    return g.select("symbol", F.to_json(F.struct(rows.alias("values"))).alias("payload"))


@query("norm_twelvedata", BACK_SQL)
def norm_twelvedata(spark, d):
    return _back(L.norm_twelvedata(payload_twelvedata(spark, d)))


def payload_alphavantage(spark, d):
    keys = ("1. open", "2. high", "3. low", "4. close", "6. volume")
    day = F.create_map(*(x for k, c in zip(keys, OHLCV, strict=True) for x in (F.lit(k), F.format_string("%.6f", c))))
    g = _bars(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("m", day).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("day", "m"))).alias("s"))
    return g.select("symbol", F.to_json(F.create_map(F.lit("Time Series (Daily)"), "s")).alias("payload"))


@query("norm_alphavantage", BACK_SQL)
def norm_alphavantage(spark, d):
    return _back(L.norm_alphavantage(payload_alphavantage(spark, d)))


@query("route_source", f"WITH {X.BARS_SQL} SELECT source, symbol, {TS_SQL}, round(close, 6) AS close FROM bars, (VALUES ('polygon'), ('binance')) v(source)")
def route_source(spark, d):
    both = payload_polygon(spark, d).withColumn("source", F.lit("polygon")).unionByName(payload_ccxt(spark, d).withColumn("source", F.lit("binance")))
    return L.route_source(both, ["polygon", "binance"]).select("source", "symbol", ts_text(), *r6("close"))


PAYLOADS = {"yfinance": "yahoo", "alpaca": "alpaca", "ccxt": "ccxt", "binance": "ccxt", "bybit": "ccxt", "tiingo": "tiingo", "polygon": "polygon", "finnhub": "finnhub", "twelvedata": "twelvedata", "alphavantage": "alphavantage"}


def landed(spark, d):
    """A table of payloads of ten sources as they would land. By symbol: 1 is cut off, 2 holds no bars, 3 is null, the others are whole."""
    parts = [globals()[f"payload_{of}"](spark, d).select("symbol", "payload", F.lit(name).alias("source")) for name, of in PAYLOADS.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    kind = F.substring("symbol", 1, 1)
    broken = F.when(kind == "1", F.expr("substring(payload, 1, length(payload) - 7)")).when(kind == "2", "{}").when(kind != "3", F.col("payload"))
    path = storage.shared_folder(spark, "payloads")
    rows.withColumn("payload", F.when(F.col("source").isin("ccxt", "binance", "bybit", "tiingo") & (kind == "2"), "[]").otherwise(broken)).write.parquet(path)
    return spark.read.parquet(path)


_SOURCES_SQL = "(VALUES " + ", ".join(f"('{n}', '{L.PARSERS[n][1]}')" for n in PAYLOADS) + ") v(source, title)"


@query("route_ten_sources", f"WITH {X.BARS_SQL} SELECT source, symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM bars, {_SOURCES_SQL} WHERE symbol > '4'")
def route_ten_sources(spark, d):
    return L.bars_of(L.outcomes(landed(spark, d))).select("source", "symbol", ts_text(), *r6(*OHLCV))


@query(
    "payload_failures",
    f"""SELECT source, symbol, CASE symbol[1] WHEN '1' THEN 'parse' WHEN '2' THEN 'normalize' ELSE 'fetch' END AS stage,
    CASE symbol[1] WHEN '1' THEN 'Broken payload from ' WHEN '2' THEN 'No data from ' ELSE 'Empty payload from ' END || title || ' for ' || symbol AS error
    FROM (SELECT DISTINCT o_orderpriority AS symbol FROM orders), {_SOURCES_SQL} WHERE symbol < '4'""",
)
def payload_failures(spark, d):
    return L.failures_of(L.outcomes(landed(spark, d))).select("source", "symbol", "stage", "error")


def _corporate(name: str, action: str, value: str) -> None:
    @query(
        f"norm_{name}",
        f"SELECT p_brand AS symbol, ts, {value} FROM (SELECT p_brand, strftime(l_shipdate, '%Y-%m-%d') AS ts, max(l_quantity) AS {value} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = CASE WHEN p_brand < 'Brand#3' THEN 'A' ELSE 'R' END GROUP BY ALL)",
    )
    def run(spark, d):
        rows = X.table(spark, d, "lineitem").join(X.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        cells = lambda flag: rows.filter(F.col("l_returnflag") == flag).groupBy(F.col("p_brand").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at")).agg(F.max("l_quantity").alias("v"))
        series = lambda flag: cells(flag).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
        own = series("A").filter("symbol < 'Brand#3'").withColumnRenamed("m", name)
        actions = series("R").select("symbol", F.create_map(F.lit(action), "m").alias("actions"))
        out = L.norm_events(own.join(actions, "symbol", "full"), name, action, value)
        return out.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("ts"), value)


_corporate("splits", "Stock Splits", "ratio")
_corporate("dividends", "Dividends", "dividend")


@query(
    "norm_fundamentals",
    "SELECT p_brand AS symbol, CASE l_returnflag WHEN 'A' THEN 'income_statement' WHEN 'N' THEN 'balance_sheet' ELSE 'cash_flow' END AS statement, p_type AS item, strftime(l_shipdate, '%Y') AS period, round(coalesce(sum(CASE WHEN l_quantity > 25 THEN l_extendedprice END), 0), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
)
def norm_fundamentals(spark, d):
    rows = X.table(spark, d, "lineitem").join(X.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("l_returnflag")
    rows = rows.withColumn("statement", F.when(flag == "A", "income_statement").when(flag == "N", "balance_sheet").otherwise("cash_flow"))
    cells = rows.groupBy("p_brand", "statement", "p_type", F.date_format("l_shipdate", "yyyy").alias("period")).agg(F.sum(F.expr("case when l_quantity > 25 then l_extendedprice end")).alias("v"))
    items = cells.groupBy("p_brand", "statement", "p_type").agg(F.map_from_entries(F.collect_list(F.struct("period", "v"))).alias("m"))
    statements = items.groupBy(F.col("p_brand").alias("symbol"), "statement").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "m"))).alias("items"))
    return L.norm_fundamentals(statements).select("symbol", "statement", "item", "period", F.round("value", 2).alias("value"))


@query("norm_info", "SELECT c_name AS symbol, 'sector' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_name, 'currency', 'USD' FROM customer")
def norm_info(spark, d):
    info = F.create_map(F.lit("sector"), "c_mktsegment", F.lit("currency"), F.lit("USD"), F.lit("website"), F.lit("x"))
    return L.norm_info(X.table(spark, d, "customer").select(F.col("c_name").alias("symbol"), info.alias("info")))


@query("bars_parquet_scan", f"WITH {X.EVENT_BARS_SQL} SELECT symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM bars WHERE symbol < 'p'")
def bars_parquet_scan(spark, d):
    path = storage.shared_folder(spark, "bars")
    daily = _bars(spark, d).drop("close_key").withColumn("timeframe", F.lit("1d"))
    hourly = X.bars_events(spark, d).drop("close_key").withColumn("timeframe", F.lit("1h"))
    storage.bars_parquet_sink(daily.unionByName(hourly).withColumn("source", F.lit("ticks")), path)
    return _back(storage.bars_parquet_scan(spark, path, "ticks", "1h").filter("symbol < 'p'"))


@query("bars_parquet_sink", BACK_SQL)
def bars_parquet_sink(spark, d):
    path = storage.shared_folder(spark, "bars")
    storage.bars_parquet_sink(_bars(spark, d).drop("close_key").withColumn("timeframe", F.lit("1d")).withColumn("source", F.lit("A/B")), path)
    return _back(storage.bars_parquet_scan(spark, path, "A/B", "1d"))


@query(
    "bars_store_writes",
    f"""WITH {X.BARS_SQL}, hourly AS (
      SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(100 + value, event_id) AS open, max(100 + value) AS high, min(100 + value) AS low, arg_max(100 + value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL)
    SELECT 'one' AS source, '1d' AS timeframe, symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM bars WHERE symbol >= '3'
    UNION ALL SELECT 'one', '1d', symbol, {TS_SQL}, round(open + 1, 6), round(high + 1, 6), round(low + 1, 6), round(close + 1, 6), volume FROM bars WHERE symbol < '3' AND ts < TIMESTAMP '1996-01-01'
    UNION ALL SELECT 'two', '1d', symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM bars UNION ALL SELECT 'one', '1h', symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM hourly""",
)
def bars_store_writes(spark, d):
    """Four writes to one store: a second source, a second timeframe, and some series of the first anew; all other series stay."""
    path, bars = storage.shared_folder(spark, "bars"), _bars(spark, d).drop("close_key")
    tagged = lambda rows, source, timeframe: rows.withColumns({"source": F.lit(source), "timeframe": F.lit(timeframe)})
    storage.bars_parquet_sink(tagged(bars, "one", "1d"), path)
    storage.bars_parquet_sink(tagged(bars, "two", "1d"), path)
    storage.bars_parquet_sink(tagged(X.bars_events(spark, d).drop("close_key"), "one", "1h"), path)
    again = bars.filter("symbol < '3' and ts < timestamp_ntz '1996-01-01'").withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})
    storage.bars_parquet_sink(tagged(again, "one", "1d"), path)
    return storage.bars_store(spark, path).read().select("source", "timeframe", "symbol", ts_text(), *r6(*OHLCV))


@query(
    "results_csv_scan",
    f"WITH {X.RESULTS_SQL} SELECT collection, symbol, timeframe, strategy, params, metric_value, omega, CASE WHEN isnan(sharpe) THEN NULL ELSE sharpe END AS sharpe FROM (SELECT * REPLACE (CASE WHEN omega IS NULL THEN 'nan'::DOUBLE ELSE omega END AS omega) FROM results)",
)
def results_csv_scan(spark, d):
    from ..functions.scalars import not_nan
    from .q_results import results_csv_sink

    path = storage.shared_folder(spark, "csv")
    storage.results_csv_sink(results_csv_sink(spark, d).select(*(c.split()[0] for c in storage.RESULTS_CSV.split(", "))), path)
    rows = storage.results_csv_scan(spark, path)
    return rows.select("collection", "symbol", "timeframe", "strategy", "params", "metric_value", "omega", not_nan("sharpe").alias("sharpe"))


@query("retention_scan")
def retention_scan(spark, d):
    files = storage.retention_scan(spark, d, 0, datetime.datetime.now(datetime.UTC))
    return storage.retention_totals(files)


@query("ticks_to_bars_daily", BACK_SQL)
def ticks_to_bars_daily(spark, d):
    price = X.BASE_PRICE + F.col("o_totalprice")
    return _back(ticks_to_bars(X.table(spark, d, "orders"), "o_orderpriority", "o_orderdate", price, "o_orderkey", "day"))


_ROOTS = ["reports", "cache"]
_CLOCK = datetime.datetime(1997, 3, 1, 12)


def _file_listing(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("cache/"), k.cast("string"))).otherwise(F.concat(F.lit("reports/run-"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"), k.cast("string"), F.lit(".json")))
    return X.table(spark, d, "orders").select(name.alias("path"), F.col("o_custkey").cast("long").alias("size"), F.col("o_orderdate").cast("timestamp_ntz").alias("modified"), k.alias("k"))


@query(
    "retention_inventory",
    """WITH files AS (
      SELECT CASE WHEN k % 5 = 0 THEN 'cache/' || k ELSE 'reports/run-' || (o_custkey % 7) || '/' || k || '.json' END AS path, o_custkey::BIGINT AS size,
             o_orderdate + CASE WHEN k % 5 <> 0 AND k % 2 = 1 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS modified
      FROM (SELECT *, o_orderkey AS k FROM orders) WHERE CASE WHEN k % 5 = 0 THEN k % 3 < 2 ELSE k % 4 <> 0 END)
    SELECT path, size, floor(epoch(TIMESTAMP '1997-03-01 12:00:00' - modified) / 86400)::INTEGER AS age_days FROM files WHERE modified <= TIMESTAMP '1997-03-01 12:00:00' - INTERVAL 400 DAY""",
)
def retention_inventory(spark, d):
    """Two listings of one inventory: the second finds some reports gone, some new and some changed, and doesn't look at the cache."""
    store, rows = inventory.inventory_store(spark, storage.shared_folder(spark, "inventory")), _file_listing(spark, d)
    inventory.refresh(store, rows.filter("k % 3 < 2").drop("k"), _ROOTS, datetime.datetime(1997, 1, 1))
    later = F.when(F.col("k") % 2 == 1, F.col("modified") + F.make_dt_interval(F.lit(1))).otherwise(F.col("modified"))
    inventory.refresh(store, rows.filter("k % 4 != 0").withColumn("modified", later).drop("k"), ["reports"], datetime.datetime(1997, 2, 1))
    return inventory.past_keep(store.read(), _ROOTS, 400, _CLOCK)

"""Tables that the registered queries work on, derived from the given ones, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import ticks_to_bars
from ..operators.metrics import all_statistics
from ..operators.positions import evaluate
from ..operators.strategies import sma_cross

GRID = [(5, 20), (10, 50)]
FEE = 0.001
#: Added to an order's total, so that a bar's price moves by a few percent at most.
BASE_PRICE = 10_000_000.0
KEYS = ["symbol", "combo_id"]
STATS = ["sharpe", "sortino", "omega", "tail_ratio", "profit", "pain_index", "max_drawdown", "cagr", "calmar"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, one series for each priority."""
    return ticks_to_bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", BASE_PRICE + F.col("o_totalprice"), "o_orderkey", "day")


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values, one series for each type."""
    return ticks_to_bars(table(spark, sf_dir, "events"), "event_type", "ts", 100 + F.col("value"), "event_id", "hour")


def signals_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sma_cross(bars_orders(spark, sf_dir), GRID, ["symbol"])


def flip_columns() -> dict:
    """Entry and exit flags that are sometimes both set."""
    flag = lambda m: (F.col("close_key") * m) % 100 < 15
    return {"entry": flag(7919), "exit": flag(104729)}


def signals_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_orders(spark, sf_dir).withColumns(flip_columns()).withColumn("combo_id", F.lit(0))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(signals_sma(spark, sf_dir), KEYS, FEE)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_statistics(evaluated(spark, sf_dir), KEYS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results, a row for each order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k, m = F.col("o_orderkey"), (F.floor("o_totalprice") - 250000) / 100000
    nan = F.lit(float("nan"))
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("collection"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("symbol"),
        F.when(F.col("o_orderpriority") < "3", "1d").otherwise("1h").alias("timeframe"),
        F.col("o_orderstatus").alias("strategy"),
        F.concat(F.lit("run-"), (F.col("o_custkey") % 4).cast("string")).alias("run_id"),
        F.lit("sharpe").alias("metric"),
        m.alias("metric_value"),
        k.alias("ordinal"),
        F.when(k % 11 == 0, nan).otherwise(m).alias("sharpe"),
        (m * 1.5).alias("sortino"),
        F.when(k % 7 != 0, (F.abs(m) + (k % 13) / 10)).alias("omega"),
        (F.abs(m) / 2 + (k % 5) / 10).alias("tail_ratio"),
        (m / 10).alias("profit"),
        ((k % 101) / 1000).alias("pain_index"),
        (-(k % 97) / 200).alias("max_drawdown"),
        (m / 20).alias("cagr"),
        F.when(k % 97 != 0, (m / 20 / ((k % 97) / 200))).alias("calmar"),
        F.when(k % 3 != 0, k % 29).alias("trades"),
        (k % 5 < 2).alias("hit"),
        F.concat(F.lit('{"fast":"'), (k % 4 * 5 + 5).cast("string"), F.lit('"}')).alias("params"),
    )


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by exchange, with summed quantity as volume."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    pair = F.concat(F.col("p_brand"), F.lit("/"), F.when(F.col("p_size") % 3 == 0, "USD").otherwise("USDT"))
    joined = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_returnflag").alias("exchange"), pair.alias("symbol"))
    return joined.agg(F.sum("l_quantity").alias("volume"))


# --- the same in SQL -------------------------------------------------------------------------------------------------

BARS_SQL = f"""bars AS (
  SELECT o_orderpriority AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts,
         arg_min({BASE_PRICE} + o_totalprice, o_orderkey) AS open, max({BASE_PRICE} + o_totalprice) AS high, min({BASE_PRICE} + o_totalprice) AS low,
         arg_max({BASE_PRICE} + o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume, max(o_orderkey) AS close_key
  FROM orders GROUP BY ALL)"""

EVENT_BARS_SQL = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(100 + value, event_id) AS open, max(100 + value) AS high, min(100 + value) AS low,
         arg_max(100 + value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL)"""



def sma_sql(grid: list[tuple[int, int]]) -> str:
    lengths = sorted({n for pair in grid for n in pair})
    means = ", ".join(f"avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in lengths)
    rows = ", ".join(f"({i}, {a}, {b}, b.m{a}, b.m{b})" for i, (a, b) in enumerate(grid))
    return f"""{BARS_SQL}, signals AS (
  SELECT b.*, g.combo_id, g.fast, g.slow, g.a > g.b AS entry, NOT (g.a > g.b) AS exit FROM (SELECT *, {means} FROM bars) b,
  LATERAL (SELECT * FROM (VALUES {rows}) v(combo_id, fast, slow, a, b)) g)"""


SMA_SQL = sma_sql(GRID)

FLIP_SQL = (
    BARS_SQL
    + """, signals AS (
  SELECT *, 0 AS combo_id, (close_key * 7919) % 100 < 15 AS entry, (close_key * 104729) % 100 < 15 AS exit FROM bars)"""
)

_W = "PARTITION BY symbol, combo_id ORDER BY ts"

LATCH_SQL = f""", toggled AS (
  SELECT *, sum(CASE WHEN entry AND exit THEN 1 ELSE 0 END) OVER ({_W}) AS toggles,
         CASE WHEN entry <> exit THEN CASE WHEN entry THEN 1 ELSE 0 END END AS fixed FROM signals
), based AS (
  SELECT *, coalesce(last_value(fixed IGNORE NULLS) OVER ({_W}), 0) AS base,
         coalesce(last_value(CASE WHEN fixed IS NOT NULL THEN toggles END IGNORE NULLS) OVER ({_W}), 0) AS at_base FROM toggled
), latched AS (
  SELECT *, CAST((base + toggles - at_base) % 2 AS INTEGER) AS pos_after FROM based
), positioned AS (
  SELECT *, coalesce(lag(pos_after) OVER ({_W}), 0) AS pos FROM latched)"""

RETURNS_SQL = f""", held AS (
  SELECT *, CASE WHEN lead(ts) OVER ({_W}) IS NULL THEN 0 ELSE pos END AS h FROM positioned
), stepped AS (
  SELECT *, coalesce(lag(h) OVER ({_W}), 0) AS h_before, close / lag(close) OVER ({_W}) - 1 AS gain,
         row_number() OVER ({_W}) AS n FROM held
), returned AS (
  SELECT *, coalesce((1 + h_before * gain) * (1 - {FEE} * abs(h - h_before))
    * CASE WHEN n = 2 THEN 1 - {FEE} * h_before ELSE 1.0 END - 1, 0.0) AS r FROM stepped
), grown AS (
  SELECT *, product(1 + r) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS equity FROM returned
), drawn AS (
  SELECT *, CASE WHEN equity / max(equity) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1 > -1e-12 THEN 0.0
         ELSE equity / max(equity) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1 END AS drawdown FROM grown)"""

EVALUATED_SQL = SMA_SQL + LATCH_SQL + RETURNS_SQL

_STATS = """, moments AS (
  SELECT symbol, combo_id, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd, stddev_pop(least(r, 0)) AS down,
         coalesce(sum(r) FILTER (WHERE r > 0), 0) AS gains, coalesce(-sum(r) FILTER (WHERE r < 0), 0) AS losses,
         abs(quantile_cont(r, 0.95)) AS q95, abs(quantile_cont(r, 0.05)) AS q05,
         arg_min(equity, ts) AS e_first, arg_max(equity, ts) AS e_last,
         coalesce(-avg(drawdown) FILTER (WHERE drawdown < 0), 0) AS pain_index, min(drawdown) AS max_drawdown,
         date_diff('day', min(ts), max(ts)) AS days, CAST(sum(CASE WHEN h = 0 AND h_before = 1 THEN 1 ELSE 0 END) AS BIGINT) AS trades
  FROM drawn GROUP BY ALL
), ratios AS (
  SELECT symbol, combo_id, trades, pain_index, max_drawdown, e_last / e_first - 1 AS profit,
    CASE WHEN sd = 0 THEN CASE WHEN abs(mean * 252) <= 1e-8 THEN 0.0 WHEN mean > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END
         ELSE mean * 252 / (sd * sqrt(252)) END AS sharpe,
    CASE WHEN down = 0 THEN CASE WHEN abs(mean * 252) <= 1e-8 THEN 0.0 WHEN mean > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END
         ELSE mean * 252 / (down * sqrt(252)) END AS sortino,
    CASE WHEN losses <= 1e-8 THEN CASE WHEN gains > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END ELSE gains / losses END AS omega,
    CASE WHEN q05 <= 1e-8 THEN CASE WHEN q95 > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END ELSE q95 / q05 END AS tail_ratio,
    CASE WHEN n < 2 OR e_first <= 0 OR e_last <= 0 THEN CAST('nan' AS DOUBLE)
         ELSE power(e_last, 1 / CASE WHEN days > 0 THEN days / 365.25 ELSE n / 252.0 END) - 1 END AS cagr
  FROM moments
), stats AS (
  SELECT *, CASE WHEN max_drawdown < 0 AND isfinite(cagr) THEN cagr / abs(max_drawdown) ELSE CAST('nan' AS DOUBLE) END AS calmar FROM ratios)"""


def stats_sql(grid: list[tuple[int, int]]) -> str:
    return sma_sql(grid) + LATCH_SQL + RETURNS_SQL + _STATS


STATS_SQL = stats_sql(GRID)

RESULTS_SQL = """results AS (
  SELECT c_mktsegment AS collection, 'N' || c_nationkey AS symbol, CASE WHEN o_orderpriority < '3' THEN '1d' ELSE '1h' END AS timeframe,
    o_orderstatus AS strategy, 'run-' || (o_custkey % 4) AS run_id, 'sharpe' AS metric, m AS metric_value, k AS ordinal,
    CASE WHEN k % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE m END AS sharpe, (m * 1.5) AS sortino,
    CASE WHEN k % 7 <> 0 THEN (abs(m) + (k % 13) / 10) END AS omega, (abs(m) / 2 + (k % 5) / 10) AS tail_ratio,
    (m / 10) AS profit, ((k % 101) / 1000) AS pain_index, (-(k % 97) / 200) AS max_drawdown,
    (m / 20) AS cagr, CASE WHEN k % 97 <> 0 THEN (m / 20 / ((k % 97) / 200)) END AS calmar,
    CASE WHEN k % 3 <> 0 THEN k % 29 END AS trades, k % 5 < 2 AS hit, '{"fast":"' || (k % 4 * 5 + 5) || '"}' AS params
  FROM (SELECT *, o_orderkey AS k, (floor(o_totalprice) - 250000) / 100000 AS m FROM orders JOIN customer ON o_custkey = c_custkey))"""

TICKERS_SQL = """tickers AS (
  SELECT l_returnflag AS exchange, p_brand || '/' || CASE WHEN p_size % 3 = 0 THEN 'USD' ELSE 'USDT' END AS symbol, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

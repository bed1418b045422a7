"""Bars, positions and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import frames, long_series
from ..operators import metrics as M
from ..operators import positions as P
from ..operators.strategies import ternary
from . import fixtures as X
from .base import query

def ts_text():
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")


TS_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
OHLCV = ("open", "high", "low", "close", "volume")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query("ticks_to_bars", f"WITH {X.EVENT_BARS_SQL} SELECT symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM bars")
def ticks_to_bars(spark, d):
    return X.bars_events(spark, d).select("symbol", ts_text(), *r6(*OHLCV))


FRAMES = {"5m": "5 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day", "1w": "7 days", "2w": "14 days", "1mo": "1 month", "3mo": "3 months"}


def _frame_sql(frame: str) -> str:
    return f"""SELECT '{frame}' AS timeframe, event_type AS symbol, {TS_SQL}, {r6_sql(*OHLCV)} FROM (
      SELECT event_type, time_bucket(INTERVAL '{FRAMES[frame]}', ts) AS ts, arg_min(100 + value, event_id) AS open, max(100 + value) AS high, min(100 + value) AS low,
             arg_max(100 + value, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"""


def _event_frames(spark, d, names):
    return frames.bars_of_frames(X.table(spark, d, "events"), "event_type", "ts", 100 + F.col("value"), "event_id", names)


@query("ticks_to_frames", " UNION ALL ".join(map(_frame_sql, FRAMES)))
def ticks_to_frames(spark, d):
    """All timeframes from one scan and one shuffle."""
    return _event_frames(spark, d, list(FRAMES)).select("timeframe", "symbol", ts_text(), *r6(*OHLCV))


@query("ticks_to_bars_4h", _frame_sql("4h"))
def ticks_to_bars_4h(spark, d):
    bars = B.ticks_to_bars(X.table(spark, d, "events"), "event_type", "ts", 100 + F.col("value"), "event_id", "4h")
    return bars.select(F.lit("4h").alias("timeframe"), "symbol", ts_text(), *r6(*OHLCV))


@query("frames_from_finer", " UNION ALL ".join(map(_frame_sql, ("4h", "1w", "1mo"))))
def frames_from_finer(spark, d):
    """Coarse bars from the states of fine ones: 1h to 4h, 4h to 1w, 1h to months."""
    hours = _event_frames(spark, d, ["1h"]).drop("timeframe")
    four = frames.coarser(hours, "1h", "4h")
    out = {"4h": four, "1w": frames.coarser(four, "4h", "1w"), "1mo": frames.coarser(hours, "1h", "1mo")}
    rows = [bars.select(F.lit(name).alias("timeframe"), "symbol", ts_text(), *r6(*OHLCV)) for name, bars in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("normalize_bars", f"WITH {X.BARS_SQL} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, {r6_sql('open', 'high', 'low', 'close')}, 0.0::DOUBLE AS volume FROM bars")
def normalize_bars(spark, d):
    raw = X.bars_orders(spark, d).select("symbol", F.col("ts").alias("day"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"))
    out = B.normalize_bars(raw, F.col("symbol"), "day")
    return out.select("symbol", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), *r6("open", "high", "low", "close"), "volume")


@query("data_fingerprint", f"WITH {X.BARS_SQL} SELECT symbol, count(*)::VARCHAR || ':' || strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || ':' || arg_max(close, ts)::VARCHAR AS fingerprint FROM bars GROUP BY symbol")
def data_fingerprint(spark, d):
    return B.data_fingerprint(X.bars_orders(spark, d), "symbol")


@query("strategy_columns", f"WITH {X.SMA_SQL} SELECT symbol, combo_id, {TS_SQL}, entry, exit FROM signals")
def strategy_columns(spark, d):
    return X.signals_sma(spark, d).select("symbol", "combo_id", ts_text(), "entry", "exit")


@query("strategy_ternary", f"WITH {X.BARS_SQL} SELECT symbol, {TS_SQL}, coalesce(s = 1, false) AS entry, coalesce(s = -1, false) AS exit FROM (SELECT *, CASE WHEN close_key % 4 < 3 THEN close_key % 4 - 1 END AS s FROM bars)")
def strategy_ternary(spark, d):
    k = F.col("close_key") % 4
    entry, exit_ = ternary(F.when(k < 3, k - 1))
    return X.bars_orders(spark, d).select("symbol", ts_text(), entry.alias("entry"), exit_.alias("exit"))


@query("position_latch", f"WITH {X.FLIP_SQL}{X.LATCH_SQL} SELECT symbol, {TS_SQL}, entry, exit, pos::INTEGER AS pos, pos_after FROM positioned")
def position_latch(spark, d):
    out = P.position_latch(X.signals_flip(spark, d), X.KEYS)
    return out.select("symbol", ts_text(), "entry", "exit", F.col("pos").cast("int"), F.col("pos_after").cast("int"))


@query("exit_on_last_bar", f"WITH {X.FLIP_SQL}{X.LATCH_SQL}, held AS (SELECT *, CASE WHEN lead(ts) OVER (PARTITION BY symbol ORDER BY ts) IS NULL THEN 0 ELSE pos END AS h FROM positioned) SELECT symbol, arg_max(h, ts)::INTEGER AS last_h, sum(h)::BIGINT AS bars_held FROM held GROUP BY symbol")
def exit_on_last_bar(spark, d):
    held = P.hold(P.position_latch(X.signals_flip(spark, d), X.KEYS), X.KEYS)
    return held.groupBy("symbol").agg(F.max_by("h", "ts").cast("int").alias("last_h"), F.sum("h").cast("long").alias("bars_held"))


EV = f"WITH {X.EVALUATED_SQL}"


@query("strategy_returns", f"{EV} SELECT symbol, combo_id, {TS_SQL}, h::INTEGER AS h, {r6_sql('r')} FROM drawn")
def strategy_returns(spark, d):
    return X.evaluated(spark, d).select("symbol", "combo_id", ts_text(), F.col("h").cast("int"), *r6("r"))


@query("equity_curve", f"{EV} SELECT symbol, combo_id, {TS_SQL}, {r6_sql('equity')} FROM drawn")
def equity_curve(spark, d):
    return X.evaluated(spark, d).select("symbol", "combo_id", ts_text(), *r6("equity"))


@query("drawdown_curve", f"{EV} SELECT symbol, combo_id, {TS_SQL}, {r6_sql('drawdown')} FROM drawn")
def drawdown_curve(spark, d):
    return X.evaluated(spark, d).select("symbol", "combo_id", ts_text(), *r6("drawdown"))


@query("bar_returns", f"WITH {X.BARS_SQL} SELECT symbol, {TS_SQL}, round(coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0.0), 6) AS r FROM bars")
def bar_returns(spark, d):
    rows = X.bars_orders(spark, d).withColumnRenamed("close", "equity")
    return P.bar_returns(rows, ["symbol"]).select("symbol", ts_text(), *r6("r"))


@query("clean_returns", f"WITH {X.BARS_SQL} SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars) WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY symbol")
def clean_returns(spark, d):
    from pyspark.sql import Window

    from ..functions.scalars import not_nan

    r = F.try_divide("close", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))) - 1
    rows = X.bars_orders(spark, d).withColumn("r", r).filter(not_nan("r").isNotNull())
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"))


@query(
    "signal_align",
    f"WITH {X.BARS_SQL}, s AS (SELECT symbol, ts, true AS entry, close_key % 2 = 0 AS exit FROM bars WHERE close_key % 3 = 0) SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, coalesce(s.entry, false) AS entry, coalesce(s.exit, false) AS exit FROM bars b LEFT JOIN s ON b.symbol = s.symbol AND b.ts = s.ts",
)
def signal_align(spark, d):
    bars = X.bars_orders(spark, d)
    signals = bars.filter("close_key % 3 = 0").select("symbol", "ts", F.lit(True).alias("entry"), (F.col("close_key") % 2 == 0).alias("exit"))
    return B.align_signals(bars.select("symbol", "ts"), signals, "symbol", "ts").select("symbol", ts_text(), "entry", "exit")


_FILL = """filled AS (
  SELECT symbol, ts, coalesce(last_value(equity IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),
         first_value(equity IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS equity FROM gaps)"""


@query("fill_forward_back", f"WITH {X.BARS_SQL}, gaps AS (SELECT symbol, ts, CASE WHEN close_key % 5 = 1 THEN close END AS equity FROM bars), {_FILL} SELECT symbol, {TS_SQL}, {r6_sql('equity')} FROM filled")
def fill_forward_back(spark, d):
    rows = X.bars_orders(spark, d).withColumn("x", F.expr("case when close_key % 5 = 1 then close end"))
    return rows.select("symbol", ts_text(), F.round(B.fill_forward_back("x", ["symbol"], "ts"), 6).alias("equity"))


@query(
    "equity_align",
    f"WITH {X.BARS_SQL}, e AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, arg_max(o_totalprice, o_orderkey) AS equity FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL), gaps AS (SELECT b.symbol, b.ts, e.equity FROM bars b LEFT JOIN e ON b.symbol = e.symbol AND b.ts = e.ts), {_FILL} SELECT symbol, {TS_SQL}, {r6_sql('equity')} FROM filled WHERE equity IS NOT NULL",
)
def equity_align(spark, d):
    equity = X.table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(
        F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("equity"), "o_orderkey"
    )
    return B.align_equity(X.bars_orders(spark, d), equity, ["symbol"], "o_orderkey").select("symbol", ts_text(), *r6("equity"))


@query(
    "sample_curve",
    f"{EV} SELECT symbol, combo_id, {TS_SQL}, {r6_sql('equity')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, combo_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, combo_id) AS m FROM drawn) WHERE i % greatest(1, m // 500) = 0 OR i = m - 1",
)
def sample_curve(spark, d):
    return P.sample_curve(X.evaluated(spark, d), X.KEYS, "equity").select("symbol", "combo_id", ts_text(), *r6("equity"))


_TRIPS = """, fills AS (
  SELECT *, sum(CASE WHEN h = 1 AND h_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, combo_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS trade FROM drawn
), trips AS (
  SELECT symbol, combo_id, trade::BIGINT AS trade, min(ts) AS entry_time, max(ts) AS exit_time, arg_min(close, ts) AS entry_price, arg_max(close, ts) AS exit_price
  FROM fills WHERE h <> h_before GROUP BY symbol, combo_id, trade HAVING count(*) = 2)"""


@query("trades_log", f"{EV}{_TRIPS} SELECT symbol, combo_id, trade, strftime(entry_time, '%Y-%m-%dT%H:%M:%S') AS entry_time, strftime(exit_time, '%Y-%m-%dT%H:%M:%S') AS exit_time, {r6_sql('entry_price', 'exit_price')}, round(exit_price - entry_price, 6) AS profit FROM trips WHERE trade <= 50")
def trades_log(spark, d):
    trips = P.trades_log(X.evaluated(spark, d), X.KEYS)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return trips.select("symbol", "combo_id", "trade", iso("entry_time"), iso("exit_time"), *r6("entry_price", "exit_price", "profit"))


@query(
    "whole_share_equity",
    f"{EV}{_TRIPS}, lists AS (SELECT symbol, combo_id, count(*) AS trades, list(struct_pack(e := entry_price, x := exit_price) ORDER BY trade) AS l FROM trips GROUP BY ALL) SELECT symbol, combo_id, trades::INTEGER AS trades, round(list_reduce(list_prepend(struct_pack(e := 10000000.0::DOUBLE, x := 0.0::DOUBLE), l), lambda c, t: struct_pack(e := c.e - floor(c.e / (t.e * 1.001)) * t.e * 1.001 + floor(c.e / (t.e * 1.001)) * t.x * 0.999, x := 0.0::DOUBLE)).e, 4) AS cash FROM lists",
)
def whole_share_equity(spark, d):
    trips = P.trades_log(X.evaluated(spark, d), X.KEYS, limit=None)
    out = P.whole_share_equity(trips, X.KEYS, cash=10_000_000.0)
    return out.select("symbol", "combo_id", "trades", F.round("cash", 4).alias("cash"))


def _month():
    return F.date_trunc("month", "ts")


@query("long_series_latch", f"WITH {X.FLIP_SQL}{X.LATCH_SQL} SELECT symbol, {TS_SQL}, pos::INTEGER AS pos, pos_after FROM positioned")
def long_series_latch(spark, d):
    """The latch over blocks of a month; no window holds a whole series."""
    out = long_series.blocked_latch(long_series.in_blocks(X.signals_flip(spark, d), _month()), X.KEYS)
    return out.select("symbol", ts_text(), F.col("pos").cast("int"), F.col("pos_after").cast("int"))


@query("long_series_curves", f"{EV} SELECT symbol, combo_id, {TS_SQL}, h::INTEGER AS h, {r6_sql('r', 'equity', 'drawdown')} FROM drawn")
def long_series_curves(spark, d):
    out = long_series.blocked_evaluate(X.signals_sma(spark, d), X.KEYS, _month(), X.FEE)
    return out.select("symbol", "combo_id", ts_text(), F.col("h").cast("int"), *r6("r", "equity", "drawdown"))


@query("long_series_trades", f"{EV}{_TRIPS} SELECT symbol, combo_id, trade, {r6_sql('entry_price', 'exit_price')}, round(exit_price - entry_price, 6) AS profit FROM trips")
def long_series_trades(spark, d):
    out = long_series.blocked_evaluate(X.signals_sma(spark, d), X.KEYS, _month(), X.FEE)
    return long_series.blocked_trades(out, X.KEYS, limit=None).select("symbol", "combo_id", "trade", *r6("entry_price", "exit_price", "profit"))


def _statistic(name: str, column: str, digits: int = 6) -> None:
    value = f"round({column}, {digits}) + 0.0" if column != "trades" else column

    @query(name, f"WITH {X.STATS_SQL} SELECT symbol, combo_id, {value} AS {column} FROM stats")
    def run(spark, d):
        out = F.col(column) if column == "trades" else F.round(column, digits)
        return X.statistics(spark, d).select("symbol", "combo_id", out.alias(column))


for _name, _column in (
    ("sharpe_ratio", "sharpe"),
    ("sortino_ratio", "sortino"),
    ("total_return", "profit"),
    ("omega_ratio", "omega"),
    ("tail_ratio", "tail_ratio"),
    ("pain_index", "pain_index"),
    ("max_drawdown", "max_drawdown"),
    ("cagr", "cagr"),
    ("calmar", "calmar"),
    ("trade_count", "trades"),
):
    _statistic(_name, _column)


@query("objective_metric", f"WITH {X.STATS_SQL} SELECT symbol, combo_id, m.metric, round(CASE m.metric WHEN 'sharpe' THEN sharpe WHEN 'sortino' THEN sortino ELSE profit END, 6) AS value FROM stats, (VALUES ('sharpe'), ('sortino'), ('profit')) m(metric)")
def objective_metric(spark, d):
    names = F.array(*(F.struct(F.lit(n).alias("metric"), F.round(M.objective(n), 6).alias("value")) for n in M.OBJECTIVES))
    return X.statistics(spark, d).select("symbol", "combo_id", F.inline(names))

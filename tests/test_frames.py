"""Timeframes of n units, and series over many blocks."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sweepline.operators import frames, long_series
from sweepline.operators import positions as P

TICKS = "symbol string, ts timestamp_ntz, price double, key long"


def at(text):
    return dt.datetime.fromisoformat(text)


def starts(spark, timeframe, *stamps):
    rows = spark.createDataFrame([(i, at(s)) for i, s in enumerate(stamps)], "i int, ts timestamp_ntz").orderBy("i")
    return [str(r.w) for r in rows.select(frames.window_start("ts", timeframe).alias("w")).collect()]


def test_windows_of_n_units(spark):
    assert starts(spark, "5m", "2024-01-01 10:04:59.9", "2024-01-01 10:05:00") == ["2024-01-01 10:00:00", "2024-01-01 10:05:00"]
    assert starts(spark, "4h", "2024-01-01 03:59:59", "2024-01-01 23:00:00") == ["2024-01-01 00:00:00", "2024-01-01 20:00:00"]
    assert starts(spark, "1w", "2024-01-07 23:59:59", "2024-01-08 00:00:00", "1999-12-31 12:00:00") == ["2024-01-01 00:00:00", "2024-01-08 00:00:00", "1999-12-27 00:00:00"]
    assert starts(spark, "2w", "2000-01-02 00:00:00", "2000-01-16 00:00:00", "2000-01-17 00:00:00") == ["1999-12-20 00:00:00", "2000-01-03 00:00:00", "2000-01-17 00:00:00"]
    assert starts(spark, "3mo", "2024-03-31 23:00:00", "1999-11-02 00:00:00") == ["2024-01-01 00:00:00", "1999-10-01 00:00:00"]


def test_windows_go_by_the_wall_clock_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # 02:30 doesn't exist there on that day
        assert starts(spark, "4h", "2024-03-10 02:30:00", "2024-03-10 05:00:00") == ["2024-03-10 00:00:00", "2024-03-10 04:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_an_anchor_moves_the_windows(spark):
    rows = spark.createDataFrame([(at("2024-01-01 09:15:00"),), (at("2024-01-01 09:30:00"),)], "ts timestamp_ntz")
    got = rows.select(frames.window_start("ts", "1h", dt.datetime(2000, 1, 3, 9, 30)).alias("w")).collect()
    assert [str(r.w) for r in got] == ["2024-01-01 08:30:00", "2024-01-01 09:30:00"]


@pytest.mark.parametrize("bad", ["", "0d", "5x", "m5", "1.5h"])
def test_unknown_timeframes(bad):
    with pytest.raises(ValueError):
        frames.parse_timeframe(bad)


def test_units_and_nesting():
    assert [frames.parse_timeframe(t) for t in ("m", "1wk", "1M", "1mo", "15min", "2Q")] == [(1, "m"), (1, "w"), (1, "mo"), (1, "mo"), (15, "m"), (2, "q")]
    assert frames.nests("5m", "1h") and frames.nests("4h", "1w") and frames.nests("1d", "1mo") and frames.nests("1mo", "1q")
    assert not frames.nests("1w", "1mo") and not frames.nests("7m", "1h") and not frames.nests("1h", "30m")


def test_states_of_any_split_merge_to_the_same_bars(spark):
    chance = random.Random(5)
    ticks = [("s", at("2024-01-01 00:00:00") + dt.timedelta(seconds=chance.randrange(700_000)), round(chance.uniform(1, 9), 3), i) for i in range(500)]
    ticks.sort(key=lambda t: t[1])
    ticks = [(*t[:3], i) for i, t in enumerate(ticks)]
    chance.shuffle(ticks)
    of = lambda rows, names: frames.bars_of_frames(spark.createDataFrame(rows, TICKS), "symbol", "ts", "price", "key", names)
    want = {(r.timeframe, r.ts): tuple(r) for r in of(ticks, ["1d", "1w"]).collect()}
    late = of(ticks[:180], ["15m"]).unionByName(of(ticks[180:], ["15m"])).drop("timeframe")  # two states of the same windows
    day = frames.coarser(late, "15m", "1d")
    week = frames.coarser(day, "1d", "1w")
    got = {(n, r.ts): (n, *r) for n, rows in (("1d", day), ("1w", week)) for r in rows.collect()}
    assert got == want and len(got) >= 10
    with pytest.raises(ValueError):
        frames.coarser(day, "1d", "4h")


def test_one_scan_and_one_shuffle(spark, data):
    plan = frames.bars_of_frames(spark.read.parquet(f"{data}/events.parquet"), "event_type", "ts", "value", "event_id", ["5m", "1h", "4h", "1d", "1w"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan parquet") == 1


KEYS = ["symbol"]


def signals(spark, n, seed, symbols=("a", "b")):
    chance = random.Random(seed)
    rows = []
    for s in symbols:
        for i in range(n):
            flag = lambda: None if chance.random() < 0.05 else chance.random() < 0.2
            close = 0.0 if chance.random() < 0.01 else chance.uniform(50, 150)
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), close, flag(), flag(), i))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, entry boolean, exit boolean, i int")


@pytest.mark.parametrize(("block", "delay"), [(1, 1), (2, 1), (7, 0), (1000, 1)])
def test_blocks_equal_whole_windows(spark, block, delay):
    rows = signals(spark, 90, block)
    want = {(r.symbol, r.ts): r for r in P.evaluate(rows, KEYS, 0.002, delay).collect()}
    out = long_series.blocked_evaluate(rows, KEYS, F.floor(F.col("i") / block), 0.002, delay)
    got = out.collect()
    assert len(got) == len(want) == 180
    for r in got:
        w = want[r.symbol, r.ts]
        assert (r.pos, r.pos_after, r.h, r.h_before) == (w.pos, w.pos_after, w.h, w.h_before)
        for c in ("r", "equity", "drawdown"):
            assert r[c] == pytest.approx(w[c], rel=1e-9, abs=1e-12) or math.isnan(r[c]) and math.isnan(w[c])
    trips = lambda found: sorted(tuple(r) for r in found.select("symbol", "trade", "entry_time", "exit_time", "profit").collect())
    assert trips(long_series.blocked_trades(out, KEYS, None)) == trips(P.trades_log(P.evaluate(rows, KEYS, 0.002, delay), KEYS, None))


def test_one_series_is_spread_over_tasks(spark):
    rows = signals(spark, 400, 3, ("only",))
    out = long_series.blocked_latch(long_series.in_blocks(rows, F.floor(F.col("i") / 20)), KEYS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(counts) == 400 and len(counts) > 1 and max(counts) < 300


def test_no_rows(spark):
    none = signals(spark, 1, 1).limit(0)
    assert long_series.blocked_evaluate(none, KEYS, F.floor(F.col("i") / 2)).count() == 0

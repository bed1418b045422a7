"""Bars from an unbounded stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, symbol: str, ts: str, price: str, width: str, late: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of tumbling windows; ticks later than ``late`` are left out.

    First and last price go by time; state is one row for each open window and symbol. In append mode a bar is
    emitted once, after its window has closed.
    """
    windows = ticks.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(symbol).alias("symbol"))
    bars = windows.agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")

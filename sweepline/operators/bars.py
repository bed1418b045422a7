"""Bars: resampling, normalising, alignment, cached-only contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import float_text
from .frames import window_start

PRICES = ("open", "high", "low", "close")


def ticks_to_bars(ticks: DataFrame, symbol: str, ts: str, price: Column | str, order: str, unit: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) by time unit (``day``) or timeframe of n units (``4h``); first and last price
    by ``order``. Partial aggregation runs before the one shuffle."""
    p = F.col(price) if isinstance(price, str) else price
    start = window_start(ts, unit) if unit[:1].isdigit() else F.date_trunc(unit, ts).cast("timestamp_ntz")
    return ticks.groupBy(F.col(symbol).alias("symbol"), start.alias("ts")).agg(
        F.min_by(p, order).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, order).alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.max(order).alias("close_key"),
    )


def normalize_bars(frame: DataFrame, symbol: str | Column, ts: str) -> DataFrame:
    """Lower-case price columns, volume 0 where absent, fixed column order; each symbol's bars in one partition, by date.

    Missing price columns are an error at once, a frame without rows is one when the result is used. Windows by symbol need no further shuffle.
    """
    by_name = {c.lower(): c for c in frame.columns}
    missing = sorted(set(PRICES) - set(by_name))
    if missing:
        raise ValueError(f"Missing price columns: {', '.join(missing)}")
    volume = F.col(by_name["volume"]).cast("double") if "volume" in by_name else F.lit(0.0)
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    out = frame.select(name.alias("symbol"), F.col(ts).alias("date"), *(F.col(by_name[c]).cast("double").alias(c) for c in PRICES), volume.alias("volume"))
    # raised when the result is used; reading stops at the first row
    empty = frame.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(*(F.raise_error(F.lit("No bars")).cast(f.dataType).alias(f.name) for f in out.schema))
    return out.unionByName(empty).repartition("symbol").sortWithinPartitions("symbol", "date")


def data_fingerprint(bars: DataFrame, *keys: str) -> DataFrame:
    """``count:last timestamp:last close`` of each series, the close with all its digits: it is part of the cache key."""
    text = F.concat_ws(":", F.count("*").cast("string"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss"), float_text(F.max_by("close", "ts")))
    return bars.groupBy(*keys).agg(text.alias("fingerprint"))


def only_cached(jobs: DataFrame, bars: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(bars of the requested series, failures of those that have none)."""
    return bars.join(jobs.select(*keys).distinct(), list(keys), "left_semi"), jobs.join(bars.select(*keys).distinct(), list(keys), "left_anti")


def ingest_report(jobs: DataFrame, bars: DataFrame, *keys: str) -> DataFrame:
    counts = bars.groupBy(*keys).agg(F.count("*").alias("bars"))
    n = F.coalesce("bars", F.lit(0))
    return jobs.join(counts, list(keys), "left").select(*keys, n.alias("bars"), F.when(n > 0, "ok").otherwise("failed").alias("status"))


def align_signals(bars: DataFrame, signals: DataFrame, *keys: str) -> DataFrame:
    """Signals on bar dates; missing ones are false, those of other dates go."""
    return bars.join(signals, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("entry", "exit")})


def fill_forward_back(value: str, keys: list[str], ts: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(ts)
    past = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(past, F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def align_equity(bars: DataFrame, equity: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last equity of each date on the bars' dates, filled forward, then back; series without any equity go."""
    last = equity.groupBy(*keys, "ts").agg(F.max_by("equity", order).alias("equity"))
    joined = bars.select(*keys, "ts").join(last, [*keys, "ts"], "left")
    return joined.withColumn("equity", fill_forward_back("equity", keys, "ts")).filter("equity is not null")

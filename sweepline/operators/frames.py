"""Bars of any timeframe: fixed windows with an anchor, and bar states that merge.

A bar state is a bar with the keys of its first and last tick, so bars of a coarser timeframe come from states of a finer one
whose windows nest in it (5m in 1h in 4h in 1d in 1w), in any order and from any number of partial states.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
MONTHS = {"mo": 1, "q": 3, "y": 12}
ALIASES = {"wk": "w", "min": "m", "M": "mo"}
#: A Monday: weeks start on it, days at midnight.
ANCHOR = datetime.datetime(2000, 1, 3)
STATE = ("open", "high", "low", "close", "volume", "first_key", "last_key")


def parse_timeframe(timeframe: str) -> tuple[int, str]:
    """(number, unit) of texts such as 5m, 4h, 1d, 2w, 3mo; no number is 1. Others are an error."""
    found = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", timeframe.strip())
    unit = found and ALIASES.get(found[2], found[2].lower())
    unit = ALIASES.get(unit, unit)
    n = int(found[1] or 1) if found else 0
    if n < 1 or unit not in SECONDS and unit not in MONTHS:
        raise ValueError(f"Unknown timeframe: {timeframe!r}")
    return n, unit


def window_start(ts: Column | str, timeframe: str, anchor: datetime.datetime = ANCHOR) -> Column:
    """Start (timestamp without zone) of the window that holds ``ts``; windows of fixed length are counted from ``anchor``, those of
    months from its year's January. By the wall clock, whatever the session's zone."""
    n, unit = parse_timeframe(timeframe)
    at = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    if unit in MONTHS:
        length = n * MONTHS[unit]
        months = (F.year(at) - anchor.year) * 12 + F.month(at) - 1
        return F.add_months(F.trunc(at.cast("date"), "month"), -F.pmod(months, F.lit(length))).cast("timestamp_ntz")
    length = n * SECONDS[unit]
    day = at.cast("date")
    of_day = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    midnight = datetime.datetime.combine(anchor, datetime.time())
    seconds = F.datediff(day, F.lit(anchor.date())).cast("long") * 86_400 + of_day - (anchor - midnight).seconds
    start = of_day - F.pmod(seconds, F.lit(length))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), start.cast("decimal(18,6)"))


def _state(price: Column, key: Column, volume: Column) -> list[Column]:
    return [
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        F.sum(volume).alias("volume"), F.min(key).alias("first_key"), F.max(key).alias("last_key"),
    ]


def bars_of_frames(ticks: DataFrame, symbol: str, ts: str, price: Column | str, order: str, timeframes: list[str], volume: Column | str | None = None, anchor: datetime.datetime = ANCHOR) -> DataFrame:
    """(timeframe, symbol, ts, state) for all ``timeframes`` from one scan and one shuffle.

    The timeframes are grouping sets: each tick's windows are aggregated within its task, and only states are shuffled. First and last price
    go by ``order``, which is unique in a symbol; volume counts ticks unless it is given.
    """
    price = F.col(price) if isinstance(price, str) else price
    amount = F.lit(1.0) if volume is None else (F.col(volume) if isinstance(volume, str) else volume).cast("double")
    names = {t: f"_w{i}" for i, t in enumerate(timeframes)}
    rows = ticks.select(F.col(symbol).alias("symbol"), price.alias("_price"), F.col(order).alias("_key"), amount.alias("_volume"), *(window_start(ts, t, anchor).alias(w) for t, w in names.items()))
    sets = [[F.col("symbol"), F.col(w)] for w in names.values()]
    grouped = rows.groupingSets(sets, "symbol", *names.values()).agg(F.grouping_id().alias("_set"), *_state(F.col("_price"), F.col("_key"), F.col("_volume")))
    # the bit of a column is 0 in its own set
    width = len(names)
    which = {t: sum(1 << (width - 1 - j) for j in range(width) if j != i) for i, t in enumerate(timeframes)}
    name = reduce(lambda c, t: c.when(F.col("_set") == which[t], t), timeframes[1:], F.when(F.col("_set") == which[timeframes[0]], timeframes[0]))
    start = reduce(lambda c, t: c.when(F.col("_set") == which[t], F.col(names[t])), timeframes[1:], F.when(F.col("_set") == which[timeframes[0]], F.col(names[timeframes[0]])))
    return grouped.select(name.alias("timeframe"), "symbol", start.alias("ts"), *STATE)


def nests(fine: str, coarse: str) -> bool:
    """Whether each window of ``coarse`` is made of whole windows of ``fine``."""
    (n, u), (m, v) = parse_timeframe(fine), parse_timeframe(coarse)
    if u in MONTHS or v in MONTHS:
        if u in MONTHS and v in MONTHS:
            return m * MONTHS[v] % (n * MONTHS[u]) == 0
        return u in SECONDS and 86_400 % (n * SECONDS[u]) == 0
    return m * SECONDS[v] % (n * SECONDS[u]) == 0


def coarser(states: DataFrame, fine: str, coarse: str, anchor: datetime.datetime = ANCHOR) -> DataFrame:
    """States of ``coarse`` from (symbol, ts, state) of ``fine``; states of the same window, from other inputs or late ticks, merge too."""
    if not nests(fine, coarse):
        raise ValueError(f"{coarse} isn't made of whole {fine}")
    return states.groupBy("symbol", window_start("ts", coarse, anchor).alias("ts")).agg(
        F.min_by("open", "first_key").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_key").alias("close"),
        F.sum("volume").alias("volume"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"),
    )

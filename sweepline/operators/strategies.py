"""Strategies as columns of signals; ``sweeps`` has those in numpy and pandas."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_averages(bars: DataFrame, lengths: Iterable[int], keys: list[str]) -> DataFrame:
    """Adds ``sma_n`` for each distinct length, once per series, before any grid multiplies the rows."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return bars.withColumns({f"sma_{n}": F.avg("close").over(w.rowsBetween(1 - n, 0)) for n in sorted(set(lengths))})


def sma_cross(bars: DataFrame, grid: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """Entry while the fast average is over the slow one, exit otherwise; a row for each bar and combination."""
    lengths = sorted({n for pair in grid for n in pair})
    averaged = moving_averages(bars, lengths, keys)
    combos = [{"combo_id": i, "fast": a, "slow": b, "f": lengths.index(a), "s": lengths.index(b)} for i, (a, b) in enumerate(grid)]
    table = F.from_json(F.lit(json.dumps(combos)), "array<struct<combo_id:int,fast:int,slow:int,f:int,s:int>>")  # folded to a constant
    means = averaged.withColumn("_means", F.array(*(f"sma_{n}" for n in lengths))).drop(*(f"sma_{n}" for n in lengths))
    signals = F.transform(table, lambda g: F.struct(g["combo_id"], g["fast"], g["slow"], (F.get("_means", g["f"]) > F.get("_means", g["s"])).alias("entry")))
    crossed = means.select(*(c for c in means.columns if c != "_means"), F.inline(signals))
    return crossed.withColumn("exit", ~F.col("entry"))


def ternary(signal: Column) -> tuple[Column, Column]:
    """1 is entry, -1 exit; null neither."""
    return F.coalesce(signal == 1, F.lit(False)), F.coalesce(signal == -1, F.lit(False))

"""Positions, equity, drawdown and trades of series that are too long for one task.

A series is cut into blocks of time, and every window runs within a block. What comes before a block enters as a summary: the latch as a
function on {0, 1} (a constant, or the state kept or flipped), the count of bars, the last bar, the product of the returns and
its largest prefix. Summaries compose, so a window over the few blocks of a series gives each block's start, and a join on (keys, block)
brings it to the rows, which stay where they are. Results equal those of ``positions``, whose windows hold a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import position_latch

BLOCK = "_block"


def _in_block(keys: list[str]):
    return Window.partitionBy(*keys, BLOCK).orderBy("ts")


def _over_blocks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK)


def in_blocks(rows: DataFrame, block: Column) -> DataFrame:
    """``block`` grows with ``ts``, such as its month; blocks should have some 10^5 rows at most."""
    return rows.withColumn(BLOCK, block)


def _with(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(starts, [*keys, BLOCK])


def blocked_latch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``pos`` and ``pos_after`` as ``position_latch`` does."""
    upto = _in_block(keys).rowsBetween(Window.unboundedPreceding, 0)
    entry, exit_ = F.coalesce("entry", F.lit(False)), F.coalesce("exit", F.lit(False))
    within = position_latch(rows, [*keys, BLOCK]).withColumnRenamed("pos_after", "_from0").drop("pos")
    within = within.withColumn("_fixed", F.coalesce(F.max(entry != exit_).over(upto), F.lit(False)))
    ends = within.groupBy(*keys, BLOCK).agg(F.max_by("_from0", "ts").alias("end"), F.max("_fixed").alias("fixed"))
    # a block acts as one bar: it sets, clears, flips or keeps the state
    as_bar = ends.select(*keys, BLOCK, F.col(BLOCK).alias("ts"), (F.col("end") == 1).alias("entry"), (F.col("fixed") & (F.col("end") == 0) | ~F.col("fixed") & (F.col("end") == 1)).alias("exit"))
    starts = position_latch(as_bar, keys).select(*keys, BLOCK, F.col("pos").alias("_start"))
    joined = _with(within, starts, keys)
    after = F.when(F.col("_fixed"), F.col("_from0")).otherwise(F.pmod(F.col("_from0") + F.col("_start"), F.lit(2)))
    joined = joined.withColumn("pos_after", after)
    before = F.coalesce(F.lag("pos_after").over(_in_block(keys)), F.col("_start"))
    return joined.withColumn("pos", before).drop("_from0", "_fixed", "_start")


def blocked_returns(latched: DataFrame, keys: list[str], fee: float, fill_delay: int = 1, exit_on_last: bool = True) -> DataFrame:
    """Adds ``h``, ``h_before`` and ``r`` as ``hold`` and ``strategy_returns`` do."""
    fee = max(0.0, fee)
    held = F.col({0: "pos_after", 1: "pos"}[fill_delay])
    edges = latched.groupBy(*keys, BLOCK).agg(F.count("*").alias("n"), F.max_by(F.struct(held.alias("h"), "close"), "ts").alias("last"))
    w = _over_blocks(keys)
    starts = edges.select(
        *keys, BLOCK, F.coalesce(F.lag("last.h").over(w), F.lit(0)).alias("_h"), F.lag("last.close").over(w).alias("_close"),
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_bars"), F.lead(BLOCK).over(w).isNull().alias("_end"),
    )
    rows, own = _with(latched, starts, keys), _in_block(keys)
    place = F.row_number().over(own)
    last = F.col("_end") & F.lead("ts").over(own).isNull() if exit_on_last else F.lit(False)
    rows = rows.withColumn("h", F.when(last, 0).otherwise(held))
    rows = rows.withColumns({"h_before": F.when(place == 1, F.col("_h")).otherwise(F.lag("h").over(own)), "_before": F.when(place == 1, F.col("_close")).otherwise(F.lag("close").over(own)), "_place": place + F.col("_bars")})
    gain = F.try_divide("close", "_before") - 1
    first_fill = F.when(F.col("_place") == 2, 1 - fee * F.col("h_before")).otherwise(F.lit(1.0))
    r = (1 + F.col("h_before") * gain) * (1 - fee * F.abs(F.col("h") - F.col("h_before"))) * first_fill - 1
    return rows.withColumn("r", F.coalesce(r, F.lit(0.0))).drop("_h", "_close", "_bars", "_end", "_before", "_place")


def blocked_curves(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``equity`` and ``drawdown`` as ``curves`` does."""
    upto = _in_block(keys).rowsBetween(Window.unboundedPreceding, 0)
    within = returns.withColumn("_grown", F.product(1 + F.col("r")).over(upto)).withColumn("_peak", F.max("_grown").over(upto))
    before = _over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = within.groupBy(*keys, BLOCK).agg(F.max_by("_grown", "ts").alias("grown"), F.max("_peak").alias("peak"))
    blocks = blocks.withColumn("_base", F.coalesce(F.product("grown").over(before), F.lit(1.0)))
    starts = blocks.select(*keys, BLOCK, "_base", F.max(F.col("_base") * F.col("peak")).over(before).alias("_top"))
    rows = _with(within, starts, keys)
    equity = F.col("_base") * F.col("_grown")
    top = F.greatest(F.col("_top"), F.col("_base") * F.col("_peak"))  # a null one is passed over
    return rows.withColumns({"equity": equity, "drawdown": equity / top - 1}).drop("_grown", "_peak", "_base", "_top")


def blocked_trades(evaluated: DataFrame, keys: list[str], limit: int | None = 50) -> DataFrame:
    """Round trips as ``trades_log`` gives them; fills are numbered from the counts of the blocks before."""
    entry = (F.col("h") == 1) & (F.col("h_before") == 0)
    exit_ = (F.col("h") == 0) & (F.col("h_before") == 1)
    fills = evaluated.filter(entry | exit_).withColumn("_entry", entry.cast("long"))
    counts = fills.groupBy(*keys, BLOCK).agg(F.sum("_entry").alias("entries"))
    before = F.coalesce(F.sum("entries").over(_over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fills = _with(fills, counts.select(*keys, BLOCK, before.alias("_trades")), keys)
    fills = fills.withColumn("trade", F.col("_trades") + F.sum("_entry").over(_in_block(keys).rowsBetween(Window.unboundedPreceding, 0)))
    trips = fills.groupBy(*keys, "trade").agg(
        F.min("ts").alias("entry_time"), F.max("ts").alias("exit_time"), F.min_by("close", "ts").alias("entry_price"), F.max_by("close", "ts").alias("exit_price"), F.count("*").alias("_fills")
    )
    trips = trips.filter("_fills = 2" if limit is None else f"_fills = 2 and trade <= {limit}")
    return trips.withColumn("profit", F.col("exit_price") - F.col("entry_price")).drop("_fills")


def blocked_evaluate(signals: DataFrame, keys: list[str], block: Column, fee: float = 0.001, fill_delay: int = 1) -> DataFrame:
    """``positions.evaluate`` by blocks; keeps the block's column for ``blocked_trades``."""
    return blocked_curves(blocked_returns(blocked_latch(in_blocks(signals, block), keys), keys, fee, fill_delay), keys)

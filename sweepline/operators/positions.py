"""From signals to positions, returns, equity, drawdown and trades, by windows over one partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts")


def position_latch(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``pos`` (state before the bar's signals) and ``pos_after``.

    Entry alone sets, exit alone clears, both toggle. Closed form: the last set or clear, plus the toggles since, mod 2.
    """
    upto = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    entry, exit_ = F.coalesce("entry", F.lit(False)), F.coalesce("exit", F.lit(False))
    toggles = F.sum((entry & exit_).cast("int")).over(upto)
    fixed = signals.withColumn("_toggles", toggles).withColumn("_set", F.when(entry != exit_, entry.cast("int")))
    base = F.coalesce(F.last("_set", True).over(upto), F.lit(0))
    at = F.coalesce(F.last(F.when(F.col("_set").isNotNull(), F.col("_toggles")), True).over(upto), F.lit(0))
    after = fixed.withColumn("pos_after", F.pmod(base + F.col("_toggles") - at, F.lit(2)))
    return after.withColumn("pos", F.coalesce(F.lag("pos_after").over(_by(keys)), F.lit(0))).drop("_toggles", "_set")


def hold(latched: DataFrame, keys: list[str], fill_delay: int = 1, exit_on_last: bool = True) -> DataFrame:
    """Adds ``h``, the position held after the bar's close; the last bar closes it."""
    h = F.col({0: "pos_after", 1: "pos"}[fill_delay])
    if exit_on_last:
        h = F.when(F.lead("ts").over(_by(keys)).isNull(), 0).otherwise(h)
    return latched.withColumn("h", h)


def strategy_returns(held: DataFrame, keys: list[str], fee: float) -> DataFrame:
    """Adds ``r``: fully invested while held, ``fee`` of the notional on every fill at the close; the first bar's is 0."""
    w = _by(keys)
    fee = max(0.0, fee)
    before = F.coalesce(F.lag("h").over(w), F.lit(0))
    gain = F.try_divide("close", F.lag("close").over(w)) - 1
    first_fill = F.when(F.row_number().over(w) == 2, 1 - fee * before).otherwise(F.lit(1.0))  # a fill on bar 0 is paid on bar 1
    r = (1 + before * gain) * (1 - fee * F.abs(F.col("h") - before)) * first_fill - 1
    return held.withColumn("h_before", before).withColumn("r", F.coalesce(r, F.lit(0.0)))


def curves(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``equity``, the running product of 1 + r, and ``drawdown`` from its running maximum."""
    upto = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(1 + F.col("r")).over(upto))
    return grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(upto) - 1)


def evaluate(signals: DataFrame, keys: list[str], fee: float = 0.001, fill_delay: int = 1) -> DataFrame:
    return curves(strategy_returns(hold(position_latch(signals, keys), keys, fill_delay), keys, fee), keys)


def bar_returns(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Percent change of equity; the first is 0."""
    change = F.try_divide("equity", F.lag("equity").over(_by(keys))) - 1
    return equity.withColumn("r", F.coalesce(change, F.lit(0.0)))


def sample_curve(curve: DataFrame, keys: list[str], value: str, max_points: int = 500) -> DataFrame:
    """Every (n // max_points)-th point from the first on, and the last; nulls are left out first."""
    w = Window.partitionBy(*keys)
    rows = curve.filter(F.col(value).isNotNull() & ~F.isnan(value))
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_points))
    return rows.filter((F.pmod("_i", step) == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def trades_log(evaluated: DataFrame, keys: list[str], limit: int | None = 50) -> DataFrame:
    """The first round trips of each series, all with a ``limit`` of None: times, prices and profit per unit."""
    entry = (F.col("h") == 1) & (F.col("h_before") == 0)
    exit_ = (F.col("h") == 0) & (F.col("h_before") == 1)
    upto = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    fills = evaluated.withColumn("trade", F.sum(entry.cast("int")).over(upto)).filter(entry | exit_)
    trips = fills.groupBy(*keys, "trade").agg(
        F.min("ts").alias("entry_time"), F.max("ts").alias("exit_time"), F.min_by("close", "ts").alias("entry_price"), F.max_by("close", "ts").alias("exit_price"), F.count("*").alias("_fills")
    )
    trips = trips.filter("_fills = 2" if limit is None else f"_fills = 2 and trade <= {limit}")
    return trips.withColumn("profit", F.col("exit_price") - F.col("entry_price")).drop("_fills")


def whole_share_equity(trips: DataFrame, keys: list[str], cash: float = 10_000.0, fee: float = 0.001, fractional: bool = False) -> DataFrame:
    """Cash after the trips in order, buying whole shares (or fractions) with all cash, ``fee`` of each order."""
    shares = lambda c, t: c / (t.entry_price * (1 + fee)) if fractional else F.floor(c / (t.entry_price * (1 + fee)))
    step = lambda c, t: c - shares(c, t) * t.entry_price * (1 + fee) + shares(c, t) * t.exit_price * (1 - fee)
    ordered = F.array_sort(F.collect_list(F.struct("trade", "entry_price", "exit_price")))
    return trips.groupBy(*keys).agg(ordered.alias("trips")).select(*keys, F.aggregate("trips", F.lit(cash), step).alias("cash"), F.size("trips").alias("trades"))

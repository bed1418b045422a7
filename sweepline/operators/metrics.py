"""Statistics of returns and equity, as aggregate columns for one groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import close_to_zero, not_nan

NAN, INF = float("nan"), float("inf")


def _ratio(mean_excess: Column, spread: Column, n: Column) -> Column:
    """Spread 0 or undefined: 0 at no excess, else an infinity of its sign; no rows: NaN."""
    flat = spread.isNull() | F.isnan(spread) | (spread == 0)
    edge = F.when(close_to_zero(mean_excess), 0.0).when(mean_excess > 0, INF).otherwise(-INF)
    return F.when(n == 0, NAN).when(flat, edge).otherwise(mean_excess / spread)


def sharpe_ratio(r: str = "r", periods: int = 252, risk_free: float = 0.0) -> Column:
    x = not_nan(r)
    return _ratio(F.avg(x) * periods - risk_free, F.stddev_pop(x) * periods**0.5, F.count(x))


def sortino_ratio(r: str = "r", periods: int = 252, risk_free: float = 0.0) -> Column:
    """The spread is the population deviation of min(r, 0) about its own mean."""
    x = not_nan(r)
    return _ratio(F.avg(x) * periods - risk_free, F.stddev_pop(F.when(x > 0, 0.0).otherwise(x)) * periods**0.5, F.count(x))


def total_return(equity: str = "equity", ts: str = "ts") -> Column:
    return F.coalesce(F.try_divide(F.max_by(equity, ts), F.min_by(equity, ts)) - 1, F.lit(0.0))


def omega_ratio(r: str = "r", threshold: float = 0.0) -> Column:
    x = not_nan(r) - threshold
    gains, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0))
    return F.when(F.count(x) == 0, NAN).when(close_to_zero(losses), F.when(gains > 0, INF).otherwise(NAN)).otherwise(gains / losses)


def tail_ratio(r: str = "r", upper: float = 0.95, lower: float = 0.05) -> Column:
    x = not_nan(r)
    both = F.percentile(x, F.array(F.lit(upper), F.lit(lower)))  # one aggregate for the two quantiles
    high, low = F.abs(both[0]), F.abs(both[1])
    return F.when(F.count(x) == 0, NAN).when(close_to_zero(low), F.when(high > 0, INF).otherwise(NAN)).otherwise(high / low)


def pain_index(drawdown: str = "drawdown") -> Column:
    """Minus the mean of the negative drawdowns; 0 without any, NaN without rows."""
    d = not_nan(drawdown)
    return F.when(F.count(d) == 0, NAN).otherwise(F.coalesce(-F.avg(F.when(d < 0, d)), F.lit(0.0)))


def max_drawdown(drawdown: str = "drawdown") -> Column:
    return F.min(not_nan(drawdown))


def cagr(equity: str = "equity", ts: str = "ts", periods: int = 252) -> Column:
    """From the last equity over whole days / 365.25, or bars / periods within a day."""
    first, last, n = F.min_by(equity, ts), F.max_by(equity, ts), F.count(equity)
    days = F.timestamp_diff("DAY", F.min(ts), F.max(ts))
    years = F.when(days > 0, days / 365.25).otherwise(n / F.lit(float(periods)))
    return F.when((n < 2) | (first <= 0) | (last <= 0) | (years <= 0), NAN).otherwise(F.power(last, 1 / years) - 1)


def calmar(cagr_: str = "cagr", drawdown: str = "max_drawdown") -> Column:
    c, d = F.col(cagr_), F.col(drawdown)
    ok = (d < 0) & ~F.isnan(c) & ~c.isin(INF, -INF)
    return F.when(ok, c / F.abs(d)).otherwise(NAN)


def trade_count() -> Column:
    return F.sum(((F.col("h") == 0) & (F.col("h_before") == 1)).cast("long"))


def all_statistics(evaluated: DataFrame, keys: list[str], periods: int = 252) -> DataFrame:
    """The ten statistics of every series in one aggregation."""
    found = evaluated.groupBy(*keys).agg(
        sharpe_ratio(periods=periods).alias("sharpe"),
        sortino_ratio(periods=periods).alias("sortino"),
        omega_ratio().alias("omega"),
        tail_ratio().alias("tail_ratio"),
        total_return().alias("profit"),
        pain_index().alias("pain_index"),
        max_drawdown().alias("max_drawdown"),
        cagr(periods=periods).alias("cagr"),
        trade_count().alias("trades"),
    )
    return found.withColumn("calmar", calmar())


OBJECTIVES = {"sharpe": "sharpe", "sortino": "sortino", "profit": "profit"}


def objective(name: str) -> Column:
    """The statistic that a metric name stands for; others are an error."""
    if name.lower() not in OBJECTIVES:
        raise ValueError(f"Unsupported metric: {name}")
    return F.col(OBJECTIVES[name.lower()])

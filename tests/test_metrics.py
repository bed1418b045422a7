import datetime
import math

import pytest
from pyspark.sql import functions as F

from sweepline.operators import metrics as M


def series(spark, values, name="r"):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(start + datetime.timedelta(days=i), v) for i, v in enumerate(values)], f"ts timestamp_ntz, {name} double")


def value(spark, column, values, name="r"):
    return series(spark, values, name).agg(column.alias("v")).first().v


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("column", "values", "want"),
    [
        (lambda: M.omega_ratio(), [0.06, -0.02, 0.04, -0.03], 2.0),
        (lambda: M.tail_ratio(), [-0.1 + 0.02 * i for i in range(21)], 3.5),
        (lambda: M.sharpe_ratio(), [0.0, 0.0], 0.0),
        (lambda: M.sharpe_ratio(), [0.01, 0.01], INF),
        (lambda: M.sharpe_ratio(), [-0.01, -0.01], -INF),
        (lambda: M.sharpe_ratio(), [], NAN),
        (lambda: M.sharpe_ratio(), [None, NAN], NAN),
        (lambda: M.sortino_ratio(), [0.01, 0.02], INF),
        (lambda: M.sortino_ratio(), [0.0], 0.0),
        (lambda: M.sortino_ratio(), [], NAN),
        (lambda: M.omega_ratio(), [0.1, 0.2], INF),
        (lambda: M.omega_ratio(), [0.0], NAN),
        (lambda: M.omega_ratio(), [], NAN),
        (lambda: M.tail_ratio(), [0.0, 0.0], NAN),
        (lambda: M.tail_ratio(), [0.0] * 30 + [1.0, 1.0, 1.0], INF),
        (lambda: M.tail_ratio(), [], NAN),
    ],
)
def test_ratios(spark, column, values, want):
    got = value(spark, column(), values)
    assert math.isnan(got) if math.isnan(want) else got == pytest.approx(want, rel=1e-3)


def test_sharpe_and_sortino_by_hand(spark):
    r = [0.01, -0.005, 0.02, 0.015, -0.01]
    mean = sum(r) / 5
    sd = math.sqrt(sum((x - mean) ** 2 for x in r) / 5)
    down = [min(x, 0) for x in r]
    dmean = sum(down) / 5
    dd = math.sqrt(sum((x - dmean) ** 2 for x in down) / 5)
    assert value(spark, M.sharpe_ratio(), r) == pytest.approx(mean * 252 / (sd * math.sqrt(252)))
    assert value(spark, M.sortino_ratio(), r) == pytest.approx(mean * 252 / (dd * math.sqrt(252)))


def test_equity_statistics(spark):
    equity = series(spark, [2.0, 1.5, 1.8, 2.4, 2.1], "equity")
    rows = [0.0, -0.25, -0.1, 0.0, -0.125]
    assert value(spark, M.pain_index(), rows, "drawdown") == pytest.approx(0.475 / 3)
    assert value(spark, M.pain_index(), [0.0, 0.0], "drawdown") == 0.0
    assert math.isnan(value(spark, M.pain_index(), [], "drawdown"))
    assert value(spark, M.max_drawdown(), rows, "drawdown") == pytest.approx(-0.25)
    assert equity.agg(M.total_return().alias("v")).first().v == pytest.approx(0.05)
    assert series(spark, [1.0, 2.0], "equity").agg(M.cagr().alias("v")).first().v > 0
    assert math.isnan(series(spark, [1.0], "equity").agg(M.cagr().alias("v")).first().v)
    assert math.isnan(series(spark, [1.0, -1.0], "equity").agg(M.cagr().alias("v")).first().v)


def test_calmar_needs_a_drawdown(spark):
    rows = spark.createDataFrame([(0.1, -0.2), (0.1, 0.0), (NAN, -0.2)], "cagr double, max_drawdown double")
    got = [r.v for r in rows.select(M.calmar().alias("v")).collect()]
    assert got[0] == pytest.approx(0.5) and math.isnan(got[1]) and math.isnan(got[2])


def test_unknown_objective():
    with pytest.raises(ValueError):
        M.objective("magic")


def test_objective_names(spark):
    assert spark.range(1).select(F.lit(1.0).alias("profit")).select(M.objective("Profit").alias("v")).first().v == 1.0

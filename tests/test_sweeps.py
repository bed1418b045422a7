"""Sweeps in numpy equal the window functions, whatever the slices and blocks."""

import math

import pytest
from pyspark.sql import functions as F

from sweepline.operators import sweeps
from sweepline.operators.metrics import all_statistics
from sweepline.operators.positions import evaluate
from sweepline.operators.strategies import sma_cross
from sweepline.plans import fixtures as X

GRID = [(2, 5), (3, 8), (5, 5), (8, 3), (10, 400)]


def same(a, b):
    return a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("per_task", "cells"), [(256, 1 << 21), (2, 1), (1, 500)])
def test_statistics_equal_the_windows(spark, data, monkeypatch, per_task, cells):
    monkeypatch.setattr(sweeps, "CELLS", cells)
    bars = X.bars_orders(spark, data)
    want = {(r.symbol, r.combo_id): r for r in all_statistics(evaluate(sma_cross(bars, GRID, ["symbol"]), X.KEYS, X.FEE), X.KEYS).collect()}
    got = sweeps.sweep_statistics(bars, sweeps.combos_table(spark, GRID), ["symbol"], fee=X.FEE, per_task=per_task).collect()
    assert len(got) == len(want) == 25
    for row in got:
        other = want[row.symbol, row.combo_id]
        for c in (*X.STATS, "trades"):
            assert same(row[c], other[c]), (c, row, other)


def test_signals_that_are_both_set_toggle(spark, data):
    bars = X.signals_flip(spark, data)
    want = {r.symbol: r for r in all_statistics(evaluate(bars, X.KEYS, X.FEE, fill_delay=0), X.KEYS).collect()}

    def flags(series, combos):
        pick = lambda name: series[name][:, None].astype(bool).repeat(len(combos), 1)
        return pick("entry"), pick("exit")

    got = sweeps.sweep_statistics(bars, sweeps.combos_table(spark, [(1, 1)]), ["symbol"], flags, X.FEE, 0, columns=("close", "entry", "exit")).collect()
    assert len(got) == 5 and all(same(r[c], want[r.symbol][c]) for r in got for c in (*X.STATS, "trades"))


def test_short_flat_and_missing_series(spark):
    rows = [("one", 0, 5.0)] + [("flat", i, 7.0) for i in range(6)] + [("gap", i, None if i == 2 else 1.0 + i) for i in range(6)]
    bars = spark.createDataFrame(rows, "symbol string, i int, close double").withColumn("ts", F.timestamp_seconds(F.col("i") * 86400).cast("timestamp_ntz"))
    got = {r.symbol: r for r in sweeps.sweep_statistics(bars, sweeps.combos_table(spark, [(1, 2)]), ["symbol"]).collect()}
    assert got["one"].profit == 0.0 and math.isnan(got["one"].cagr) and got["one"].trades == 0
    assert got["flat"].sharpe == 0.0 and math.isnan(got["flat"].omega) and got["flat"].max_drawdown == 0.0
    assert math.isfinite(got["gap"].profit)
    none = sweeps.sweep_statistics(bars, sweeps.combos_table(spark, [(1, 2)]).limit(0), ["symbol"])
    assert none.count() == 0 and sweeps.sweep_statistics(bars.limit(0), sweeps.combos_table(spark, [(1, 2)]), ["symbol"]).count() == 0


def test_one_exchange_of_bars_and_none_of_the_grid(spark, data):
    bars = spark.createDataFrame([("a", 1.0)], "symbol string, close double").withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
    for plan in (
        sweeps.sweep_statistics(bars, sweeps.combos_table(spark, GRID), ["symbol"]),
        sweeps.pandas_strategy(bars, spark.createDataFrame([(0, {"a": "5"})], "grid_ordinal int, params map<string,string>"), ["symbol"], lambda f, p: (f.close > 0, f.close < 0)),
    ):
        text = plan._jdf.queryExecution().sparkPlan().toString() + plan._jdf.queryExecution().executedPlan().toString()
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_grid_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "MOST_COMBOS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        sweeps.configured(spark.range(4).toDF("combo_id"))

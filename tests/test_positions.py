import datetime
import random

import pytest

from sweepline.operators import positions as P


def frame(spark, rows, schema):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", start + datetime.timedelta(days=i), *r) for i, r in enumerate(rows)], f"k string, ts timestamp_ntz, {schema}")


def loop(signals):
    state, before, after = 0, [], []
    for entry, exit_ in signals:
        before.append(state)
        state = 1 if not state and entry else 0 if state and exit_ else state
        after.append(state)
    return before, after


def test_latch_equals_a_state_loop(spark):
    rng = random.Random(3)
    signals = [(rng.random() < 0.3, rng.random() < 0.3) for _ in range(3000)]
    rows = P.position_latch(frame(spark, signals, "entry boolean, exit boolean"), ["k"]).orderBy("ts").collect()
    before, after = loop(signals)
    assert [r.pos for r in rows] == before
    assert [r.pos_after for r in rows] == after


def test_null_signals_count_as_false(spark):
    rows = P.position_latch(frame(spark, [(True, None), (None, None), (None, True), (None, None)], "entry boolean, exit boolean"), ["k"]).orderBy("ts").collect()
    assert [r.pos_after for r in rows] == [1, 1, 0, 0]


@pytest.mark.parametrize("delay", [0, 1])
def test_returns_equal_a_loop(spark, delay):
    rng = random.Random(5)
    signals = [(rng.random() < 0.3, rng.random() < 0.3, 100 + rng.random() * 10) for _ in range(200)]
    rows = P.evaluate(frame(spark, signals, "entry boolean, exit boolean, close double"), ["k"], 0.001, delay).orderBy("ts").collect()
    before, after = loop([s[:2] for s in signals])
    held = (before if delay else after)[:-1] + [0]
    equity, top = 1.0, 1.0
    for i, row in enumerate(rows):
        r = 0.0
        if i:
            r = (1 + held[i - 1] * (signals[i][2] / signals[i - 1][2] - 1)) * (1 - 0.001 * abs(held[i] - held[i - 1])) - 1
            if i == 1:
                r = (1 + r) * (1 - 0.001 * held[0]) - 1
        equity *= 1 + r
        top = max(top, equity)
        assert row.r == pytest.approx(r, abs=1e-12)
        assert row.equity == pytest.approx(equity, rel=1e-12)
        assert row.drawdown == pytest.approx(equity / top - 1, abs=1e-12)


def test_sample_keeps_first_and_last(spark):
    curve = frame(spark, [(float(i),) for i in range(1203)] + [(None,)], "equity double")
    got = [r.equity for r in P.sample_curve(curve, ["k"], "equity", 500).orderBy("ts").collect()]
    assert got == [float(i) for i in range(0, 1203, 2)]
    got = [r.equity for r in P.sample_curve(curve.filter("equity < 1202"), ["k"], "equity", 500).orderBy("ts").collect()]
    assert got[-2:] == [1200.0, 1201.0]


def test_trades_and_whole_shares(spark):
    signals = [(True, False, 10.0), (False, False, 11.0), (False, True, 12.0), (False, False, 13.0), (True, False, 14.0), (False, False, 15.0)]
    done = P.evaluate(frame(spark, signals, "entry boolean, exit boolean, close double"), ["k"], 0.0, 1)
    trips = P.trades_log(done, ["k"])
    assert [(t.entry_price, t.exit_price, t.profit) for t in trips.orderBy("trade").collect()] == [(11.0, 13.0, 2.0)]
    cash = P.whole_share_equity(trips, ["k"], cash=100.0, fee=0.0).first()
    assert cash.cash == 100 + 9 * 2 and cash.trades == 1
    assert P.whole_share_equity(trips, ["k"], cash=110.0, fee=0.0, fractional=True).first().cash == pytest.approx(130.0)


def test_empty_bars(spark):
    empty = frame(spark, [], "entry boolean, exit boolean, close double")
    assert P.evaluate(empty, ["k"]).count() == 0


def test_whole_share_equity_over_more_than_fifty_trips(spark):
    trips = 60
    rows = [("a", i, 100.0 + i, int(i % 2 == 0), int(i % 2 == 1)) for i in range(2 * trips)]
    done = spark.createDataFrame(rows, "k string, ts long, close double, h int, h_before int")
    got = P.whole_share_equity(P.trades_log(done, ["k"], limit=None), ["k"], cash=1_000_000.0).first()
    cash = 1_000_000.0
    for t in range(trips):
        shares = cash // ((100.0 + 2 * t) * 1.001)
        cash += shares * ((101.0 + 2 * t) * 0.999 - (100.0 + 2 * t) * 1.001)
    assert got.trades == trips and abs(got.cash - cash) < 1e-3
    assert P.trades_log(done, ["k"]).count() == 50


def test_query_folds_every_trip(spark, data):
    from sweepline.plans import registry

    folded = {(r.symbol, r.combo_id): r.trades for r in registry.QUERIES["whole_share_equity"](spark, data).collect()}
    counted = {(r.symbol, r.combo_id): r.trades for r in registry.QUERIES["trade_count"](spark, data).collect()}
    assert folded == counted

"""States of runs, sketches of values, the inventory of files."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sweepline.operators import run_states as RS
from sweepline.operators import sketches as K
from sweepline.operators import summary as U
from sweepline.plans import fixtures as X
from sweepline.sources import inventory


def rows_of(df, *columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


def test_states_equal_the_whole_recomputation(spark, data, tmp_path):
    results = X.results(spark, data)
    store = RS.states_store(spark, f"file://{tmp_path}/states")
    for i in (0, 1, 2, 3, 2):  # one batch again
        RS.record(store, results.filter(F.col("ordinal") % 4 == i), f"b{i}")
    state = RS.merged(store.read())
    assert rows_of(RS.counts(state), "run_id", "results", "symbols", "strategies") == rows_of(U.summary_counts(results, ["run_id"]), "run_id", "results", "symbols", "strategies")
    names = ("run_id", "metric", "mean", "min", "max", "direction")
    assert rows_of(RS.metric_ranges(state), *names) == rows_of(U.summary_metrics(results, ["run_id"]), *names)
    places = ("run_id", "metric", *U.PLACE, "value")
    assert rows_of(RS.best_rows(state), *places) == rows_of(U.summary_best(results, ["run_id"]), *places)
    assert {r.metric for r in RS.metrics_seen(state).collect()} == set(U.METRICS)


def test_a_listing_opens_the_states_alone(spark, data, tmp_path):
    store = RS.states_store(spark, f"file://{tmp_path}/states")
    RS.record(store, X.results(spark, data), "all")
    files = RS.counts(RS.merged(store.read())).inputFiles()
    assert files and all("/states/" in f for f in files)


def test_merging_is_associative_and_blank_names_dont_count(spark):
    schema = "run_id string, collection string, symbol string, timeframe string, strategy string, ordinal long, sharpe double"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    a = make(("r", "c", "A", "1d", "s", 1, 2.0), ("r", "c", "", None, "s", 2, float("nan")))
    b = make(("r", "c", "B", "1d", "s", 0, 2.0), ("q", "c", "B", "1d", "s", 9, None))
    states = [RS.run_states(x, str(i), ["sharpe"]) for i, x in enumerate((a, b))]
    whole = RS.merged(RS.run_states(a.unionByName(b), "x", ["sharpe"]))
    parts = RS.merged(states[1].unionByName(states[0]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    got = {r.run_id: r for r in RS.counts(parts).collect()}
    assert (got["r"].results, got["r"].symbols, got["r"].timeframes, got["q"].results) == (3, 2, 1, 1)
    assert [(r.run_id, r.symbol, r.value) for r in RS.best_rows(parts).collect()] == [("r", "B", 2.0)]  # the first on ties


def values(kind):
    chance = random.Random(11)
    return {
        "normal": [chance.gauss(0, 1) for _ in range(3000)],
        "wide": [math.copysign(10 ** chance.uniform(-9, 9), chance.random() - 0.3) for _ in range(3000)],
        "ties": [1.5] * 1000 + [-2.0] * 900 + [0.0] * 300,
        "one": [0.25],
        "zeros": [0.0, -0.0, 1e-300],
    }[kind]


SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["normal", "wide", "ties", "one", "zeros"])
@pytest.mark.parametrize("error", [0.01, 0.001])
def test_quantiles_within_the_stated_error(spark, kind, error):
    given = values(kind)
    rows = spark.createDataFrame([("k", v) for v in given + [float("nan"), float("inf"), None]], "k string, v double")
    halves = [K.sketch(rows.filter(F.pmod(F.hash("v"), F.lit(2)) == i), ["k"], "v", error) for i in (0, 1)]
    found = {r.share: r.value for r in K.quantiles(K.merged_sketch(halves[0].unionByName(halves[1]), ["k"]), ["k"], SHARES, error).collect()}
    exact = sorted(given)
    for share in SHARES:
        true = exact[math.floor(share * (len(exact) - 1))]
        assert abs(found[share] - true) <= error * abs(true) * (1 + 1e-9) + K.TINY


def test_histogram_counts_every_finite_value_once(spark):
    rows = spark.createDataFrame([(k, v) for k in ("normal", "ties", "one") for v in values(k)] + [("normal", float("inf"))], "k string, v double")
    got = K.histogram(rows, ["k"], "v", 10).collect()
    for k in ("normal", "ties", "one"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.bin)
        assert sum(r.n for r in mine) == len(values(k)) and all(r.low <= r.high for r in mine)
    spread = [r.n for r in got if r.k == "normal"]
    assert len(spread) == 10 and max(spread) < 1.2 * 300  # edges are quantiles: even counts
    assert K.histogram(rows.limit(0), ["k"], "v").count() == 0


def listed(spark, *rows):
    return spark.createDataFrame([(p, s, dt.datetime.fromisoformat(m)) for p, s, m in rows], "path string, size long, modified timestamp_ntz")


def test_an_inventory_is_compared_by_path_and_time(spark, tmp_path):
    store = inventory.inventory_store(spark, f"file://{tmp_path}/inv")
    roots, now = ["reports"], dt.datetime(2024, 3, 1)
    inventory.refresh(store, listed(spark, ("reports/a", 1, "2024-01-01"), ("reports/b", 2, "2024-01-02"), ("reports/b", 3, "2024-01-03"), ("reports-old/c", 9, "2020-01-01")), roots, now)
    inventory.refresh(store, listed(spark, ("reports/a", 1, "2024-01-01"), ("reports/d", 4, "2024-02-01")), roots, now + dt.timedelta(days=1))
    got = {r.path: (r.size, r.gone, r.seen_at.day) for r in store.read().collect()}
    assert got == {"reports/a": (1, False, 1), "reports/b": (3, True, 2), "reports/d": (4, False, 2)}
    same = listed(spark, ("reports/a", 1, "2024-01-01"), ("reports/d", 4, "2024-02-01"))
    assert inventory.changes(store.read(), same, roots, now).count() == 0
    back = listed(spark, ("reports/a", 1, "2024-01-01"), ("reports/b", 3, "2024-01-03"), ("reports/d", 5, "2024-02-01"))
    assert {r.path for r in inventory.changes(store.read(), back, roots, now).collect()} == {"reports/b", "reports/d"}


def test_the_boundary_day(spark):
    files = spark.createDataFrame([(p, 1, dt.datetime.fromisoformat(m), g, None) for p, m, g in [("r/just", "2024-01-31T12:00:00", False), ("r/less", "2024-01-31T12:00:01", False), ("r/gone", "2020-01-01", True), ("other/x", "2020-01-01", False), ("r/future", "2025-01-01", False)]], inventory.FILES)
    now = dt.datetime(2024, 3, 1, 12)
    assert [(r.path, r.age_days) for r in inventory.past_keep(files, ["r"], 30, now).collect()] == [("r/just", 30)]
    assert [r.path for r in inventory.past_keep(files, ["r/"], 29, now).orderBy("path").collect()] == ["r/just", "r/less"]
    assert inventory.past_keep(files, [], 0, now).count() == 0


def test_listing_of_real_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("abc")
    (tmp_path / "b.txt").write_text("b")
    got = {r.path.rsplit("/", 1)[1]: r.size for r in inventory.listing(spark, [f"file://{tmp_path}"]).collect()}
    assert got == {"a.txt": 3, "b.txt": 1}

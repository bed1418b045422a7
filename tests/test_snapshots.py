"""Stored results and stored bars: no write loses another's rows, a failed one changes nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sweepline.sources import storage
from sweepline.sources.snapshots import LostRace, SnapshotTable

RESULTS = "collection string, symbol string, params string, metric_value double, run_id string, ordinal long"
KEYS = ["collection", "symbol", "params"]


def results(spark, rows):
    return spark.createDataFrame(rows, RESULTS)


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/results", KEYS, buckets=8)


def held(table, *columns):
    return sorted(tuple(r) for r in table.read().select(*columns).collect())


def part_files(table):
    return {b: c["folder"] for b, c in table.snapshot()["cells"].items()}


def test_two_upserts_with_a_failed_one_between(spark, table):
    first = results(spark, [("demo", s, "{}", float(i), "run-1", i) for i, s in enumerate(["AAA", "BBB", "CCC", "DDD"])])
    assert table.upsert(first, "ordinal") == 1
    before = held(table, *first.columns)
    broken = first.withColumn("metric_value", F.when(F.col("symbol") == "CCC", F.raise_error(F.lit("bad")).cast("double")).otherwise(F.lit(9.0)))
    with pytest.raises(Exception, match="bad"):
        table.upsert(broken, "ordinal")
    assert table.versions() == [1] and held(table, *first.columns) == before
    assert table.upsert(results(spark, [("demo", "BBB", "{}", 7.5, "run-2", 9), ("demo", "EEE", "{}", 1.0, "run-2", 10)]), "ordinal") == 2
    assert held(table, "symbol", "metric_value", "run_id") == [("AAA", 0.0, "run-1"), ("BBB", 7.5, "run-2"), ("CCC", 2.0, "run-1"), ("DDD", 3.0, "run-1"), ("EEE", 1.0, "run-2")]
    assert sorted(r.metric_value for r in table.read(version=1).collect()) == [0.0, 1.0, 2.0, 3.0]  # an open snapshot stays


def test_failure_after_the_data_is_written(spark, table, monkeypatch):
    table.upsert(results(spark, [("demo", "AAA", "{}", 1.0, "r", 1)]), "ordinal")
    monkeypatch.setattr(table, "_publish", lambda snapshot: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.upsert(results(spark, [("demo", "AAA", "{}", 2.0, "r", 2)]), "ordinal")
    assert held(table, "metric_value") == [(1.0,)]


def test_untouched_buckets_keep_their_files(spark, table):
    table.upsert(results(spark, [("demo", f"S{i}", "{}", 0.0, "r", i) for i in range(64)]), "ordinal")
    before = part_files(table)
    table.upsert(results(spark, [("demo", "S1", "{}", 5.0, "r", 99)]), "ordinal")
    after = part_files(table)
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1


def test_a_later_session_finds_what_was_stored(spark, table):
    table.upsert(results(spark, [("demo", "AAA", "{}", 1.25, "run-1", 1), (None, "NUL", "{}", 3.0, "run-1", 2)]), "ordinal")
    later = SnapshotTable(spark.newSession(), table.root, KEYS, buckets=8)
    candidates = later.spark.createDataFrame([("demo", "AAA", "{}"), ("demo", "AAA", '{"x":1}'), (None, "NUL", "{}")], "collection string, symbol string, params string")
    got = {(r.symbol, r.params): (r.stored_value, r.hit) for r in later.lookup(candidates, "metric_value").collect()}
    assert got == {("AAA", "{}"): (1.25, True), ("AAA", '{"x":1}'): (None, False), ("NUL", "{}"): (3.0, True)}


def test_lookup_opens_only_the_buckets_of_its_keys(spark, table):
    table.upsert(results(spark, [("demo", f"S{i}", "{}", 0.0, "r", i) for i in range(64)]), "ordinal")
    wanted = spark.createDataFrame([("demo", "S1", "{}")], "collection string, symbol string, params string")
    opened = {f.split("_cell=")[1].split("/")[0] for f in table.lookup(wanted, "metric_value").inputFiles()}
    assert len(opened) == 1


def test_empty_table_repeated_keys_and_an_added_column(spark, table):
    none = results(spark, [])
    assert table.lookup(none, "metric_value").count() == 0
    with pytest.raises(ValueError, match="Nothing is stored"):
        table.read()
    table.upsert(none, "ordinal")
    assert table.read().count() == 0
    table.upsert(results(spark, [("demo", "HOT", "{}", float(i), "r", i) for i in range(500)]), "ordinal")
    assert held(table, "metric_value") == [(499.0,)]
    wider = results(spark, [("demo", "NEW", "{}", 1.0, "r", 1)]).withColumn("engine", F.lit("2"))
    table.upsert(wider, "ordinal")
    assert held(table, "symbol", "engine") == [("HOT", None), ("NEW", "2")]
    table.upsert(results(spark, [("demo", "NEW", "{}", 2.0, "r", 2)]), "ordinal")
    assert held(table, "symbol", "metric_value", "engine") == [("HOT", 499.0, None), ("NEW", 2.0, None)]


def test_a_lost_race_is_an_error_and_vacuum_keeps_what_is_named(spark, table):
    one = results(spark, [("demo", "AAA", "{}", 1.0, "r", 1)])
    table.upsert(one, "ordinal")
    other = SnapshotTable(spark, table.root, KEYS, buckets=8)
    stale = other.snapshot()
    table.upsert(results(spark, [("demo", "BBB", "{}", 2.0, "r", 2)]), "ordinal")
    other.snapshot = lambda version=None: stale
    with pytest.raises(LostRace):
        other.upsert(results(spark, [("demo", "CCC", "{}", 3.0, "r", 3)]), "ordinal")
    assert held(table, "symbol") == [("AAA",), ("BBB",)]
    assert table.vacuum(keep=1) and table.versions() == [2]
    assert held(table, "symbol") == [("AAA",), ("BBB",)] and table.vacuum(keep=1) == []


def bars(spark, source, timeframe, symbol, n, price=10.0):
    start = dt.datetime(2024, 1, 1)
    rows = [(symbol, start + dt.timedelta(days=i), price, price + 1, price - 1, price + i, 100.0, source, timeframe) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, source string, timeframe string")


def test_a_second_source_leaves_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    storage.bars_parquet_sink(bars(spark, "one", "1d", "A/B", 3), path)
    storage.bars_parquet_sink(bars(spark, "two", "1d", "A/B", 4), path)
    storage.bars_parquet_sink(bars(spark, "one", "1h", "A/B", 5), path)
    storage.bars_parquet_sink(bars(spark, "one", "1d", "A-B", 6), path)
    count = lambda source, timeframe, symbols=None: storage.bars_parquet_scan(spark, path, source, timeframe, symbols).count()
    assert [count("one", "1d"), count("two", "1d"), count("one", "1h"), count("one", "1d", ["A/B"]), count("none", "1d")] == [9, 4, 5, 3, 0]
    storage.bars_parquet_sink(bars(spark, "one", "1d", "A/B", 2, price=50.0), path)  # replaced as a whole
    assert [count("one", "1d", ["A/B"]), count("one", "1d", ["A-B"]), count("two", "1d")] == [2, 6, 4]


def rows_scanned(df):
    """Rows that the Parquet scan gave to Spark, by its metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        elif "Scan parquet" in node.nodeName():
            return node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_a_scan_of_one_symbol_reads_fewer_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    many = spark.range(60_000).select(
        F.concat(F.lit("S"), F.lpad((F.col("id") % 60).cast("string"), 2, "0")).alias("symbol"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        *((F.col("id") % 97 + i).cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))),
        F.lit("one").alias("source"), F.lit("1m").alias("timeframe"),
    )
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "16384")
    try:
        storage.bars_parquet_sink(many, path, buckets=2)
    finally:
        hadoop.unset("parquet.block.size")
    assert rows_scanned(storage.bars_parquet_scan(spark, path, "one", "1m", buckets=2)) == 60_000
    few = storage.bars_parquet_scan(spark, path, "one", "1m", ["S07"], buckets=2)
    assert rows_scanned(few) < 6_000 and few.count() == 1_000

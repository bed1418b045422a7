"""Payloads of many sources in one table: bars and failures from one scan."""

import pytest
from pyspark.sql import functions as F

from sweepline.sources import payloads as L

SCHEMA = "source string, symbol string, timeframe string, payload string"
GOOD = '{"results":[{"t":1000,"o":1,"h":2,"l":0.5,"c":1.5,"v":10}]}'


def found(spark, *rows):
    return L.outcomes(spark.createDataFrame(list(rows), SCHEMA))


def errors(out):
    return {r.symbol: (r.stage, r.error) for r in L.failures_of(out).collect()}


def test_both_outputs_of_a_mixed_table(spark):
    out = found(
        spark,
        ("polygon", "GOOD", "1d", GOOD),
        ("Polygon", "CASE", "1d", GOOD),
        ("polygon", "CUT", "1d", GOOD[:-4]),
        ("polygon", "TYPE", "1d", GOOD.replace('"o":1', '"o":"x"')),
        ("polygon", "NONE", "1d", '{"status":"OK"}'),
        ("polygon", "BLANK", "1d", "  "),
        ("polygon", "NULL", "1d", None),
        ("nowhere", "WHO", "1d", GOOD),
        (None, "NOBODY", "1d", GOOD),
        ("finnhub", "NODATA", "1d", '{"s":"no_data"}'),
        ("twelvedata", "WORD", "1d", '{"values":[{"datetime":"2024-01-01","open":"1","high":"1","low":"1","close":"n/a","volume":"1"}]}'),
        ("twelvedata", "DATE", "1d", '{"values":[{"datetime":"soon","open":"1","high":"1","low":"1","close":"1","volume":"1"}]}'),
        ("alphavantage", "FX", "1d", '{"Time Series FX (Daily)":{"2024-01-02":{"1. open":"1.5","2. high":"2","3. low":"1","4. close":"1.75"}}}'),
        ("ccxt", "ROWS", "1d", "[[1000,1,2,0.5,1.5,10],[2000,1,2,0.5,1.5]]"),
        ("ccxt", "TEXT", "1d", "<html>busy</html>"),
        ("alpaca", "ASKED", "1d", '{"bars":{"A":[{"t":"2024-01-01T00:00:00Z","o":1,"h":1,"l":1,"c":1,"v":1}],"B":[]}}'),
    )
    assert errors(out) == {
        "CUT": ("parse", "Broken payload from Polygon for CUT"),
        "TYPE": ("parse", "Broken payload from Polygon for TYPE"),
        "NONE": ("normalize", "No data from Polygon for NONE"),
        "BLANK": ("fetch", "Empty payload from Polygon for BLANK"),
        "NULL": ("fetch", "Empty payload from Polygon for NULL"),
        "WHO": ("route", "Unsupported source: nowhere"),
        "NOBODY": ("route", "Unsupported source: ?"),
        "NODATA": ("normalize", "No data from Finnhub for NODATA"),
        "WORD": ("parse", "Broken payload from TwelveData for WORD"),
        "DATE": ("parse", "Broken payload from TwelveData for DATE"),
        "TEXT": ("parse", "Broken payload from ccxt for TEXT"),
    }
    bars = sorted((r.symbol, str(r.ts), r.close, r.volume, r.timeframe) for r in L.bars_of(out).collect())
    assert bars == [
        ("A", "2024-01-01 00:00:00", 1.0, 1.0, "1d"),
        ("CASE", "1970-01-01 00:00:01", 1.5, 10.0, "1d"),
        ("FX", "2024-01-02 00:00:00", 1.75, 0.0, "1d"),
        ("GOOD", "1970-01-01 00:00:01", 1.5, 10.0, "1d"),
        ("ROWS", "1970-01-01 00:00:01", 1.5, 10.0, "1d"),
        ("ROWS", "1970-01-01 00:00:02", 1.5, 0.0, "1d"),
    ]


def test_repeated_payloads_and_an_empty_table(spark):
    out = found(spark, ("polygon", "A", "1d", GOOD), ("polygon", "A", "1d", GOOD), ("polygon", "B", "1d", "{"), ("polygon", "B", "1d", "{"))
    assert L.bars_of(out).count() == 2 and L.failures_of(out).count() == 2
    assert found(spark, ("polygon", "A", "1d", GOOD)).limit(0).count() == 0


def test_ten_sources_are_one_scan(spark, tmp_path):
    path = f"file://{tmp_path}/payloads"
    spark.createDataFrame([(s, "A", "1d", "{}") for s in L.PARSERS], SCHEMA).write.parquet(path)
    out = L.route_source(spark.read.parquet(path), list(L.PARSERS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan and "Exchange" not in plan


def test_both_outputs_go_to_storage_in_one_write(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    out = found(spark, ("polygon", "A", "1d", GOOD), ("polygon", "B", "1d", "{"))
    out.withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(path)
    back = spark.read.parquet(path)
    assert back.filter("failed = 'true'").count() == 1 and back.filter("failed = 'false'").count() == 1


def test_a_list_with_an_unknown_name_is_an_error(spark):
    with pytest.raises(ValueError, match="Unsupported source: x, y"):
        L.route_source(found(spark, ("x", "A", "1d", GOOD)), ["y", "x", "polygon"])

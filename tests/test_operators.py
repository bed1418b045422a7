import datetime
import os

import pytest
from pyspark.sql import functions as F

from sweepline.functions import scalars as S
from sweepline.functions import symbols as Y
from sweepline.operators import bars as B
from sweepline.operators import jobs as J
from sweepline.operators import ranking as R
from sweepline.operators import summary, sweeps
from sweepline.operators import universe as V
from sweepline.sources import payloads as L
from sweepline.sources import storage


def column(spark, values, expression, kind="string"):
    return [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(expression(F.col("x")).alias("v")).collect()]


def test_yahoo_symbols(spark):
    given = ["BRK.B", "SPX", "EURUSD", "EUR/USD", "BTCUSD", "btcusd", "BTC/USDT", "BTCUSDT", "GC", "ZW=F", "^GSPC", "BRK-B", "AAPL", " msft "]
    want = ["BRK-B", "^GSPC", "EURUSD=X", "EURUSD=X", "BTCUSD=X", "BTC-USD", "BTC-USD", "BTC-USD", "GC=F", "ZW=F", "^GSPC", "BRK-B", "AAPL", "msft"]
    assert column(spark, given, Y.yahoo) == want


def test_other_symbols(spark):
    assert column(spark, ["EURUSD", "eur/usd", "AAPL"], Y.finnhub) == ["OANDA:EUR_USD", "OANDA:EUR_USD", "AAPL"]
    assert column(spark, ["EURUSD", "AAPL"], Y.twelvedata) == ["EUR/USD", "AAPL"]
    assert column(spark, ["^GSPC", "GC=F", "BRK-B", "BRK.B"], Y.undecorated) == ["GSPC", "GC", "BRK.B", "BRK.B"]


def test_bars_per_year(spark):
    given = ["1d", "2w", "4h", "15m", "10s", "24d", "1wk", "1mo", "1M", "", None]
    assert column(spark, given, S.bars_per_year)[:10] == [252, 26, 2190, 35040, 3153600, 10, 252, 252, 525600, 252]


def test_positive_and_finite(spark):
    values = [1.0, 0.0, -1.0, float("nan"), float("inf"), None]
    assert column(spark, values, S.is_positive, "double") == [True, False, False, False, True, False]
    assert column(spark, values, S.finite, "double") == [1.0, 0.0, -1.0, None, None, None]
    assert column(spark, values, S.format_6f, "double") == ["1.000000", "0.000000", "-1.000000", "nan", "inf", "nan"]


def test_grid_order_and_empty_grid(spark):
    grid = spark.createDataFrame([("s", {"b": ["1", "2"], "a": ["x", "y"]}), ("none", {}), ("gap", {"a": []})], "strategy string, grid map<string,array<string>>")
    rows = J.grid_cross(grid).orderBy("strategy", "grid_ordinal").collect()
    assert [dict(r.params) for r in rows if r.strategy == "s"] == [{"a": a, "b": b} for a in "xy" for b in "12"]
    assert [dict(r.params) for r in rows if r.strategy == "none"] == [{}]
    assert not [r for r in rows if r.strategy == "gap"]


@pytest.mark.parametrize(("dof", "least", "bars", "skipped"), [(100, 2000, 50, True), (60, 1, 50, True), (1, 1, 50, False), (50, 1, 50, False)])
def test_min_bars_guard(spark, dof, least, bars, skipped):
    row = J.min_bars_guard(spark.createDataFrame([(bars, 1)], "bars long, n_params int"), least, dof).first()
    assert row.skipped == skipped and (row.reason is not None) == skipped


def test_overrides(spark):
    own = spark.createDataFrame([("s", {"window": ["1", "2"]}), ("t", {"window": ["1"]})], "strategy string, grid map<string,array<string>>")
    over = spark.createDataFrame([("s", {"window": ["3", "4"]}, {"bias": [".1"]})], "strategy string, override_grid map<string,array<string>>, params map<string,array<string>>")
    rows = {r.strategy: r for r in J.strategy_overrides(own, over).collect()}
    assert rows["s"].grid == {"window": ["3", "4"]} and rows["s"].static_params == {"bias": [".1"]}
    assert rows["t"].grid == {"window": ["1"]}


def test_normalize_reports_missing(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "Open double, Low double")
    with pytest.raises(ValueError, match="close, high"):
        B.normalize_bars(rows, "s", "Open")


def test_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 1), ("a", float("nan"), 0), ("b", None, 3)], "k string, metric_value double, ordinal int")
    got = {r.k: r.ordinal for r in R.top_by(rows, ["k"]).collect()}
    assert got == {"a": 1, "b": 3}
    assert [r.ordinal for r in R.best_per_job(rows, ["k"], ordinal="ordinal").collect()] == [1]


def test_alert_reasons(spark):
    schema = "collection string, symbol string, strategy string, timeframe string, metric string, metric_value double, ordinal int"
    rows = spark.createDataFrame([("c", "s", "x", "1d", "sharpe", 1.5, 0), ("c", "s", "y", "1d", "profit", 9.0, 1)], schema)
    assert R.threshold_alert(rows, "Sharpe", 1.0).first().reason is None
    assert R.threshold_alert(rows, "Sharpe", 2.0).first().reason == "below_threshold"
    assert R.threshold_alert(rows, "other", 2.0).first().value == 9.0
    assert R.threshold_alert(rows.filter("false"), "Sharpe", 2.0).first().reason == "no_results"


def test_universe(spark):
    rows = spark.createDataFrame([("binance", "ETH/USDT", 900.0), ("binance", "BTC/USDT", 800.0), ("bybit", "ETH/USDT", 1200.0), ("bybit", "XRP/USDT", 500.0)], "exchange string, symbol string, volume double")
    top = V.universe_top_n(V.universe_merge(rows, ["binance", "bybit"]), 2)
    assert [(r.symbol, r.exchange) for r in top.collect()] == [("ETH/USDT", "bybit"), ("BTC/USDT", "binance")]
    kept = V.exclude_symbols(rows, ["ETH/USDT"], ["XR[!A]/*"])
    assert {r.symbol for r in kept.collect()} == {"BTC/USDT"}
    assert V.add_extras(top, ["ETH/USDT", "M/USDT"]).filter("exchange = 'manual'").first().symbol == "M/USDT"


def test_discovery_falls_back_to_markets(spark):
    tickers = spark.createDataFrame([("a", "AAA/USDT", 200.0), ("a", "CCC/USD", 999.0), ("a", "nopair", 5.0)], "exchange string, symbol string, volume double")
    markets = spark.createDataFrame([("b", "X/USDT", None, True, "usdt"), ("b", "Y/USDT", False, True, "USDT"), ("b", "Z/USDT", True, False, "USDT"), ("a", "Q/USDT", True, True, "USDT")], "exchange string, symbol string, active boolean, spot boolean, quote string")
    assert {(r.exchange, r.symbol) for r in V.discover_top_volume(tickers, markets).collect()} == {("a", "AAA/USDT"), ("b", "X/USDT")}


def test_strategy_errors_are_rows(spark):
    start = datetime.datetime(2024, 1, 1)
    bars = spark.createDataFrame([("s", start + datetime.timedelta(days=i), float(i)) for i in range(4)], "symbol string, ts timestamp_ntz, close double")
    grid = spark.createDataFrame([(0, {"n": "1"}), (1, {"n": "x"})], "grid_ordinal int, params map<string,string>")

    def rising(frame, params):
        moved = frame["close"].diff(int(params["n"]))
        return moved > 0, moved < 0

    rows = sweeps.pandas_strategy(bars, grid, ["symbol"], rising).collect()
    assert sum(r.entry for r in rows) == 3
    assert {r.grid_ordinal for r in rows if r.error} == {1}


def test_finnhub_is_cut_to_the_shortest(spark):
    payload = '{"s":"ok","t":[1,2,3],"o":[1,2],"h":[1,2],"l":[1,2],"c":[1,2],"v":[1,2]}'
    rows = spark.createDataFrame([("s", payload), ("bad", '{"s":"no_data"}')], "symbol string, payload string")
    assert L.norm_finnhub(rows).count() == 2


def test_yahoo_gaps(spark):
    payload = '{"chart":{"result":[{"timestamp":[1,2],"indicators":{"quote":[{"open":[1.0,2.0],"high":[1.0,2.0],"low":[1.0,2.0],"close":[null,2.0]}]}}]}}'
    got = L.norm_yahoo_chart(spark.createDataFrame([("s", payload)], "symbol string, payload string")).collect()
    assert [(r.close, r.volume) for r in got] == [(2.0, None)]


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        L.route_source(spark.createDataFrame([("s", "{}", "x")], "symbol string, payload string, source string"), ["x"])


def test_alphavantage_fx_has_no_volume(spark):
    day = '{"2024-01-02":{"1. open":"1","2. high":"2","3. low":"0.5","4. close":"1.5","6. volume":"9"}}'
    rows = spark.createDataFrame([("fx", f'{{"Time Series FX (Daily)":{day}}}'), ("eq", f'{{"Time Series (Daily)":{day}}}')], "symbol string, payload string")
    assert {r.symbol: r.volume for r in L.norm_alphavantage(rows).collect()} == {"fx": 0.0, "eq": 9.0}


def test_summary_skips_missing_metrics(spark):
    rows = spark.createDataFrame([("c", "", "1d", "s", 1, float("nan"), 2.0)], "collection string, symbol string, timeframe string, strategy string, ordinal int, sharpe double, pain_index double")
    assert [r.metric for r in summary.summary_metrics(rows, [], ["sharpe", "pain_index"]).collect()] == ["pain_index"]
    assert summary.summary_counts(rows, []).first().symbols == 0


def test_retention(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.bin").write_bytes(b"12345")
    now = datetime.datetime.now(datetime.UTC) + datetime.timedelta(days=10)
    assert storage.retention_totals(storage.retention_scan(spark, str(tmp_path), 5, now)).first().bytes == 5
    assert storage.retention_totals(storage.retention_scan(spark, str(tmp_path), 50, now)).first().files == 0


def test_entry_runs_without_optional_parts():
    import __spark_entry__ as entry

    assert "best_per_job" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_fingerprint_keeps_all_digits(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a", day, 1.234e-7), ("b", day, 4.9e-7), ("c", day, 100.1)]
    got = {r.symbol: r.fingerprint for r in B.data_fingerprint(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double"), "symbol").collect()}
    assert got["a"] != got["b"] and float(got["a"].rsplit(":", 1)[1]) == 1.234e-7
    assert got["c"] == "1:2024-01-01T00:00:00:100.1"


def test_float_text(spark):
    given = [1.0, 100.1, 10190703.97, 1e7, 0.000123, -0.5, 1.234e-7, 1e16, 1.5e300, -2.5e-10, 0.0, float("nan"), float("inf"), float("-inf"), 123456789012345.6, None]
    assert column(spark, given, S.float_text, "double") == [None if v is None else repr(v) for v in given]


def test_health_failures_counts_all(spark):
    rows = spark.createDataFrame([("a|b",), (None,), ("x",)], "error string").repartition(3)
    got = summary.health_failures(rows)
    assert sorted((r.error, r.failures) for r in got.collect()) == [("", 3), ("a b", 3), ("x", 3)]
    assert summary.health_failures(rows.filter("error = 'none'")).count() == 0


def test_alert_rounds_numbers(spark):
    row = spark.createDataFrame([("S", "st", "1d", 1.2346, -0.0004, None)], "symbol string, strategy string, timeframe string, sharpe double, sortino double, calmar double")
    text = row.select(R.alert_message().alias("m")).first().m
    assert "Sharpe: 1.235" in text and "Sortino: -0.000" in text and "Calmar: N/A" in text


def test_entry_raises_if_a_dependency_is_missing():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__"
    from_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isfile(os.path.join(from_root, "sweepline", "llm", "queries.py")):
        pytest.skip("the corpus subpackage is optional")
    ran = subprocess.run([sys.executable, "-c", code], cwd=from_root, capture_output=True, text=True, timeout=120)
    assert ran.returncode and "corpus_pipeline" in ran.stderr


def test_json_of_values_at_any_depth(spark):
    nan, inf = "double('NaN')", "double('Infinity')"
    rows = spark.sql(f"select named_struct('a', {nan}, 'b', array(1.5D, {inf})) s, map('k', {nan}, 'm', 2D) m, array(named_struct('x', -{inf})) n, cast(null as struct<a:double>) z, 'NaN' t")
    assert S.with_json(rows, rows.columns, "json").first().json == '{"s":{"a":null,"b":[1.5,null]},"m":{"k":null,"m":2.0},"n":[{"x":null}],"z":null,"t":"NaN"}'


def test_scalars_in_a_grid(spark):
    texts = ['{"a":[5,10],"b":3,"c":"x","d":[],"e":[7],"f":null}', "{}", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(J.grid_of_json(F.col("t")).alias("g"))
    search, fixed = J.search_space(F.col("g"))
    got = rows.select(search.alias("search"), fixed.alias("fixed")).collect()
    assert (got[0].search, got[0].fixed) == ({"a": ["5", "10"]}, {"b": ["3"], "c": ["x"], "e": ["7"], "f": [None]})
    assert (got[1].search, got[1].fixed) == ({}, {}) and got[2].search is None


def test_corporate_events_fall_back_to_actions(spark):
    rows = [("OWN", {"2024-01-02T00:00:00-05:00": 2.0}, {"Stock Splits": {"2020-01-01": 9.0}}), ("ACT", {}, {"Stock Splits": {"2024-03-04": 3.0}}), ("DIV", None, {"Dividends": {"2024-03-04": 3.0}}), ("NONE", None, None)]
    frame = spark.createDataFrame(rows, "symbol string, splits map<string,double>, actions map<string,map<string,double>>")
    got = L.norm_events(frame, "splits", "Stock Splits", "ratio")
    assert {(r.symbol, r.ts, r.ratio) for r in got.collect()} == {("OWN", datetime.datetime(2024, 1, 2, 5), 2.0), ("ACT", datetime.datetime(2024, 3, 4), 3.0)}
    empty = L.norm_events(frame.filter("false"), "splits", "Stock Splits", "ratio")
    assert empty.count() == 0 and empty.dtypes == [("symbol", "string"), ("ts", "timestamp_ntz"), ("ratio", "double")]


def test_bars_in_order_and_not_empty(spark):
    frame = spark.createDataFrame([(d, 1.0, 2.0, 0.5, 1.5) for d in (3, 1, 2)], "d int, Open double, High double, Low double, Close double")
    assert [r.date for r in B.normalize_bars(frame, "s", "d").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="No bars"):
        B.normalize_bars(frame.filter("false"), "s", "d").collect()


def test_compared_and_latest_runs(spark):
    rows = spark.createDataFrame([("r1", "c", "s", "d", "x", i) for i in range(3)] + [("r2", "c", "s", "d", "x", 9)], "run_id string, collection string, symbol string, timeframe string, strategy string, ordinal int")
    assert [(r.run_id, r.ordinal, r.results) for r in summary.compare_runs(rows, " r1 ,,r9", 2).orderBy("ordinal").collect()] == [("r1", 0, 3), ("r1", 1, 3)]
    with pytest.raises(ValueError):
        summary.compare_runs(rows, " , ")
    with pytest.raises(LookupError):
        summary.compare_runs(rows, "r9")
    statuses = rows.select(F.col("run_id").alias("recorded_in"), "ordinal")
    assert [r.ordinal for r in summary.latest_run_status(statuses).collect()] == [9]
    assert summary.latest_run_status(statuses, "r1").count() == 3
    with pytest.raises(LookupError):
        summary.latest_run_status(statuses, "r9")
    assert summary.latest_run_status(statuses.filter("false")).count() == 0

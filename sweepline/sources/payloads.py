"""Vendor payloads (JSON text landed in storage) to bars: ts without zone in UTC, five doubles, missing fields 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")
#: What a payload's parser gives for each bar; ``named`` is a symbol that the payload itself names.
BAR = "struct<named:string,ts:timestamp_ntz,open:double,high:double,low:double,close:double,volume:double>"
_CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _json(payload: Column, fields: str) -> Column:
    """One parse; ``_corrupt`` is set where the text isn't JSON or a field isn't of its type."""
    return F.from_json(payload, f"{fields}, _corrupt string", _CORRUPT)


def _rows(payload: Column, element: str) -> Column:
    """A payload that is an array, as field ``a``."""
    return _json(F.concat(F.lit('{"a":'), payload, F.lit("}")), f"a array<{element}>")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _bar(ts: Column, *values: Column, named: Column | None = None) -> Column:
    named = F.lit(None).cast("string") if named is None else named
    return F.struct(named.alias("named"), ts.cast("timestamp_ntz").alias("ts"), *(v.cast("double").alias(n) for n, v in zip(FIELDS, values, strict=True)))


def _struct(bars: Column, bad: Column) -> Column:
    return F.struct(bars.cast(f"array<{BAR}>").alias("bars"), F.coalesce(bad, F.lit(False)).alias("bad"))


def _texts_bad(values: Column) -> Column:
    """Whether a text that should be a number isn't one."""
    return F.exists(values, lambda v: v.isNotNull() & v.try_cast("double").isNull())


def parse_yahoo_chart(payload: Column) -> Column:
    """Parallel arrays; rows without a close go, other gaps stay null."""
    quote = "struct<" + ",".join(f"{f}:array<double>" for f in FIELDS) + ">"
    p = _json(payload, f"chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<{quote}>>>>>")
    result = F.get(p["chart"]["result"], F.lit(0))
    q = F.get(result["indicators"]["quote"], F.lit(0))
    zipped = F.arrays_zip(result["timestamp"].alias("t"), *(F.coalesce(q[f], F.array().cast("array<double>")).alias(f) for f in FIELDS))
    kept = F.filter(zipped, lambda x: x["close"].isNotNull())
    return _struct(F.transform(kept, lambda x: _bar(F.timestamp_seconds(x["t"]), *(x[f] for f in FIELDS))), p["_corrupt"].isNotNull())


def parse_alpaca(payload: Column) -> Column:
    """Bars by symbol: the payload names its symbols."""
    p = _json(payload, "bars map<string,array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>>")
    of = lambda e: F.transform(e["value"], lambda x: _bar(F.try_to_timestamp(x["t"]), *(_zero(x[c]) for c in "ohlcv"), named=e["key"]))
    return _struct(F.flatten(F.transform(F.map_entries(p["bars"]), of)), p["_corrupt"].isNotNull())


def parse_ccxt(payload: Column) -> Column:
    p = _rows(payload, "array<double>")
    bars = F.transform(p["a"], lambda x: _bar(F.timestamp_millis(x[0].cast("bigint")), *(_zero(F.get(x, F.lit(i))) for i in range(1, 6))))
    return _struct(bars, p["_corrupt"].isNotNull())


def parse_tiingo(payload: Column) -> Column:
    p = _rows(payload, "struct<date:string," + ",".join(f"{f}:double" for f in FIELDS) + ">")
    return _struct(F.transform(p["a"], lambda x: _bar(F.try_to_timestamp(x["date"]), *(_zero(x[f]) for f in FIELDS))), p["_corrupt"].isNotNull())


def parse_polygon(payload: Column) -> Column:
    p = _json(payload, "results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>")
    return _struct(F.transform(p["results"], lambda x: _bar(F.timestamp_millis(x["t"]), *(_zero(x[c]) for c in "ohlcv"))), p["_corrupt"].isNotNull())


def parse_finnhub(payload: Column) -> Column:
    """Parallel arrays, cut to the shortest; a status other than ``ok`` gives no bars."""
    p = _json(payload, "s string, t array<bigint>, " + ", ".join(f"{c} array<double>" for c in "ohlcv"))
    shortest = F.least(*(F.size(p[c]) for c in "tohlcv"))
    zipped = F.slice(F.arrays_zip(*(p[c].alias(c) for c in "tohlcv")), F.lit(1), F.greatest(shortest, F.lit(0)))
    bars = F.transform(zipped, lambda x: _bar(F.timestamp_seconds(x["t"]), *(_zero(x[c]) for c in "ohlcv")))
    return _struct(F.when(p["s"] == "ok", bars), p["_corrupt"].isNotNull())


def parse_twelvedata(payload: Column) -> Column:
    p = _json(payload, "values array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>")
    bars = F.transform(p["values"], lambda x: _bar(F.try_to_timestamp(x["datetime"]), *(_zero(x[f].try_cast("double")) for f in FIELDS)))
    texts = F.flatten(F.transform(p["values"], lambda x: F.array(*(x[f] for f in FIELDS))))
    return _struct(bars, p["_corrupt"].isNotNull() | F.coalesce(_texts_bad(texts), F.lit(False)))


def parse_alphavantage(payload: Column) -> Column:
    """FX pairs have no volume; shares take the unadjusted close and the sixth field as volume."""
    day = "map<string,map<string,string>>"
    p = _json(payload, f"`Time Series FX (Daily)` {day}, `Time Series (Daily)` {day}")
    fx = p["Time Series FX (Daily)"]
    series = F.map_entries(F.coalesce(fx, p["Time Series (Daily)"]))
    keys = ("1. open", "2. high", "3. low", "4. close", "6. volume")
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    number = lambda m, k: _zero(of(m, k).try_cast("double"))
    bars = F.transform(series, lambda e: _bar(F.try_to_timestamp(e["key"]), *(number(e["value"], k) for k in keys[:4]), F.when(fx.isNotNull(), 0.0).otherwise(number(e["value"], keys[4]))))
    texts = F.flatten(F.transform(series, lambda e: F.array(*(of(e["value"], k) for k in keys))))
    return _struct(bars, p["_corrupt"].isNotNull() | F.coalesce(_texts_bad(texts), F.lit(False)))


#: source -> (parser, name in messages).
PARSERS = {
    "yfinance": (parse_yahoo_chart, "Yahoo"),
    "alpaca": (parse_alpaca, "Alpaca"),
    "ccxt": (parse_ccxt, "ccxt"),
    "binance": (parse_ccxt, "binance"),
    "bybit": (parse_ccxt, "bybit"),
    "tiingo": (parse_tiingo, "Tiingo"),
    "polygon": (parse_polygon, "Polygon"),
    "finnhub": (parse_finnhub, "Finnhub"),
    "twelvedata": (parse_twelvedata, "TwelveData"),
    "alphavantage": (parse_alphavantage, "AlphaVantage"),
}
STAGES = {"empty": "fetch", "source": "route", "parse": "parse", "none": "normalize"}


def outcomes(payloads: DataFrame) -> DataFrame:
    """(source, symbol, payload, any others) -> bars and failures in one table, from one scan and one parse of each payload.

    A good payload gives its bars (``stage`` and ``error`` null). A null or empty text, an unknown source, text that isn't JSON
    or has a field of a wrong type, and a payload without bars give one row each, with ``stage``, ``error`` and no bar; no bar of such a
    payload is given, as it can't be told which are right. Source names go by their lower-case form. ``bars_of`` and ``failures_of`` part the table.
    """
    kept = [c for c in payloads.columns if c != "payload"]
    source, text = F.lower("source"), F.trim("payload")
    parsed, label = F.lit(None).cast(f"struct<bars:array<{BAR}>,bad:boolean>"), F.col("source")
    for name, (parse, title) in PARSERS.items():  # CASE: each row is parsed by its own source's parser alone
        parsed = F.when(source == name, parse(text)).otherwise(parsed)
        label = F.when(source == name, F.lit(title)).otherwise(label)
    rows = payloads.withColumn("_p", F.when(F.length(text) > 0, parsed)).withColumn("_label", label)
    blank = F.coalesce(F.length(text), F.lit(0)) == 0
    known = F.coalesce(source.isin(*PARSERS), F.lit(False))
    bars = F.col("_p.bars")
    whole = F.coalesce(F.size(bars), F.lit(0))
    undated = F.coalesce(F.exists(bars, lambda b: b["ts"].isNull()), F.lit(False))
    said = lambda kind, *words: F.struct(F.lit(STAGES[kind]).alias("stage"), F.concat(*words).alias("error"))
    symbol = F.coalesce("symbol", F.lit("?"))
    fault = (
        F.when(~known, said("source", F.lit("Unsupported source: "), F.coalesce("source", F.lit("?"))))
        .when(blank, said("empty", F.lit("Empty payload from "), F.col("_label"), F.lit(" for "), symbol))
        .when(F.col("_p.bad") | undated, said("parse", F.lit("Broken payload from "), F.col("_label"), F.lit(" for "), symbol))
        .when(whole <= 0, said("none", F.lit("No data from "), F.col("_label"), F.lit(" for "), symbol))
    )
    rows = rows.withColumn("_fault", fault)
    rows = rows.select(*kept, "_fault", F.explode_outer(F.when(F.col("_fault").isNull(), bars)).alias("_bar"))
    given = [F.coalesce("_bar.named", "symbol").alias("symbol") if c == "symbol" else F.col(c) for c in kept]
    return rows.select(*given, *(f"_bar.{c}" for c in ("ts", *FIELDS)), F.col("_fault.stage").alias("stage"), F.col("_fault.error").alias("error"))


def bars_of(found: DataFrame) -> DataFrame:
    return found.filter("error is null").drop("stage", "error")


def failures_of(found: DataFrame) -> DataFrame:
    return found.filter("error is not null").drop("ts", *FIELDS)


def _normalized(payloads: DataFrame, source: str) -> DataFrame:
    return bars_of(outcomes(payloads.withColumn("source", F.lit(source)))).select("symbol", "ts", *FIELDS)


def norm_yahoo_chart(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "yfinance")


def norm_alpaca(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "alpaca")


def norm_ccxt(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "ccxt")


def norm_tiingo(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "tiingo")


def norm_polygon(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "polygon")


def norm_finnhub(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "finnhub")


def norm_twelvedata(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "twelvedata")


def norm_alphavantage(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, "alphavantage")


def norm_yahoo_history(frame: DataFrame, ts: str) -> DataFrame:
    """Flattened library columns: the first word of each name, zone dropped by wall clock."""
    names = [c.split()[0].lower() if c != ts else "ts" for c in frame.columns]
    return frame.toDF(*names).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def route_source(payloads: DataFrame, sources: list[str]) -> DataFrame:
    """Bars of the payloads of ``sources`` (column ``source``), each parsed by its own normaliser in one scan; unknown names are an error."""
    unknown = sorted(set(sources) - set(PARSERS))
    if unknown:
        raise ValueError(f"Unsupported source: {', '.join(unknown)}")
    found = bars_of(outcomes(payloads.filter(F.col("source").isin(*sources))))
    return found.select("symbol", "ts", *FIELDS, "source")


def norm_events(payloads: DataFrame, own: str, action: str, value: str) -> DataFrame:
    """(symbol, <own> map<stamp, double>, actions map<name, map<stamp, double>>) -> (symbol, ts, <value>).

    A symbol's own series counts, or where it is null or empty its ``action``. Stamps become UTC (those without an
    offset are UTC). A symbol with neither gives no rows; the columns keep their types on an empty result.
    """
    series = F.when(F.size(own) > 0, F.col(own)).otherwise(F.try_element_at("actions", F.lit(action)))
    rows = payloads.select("symbol", F.explode(series).alias("at", value))
    full = F.when(F.length("at") == 10, F.concat("at", F.lit("T00:00:00"))).otherwise(F.col("at"))
    zoned = F.when(full.rlike(r"([zZ]|[+-]\d\d:?\d\d)$"), full).otherwise(F.concat(full, F.lit("Z")))
    ts = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz"))
    return rows.select("symbol", ts.alias("ts"), F.col(value).cast("double").alias(value))


# Keys of a fundamentals snapshot that are kept.
INFO_KEYS = ["longName", "exchange", "quoteType", "currency", "sector", "industry", "marketCap", "trailingPE", "forwardPE", "beta", "trailingEps", "dividendYield", "returnOnEquity"]


def norm_info(snapshots: DataFrame) -> DataFrame:
    """(symbol, info map) -> (symbol, key, value) of kept keys."""
    kept = F.map_filter("info", lambda k, _: k.isin(*INFO_KEYS))
    return snapshots.select("symbol", F.explode(kept).alias("key", "value"))


def norm_fundamentals(statements: DataFrame) -> DataFrame:
    """(symbol, statement, items map<item, map<period, double>>) -> long rows; null values are 0."""
    items = statements.select("symbol", "statement", F.explode("items").alias("item", "periods"))
    return items.select("symbol", "statement", "item", F.explode("periods").alias("period", "value")).withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))

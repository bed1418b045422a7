"""Column functions: parsing, rounding, annualisation, fees, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITIES = (float("inf"), float("-inf"))
#: What counts as zero.
ZERO = 1e-8


def lenient_double(c: Column | str) -> Column:
    """Text or number as double; null where it isn't one."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def not_nan(c: Column | str) -> Column:
    """Null in place of NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """Null in place of NaN and the infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & ~c.isin(*INFINITIES), c)


def is_positive(c: Column | str) -> Column:
    """Whether a value parses and is over 0; NaN, which Spark sorts above all numbers, is not."""
    value = not_nan(lenient_double(c))
    return F.coalesce(value > 0, F.lit(False))


def close_to_zero(c: Column) -> Column:
    return F.abs(c) <= ZERO


def format_6f(c: Column | str) -> Column:
    """Six decimals; ``nan`` for null and NaN, ``inf`` for infinities."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.format_string("%.6f", c)
    return F.when(c.isNull() | F.isnan(c), "nan").when(c == INFINITIES[0], "inf").when(c == INFINITIES[1], "-inf").otherwise(text)


def float_text(c: Column | str) -> Column:
    """A double with all its digits: plain from 1e-4 up to 1e16, else ``d.ddde-XX``; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    text, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    scientific = F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(power)))
    other = F.when(F.isnan(c), "nan").when(c == INFINITIES[0], "inf").when(c == INFINITIES[1], "-inf").when(c == 0, text)
    return F.coalesce(other, F.when((size >= 1e-4) & (size < 1e16), plain).when(c.isNotNull(), scientific))


def bars_per_year(timeframe: Column | str) -> Column:
    """Bars in a year of a timeframe such as ``4h``; unknown units count as 252 days."""
    text = F.lower(F.trim(timeframe))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    unit = F.trim(F.substring(text, F.length(digits) + 1, F.length(text)))
    unit = F.when(unit == "", "d").otherwise(unit)
    value = F.greatest(F.lit(1), F.coalesce(digits.try_cast("int"), F.lit(1)))
    per = lambda n: F.greatest(F.lit(1), F.bround(F.lit(float(n)) / value).cast("int"))
    known = F.when(unit.isin("d", "day", "days"), per(252))
    known = known.when(unit.isin("w", "week", "weeks"), per(52))
    known = known.when(unit.isin("h", "hour", "hours"), per(24 * 365))
    known = known.when(unit.isin("m", "min", "minute", "minutes"), per(60 * 24 * 365))
    known = known.when(unit.isin("s", "sec", "second", "seconds"), per(60 * 60 * 24 * 365))
    return F.when(text == "", 252).otherwise(known.otherwise(252))


CRYPTO_SOURCES = ("binance", "bybit", "ccxt")


def fees_slippage(source: Column, fees: Column, slippage: Column, global_fees: float, global_slippage: float) -> Column:
    """struct(fees, slippage): own values if either is set, each falling back to the global one; else by source."""
    own = fees.isNotNull() | slippage.isNotNull()
    by_source = F.when(F.lower(source).isin(*CRYPTO_SOURCES), F.lit(0.0006)).otherwise(F.lit(0.0005))
    return F.struct(
        F.when(own, F.coalesce(fees, F.lit(global_fees))).otherwise(by_source).alias("fees"),
        F.when(own, F.coalesce(slippage, F.lit(global_slippage))).otherwise(F.lit(0.0005)).alias("slippage"),
    )


def fractional(source: Column, symbol: Column) -> Column:
    return F.lower(source).isin(*CRYPTO_SOURCES) | symbol.contains("/") | symbol.endswith("USDT")


def params_json(params: Column) -> Column:
    """Map of text as JSON with sorted keys: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def json_number(c: Column | str) -> Column:
    """A double that JSON can carry."""
    return finite(c)


def json_safe(c: Column, kind: T.DataType) -> Column:
    """The value with null for every NaN and infinity in it, inside structs, arrays and map values too."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return finite(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: json_safe(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*(json_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields))
        return F.when(c.isNotNull(), inner)
    return c


def with_json(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds ``columns`` as the text of a JSON object that every parser takes; nulls are written."""
    safe = F.struct(*(json_safe(F.col(c), rows.schema[c].dataType).alias(c) for c in columns))
    return rows.withColumn(name, F.to_json(safe, {"ignoreNullFields": "false"}))


def search_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in columns)))


def run_id_of(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")

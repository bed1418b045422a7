"""Symbol and timeframe mapping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How one vendor spells share classes, indices and futures roots.
SHARE_CLASSES = {
    "BRK.B": "BRK-B",
    "BRK.A": "BRK-A",
    "BF.B": "BF-B",
    "BF.A": "BF-A",
    "HEI.A": "HEI-A",
    "HEI.B": "HEI-B",
    "LEN.B": "LEN-B",
}
INDICES = {
    "SPX": "^GSPC",
    "SP500": "^GSPC",
    "GSPC": "^GSPC",
    "NDX": "^NDX",
    "DJI": "^DJI",
    "RUT": "^RUT",
    "VIX": "^VIX",
    "DAX": "^GDAXI",
    "CAC": "^FCHI",
    "FTSE": "^FTSE",
    "NIKKEI": "^N225",
    "N225": "^N225",
    "HSI": "^HSI",
    "EUROSTOXX50": "^STOXX50E",
    "SX5E": "^STOXX50E",
}
FUTURES = ["GC", "SI", "HG", "PL", "PA", "CL", "NG", "HO", "RB", "BZ", "ZC", "ZS", "ZM", "ZL", "ZW", "ZO", "KC", "SB", "CC", "CT", "OJ", "LE", "HE", "GF", "ZB", "ZN", "ZF", "ZT"]

# Timeframes each vendor knows.
TIMEFRAMES = {
    "finnhub": {"1m": "1", "5m": "5", "15m": "15", "30m": "30", "1h": "60", "4h": "240", "1d": "D"},
    "twelvedata": {"1m": "1min", "5m": "5min", "15m": "15min", "30m": "30min", "1h": "1h", "2h": "2h", "4h": "4h", "1d": "1day"},
    "yahoo": {"1m": "1m", "2m": "2m", "5m": "5m", "15m": "15m", "30m": "30m", "60m": "60m", "90m": "90m", "1h": "60m", "1d": "1d", "1w": "1wk", "1wk": "1wk", "1mo": "1mo"},
    "ccxt": {"1m": "1m", "3m": "3m", "5m": "5m", "15m": "15m", "30m": "30m", "1h": "1h", "2h": "2h", "4h": "4h", "6h": "6h", "12h": "12h", "1d": "1d", "1w": "1w", "1M": "1M"},
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def yahoo(symbol: Column) -> Column:
    """Rules in order: share class, index, FX pair, futures root, crypto pair; else as it is.

    Six capital letters count as FX before crypto is tried, so BTCUSD becomes BTCUSD=X.
    """
    s = F.trim(symbol)
    up = F.upper(s)
    out = F.when(_lookup(SHARE_CLASSES, up).isNotNull(), _lookup(SHARE_CLASSES, up))
    out = out.when(_lookup(INDICES, up).isNotNull(), _lookup(INDICES, up))
    out = out.when(s.rlike(r"^[A-Z]{6}$"), F.concat(s, F.lit("=X")))
    out = out.when(s.rlike(r"^[A-Z]{3}/[A-Z]{3}$"), F.concat(F.replace(s, F.lit("/"), F.lit("")), F.lit("=X")))
    out = out.when(up.isin(*FUTURES), F.concat(s, F.lit("=F")))
    out = out.when(up.rlike(r"^[A-Z]{2,6}USDT?$"), F.concat(F.regexp_replace(up, r"USDT?$", ""), F.lit("-USD")))
    out = out.when(up.rlike(r"/USDT?$"), F.concat(F.substring_index(up, "/", 1), F.lit("-USD")))
    return out.otherwise(s)


def finnhub(symbol: Column) -> Column:
    s = F.upper(F.trim(symbol))
    return F.regexp_replace(s, r"^([A-Z]{3})/?([A-Z]{3})$", "OANDA:$1_$2")


def twelvedata(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(symbol)), r"^([A-Z]{3})([A-Z]{3})$", "$1/$2")


def undecorated(symbol: Column) -> Column:
    """Without a leading caret and a trailing =F or =X; BRK-B becomes BRK.B."""
    s = F.regexp_replace(F.regexp_replace(F.trim(symbol), r"^\^", ""), r"(=F|=X)$", "")
    return F.regexp_replace(s, r"^([A-Z]{1,5})-([A-Z])$", "$1.$2")


def alphavantage(symbol: Column) -> Column:
    return F.trim(symbol)


def alpaca_is_crypto(symbol: Column) -> Column:
    s = F.upper(symbol)
    return s.contains("/") | s.endswith("USD") | s.endswith("USDT")


def alpaca_crypto(symbol: Column) -> Column:
    s = F.replace(F.upper(symbol), F.lit("USDT"), F.lit("USD"))
    return F.when(s.contains("/"), s).otherwise(F.regexp_replace(s, r"USD$", "/USD"))


def is_fx(symbol: Column) -> Column:
    return F.upper(F.replace(symbol, F.lit("/"), F.lit(""))).rlike(r"^\p{L}{6}$")


def map_symbol(provider: str, symbol: Column) -> Column:
    rules = {"yfinance": yahoo, "finnhub": finnhub, "twelvedata": twelvedata, "alphavantage": alphavantage}
    rules |= dict.fromkeys(("polygon", "tiingo", "alpaca"), undecorated)
    return rules.get(provider.lower(), lambda s: s)(symbol)


def vendor_timeframe(provider: str, timeframe: Column) -> Column:
    """The vendor's word for a timeframe; null where it has none."""
    tf = timeframe if provider == "ccxt" else F.lower(timeframe)
    if provider in TIMEFRAMES:
        return _lookup(TIMEFRAMES[provider], tf)
    n = F.regexp_extract(tf, r"^\s*(\d+)\s*[mhd]$", 1).try_cast("int")
    unit = F.substring(tf, -1, 1)
    text = n.cast("string")
    if provider == "alpaca":
        return F.when(unit == "d", "1Day").when(unit == "m", F.concat(text, F.lit("Min"))).when(unit == "h", F.concat(text, F.lit("Hour")))
    if provider == "polygon":
        span = F.when(unit == "m", "minute").when(unit == "h", "hour").when(unit == "d", "day")
        return F.when(span.isNotNull() & n.isNotNull(), F.concat(text, F.lit(" "), span))
    if provider == "tiingo":
        return F.when(unit == "d", "daily").when(unit == "m", F.concat(text, F.lit("min"))).when(unit == "h", F.concat((n * 60).cast("string"), F.lit("min")))
    raise ValueError(f"unknown provider: {provider}")

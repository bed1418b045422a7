"""Ticker universes: top volume per exchange, merge, exclusions, extras."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def volume_of(quote_volume: str, base_volume: str, has_quote: str) -> Column:
    """Quote volume if the ticker has that key (null counts 0), else base volume, else 0."""
    return F.when(F.col(has_quote), F.coalesce(quote_volume, F.lit(0.0))).otherwise(F.coalesce(base_volume, F.lit(0.0)))


def discover_top_volume(tickers: DataFrame, markets: DataFrame, quote: str = "USDT", top_n: int = 50, min_volume: float = 0.0) -> DataFrame:
    """(exchange, symbol, volume): pairs of a quote currency by volume; exchanges without tickers take active spot markets."""
    pair = F.split("symbol", "/")
    wanted = (F.size(pair) == 2) & (F.upper(F.get(pair, 1)) == quote.upper()) & (F.col("volume") >= min_volume)
    listed = tickers.select("exchange", "symbol", "volume", F.coalesce(wanted, F.lit(False)).alias("wanted"), F.lit(True).alias("listed"))
    spot = F.coalesce("active", F.lit(True)) & F.col("spot") & (F.upper(F.coalesce("quote", F.lit(""))) == quote.upper())
    fallback = markets.select("exchange", "symbol", F.lit(0.0).alias("volume"), F.coalesce(spot, F.lit(False)).alias("wanted"), F.lit(False).alias("listed"))
    # one row a pair, combined before the shuffle; then one window an exchange tells whether it has tickers and ranks its pairs
    kept = F.col("wanted")
    pairs = listed.unionByName(fallback).groupBy("exchange", "symbol").agg(
        F.max("listed").alias("any"), F.max(F.when(kept & F.col("listed"), F.col("volume"))).alias("ticker"), F.max(F.when(kept & ~F.col("listed"), F.lit(0.0))).alias("market")
    )
    w = Window.partitionBy("exchange")
    pairs = pairs.withColumn("volume", F.when(F.max("any").over(w), F.col("ticker")).otherwise(F.col("market")))
    ranked = pairs.withColumn("rank", F.row_number().over(w.orderBy(F.col("volume").desc_nulls_last(), "symbol")))
    return ranked.filter(F.col("volume").isNotNull() & (F.col("rank") <= top_n)).select("exchange", "symbol", "volume", "rank")


def universe_merge(entries: DataFrame, exchanges: list[str]) -> DataFrame:
    """The highest volume of each symbol and its exchange, the first exchange on ties."""
    order = F.array_position(F.array(*map(F.lit, exchanges)), F.col("exchange"))
    best = entries.groupBy("symbol").agg(F.max_by(F.struct("exchange", "volume"), F.struct("volume", -order)).alias("b"))
    return best.select("symbol", "b.exchange", "b.volume")


def glob_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = pattern[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def exclude_symbols(entries: DataFrame, names: list[str], patterns: list[str]) -> DataFrame:
    keep = ~F.col("symbol").isin(*names) if names else F.lit(True)
    for p in patterns:
        keep = keep & ~F.col("symbol").rlike(glob_regex(p))
    return entries.filter(keep)


def universe_top_n(merged: DataFrame, n: int) -> DataFrame:
    return merged.orderBy(F.col("volume").desc(), "symbol").limit(n)


def add_extras(top: DataFrame, extras: list[str]) -> DataFrame:
    manual = top.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(extras)], "symbol string")
    new = manual.join(top.select("symbol"), "symbol", "left_anti")
    return top.select("symbol", "exchange", "volume").unionByName(new.select("symbol", F.lit("manual").alias("exchange"), F.lit(0.0).alias("volume")))

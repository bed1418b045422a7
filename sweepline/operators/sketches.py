"""Quantiles by a sketch that merges exactly, and histograms whose edges come from the data.

A value falls into a bucket of the logarithm of its size: bucket i of a sign holds (g^(i-1), g^i] with g = (1 + e) / (1 - e). The
sketch is the buckets' counts, so sketches merge by adding counts, in any order, with the same result. A quantile is the bucket that holds
its rank, given as 2 g^i / (g + 1): within ``e`` of the exact order statistic, relative to its size. Values under ``TINY`` in size count as 0. The
number of buckets grows with the logarithm of the range: about 2,300 for each sign from 1e-10 to 1e10 at e = 0.01.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite

ERROR = 0.01
TINY = 1e-12


def _base(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """(sign, i): in order of the values if compared as (sign, sign * i)."""
    i = F.ceil(F.ln(F.abs(value)) / math.log(_base(error))).cast("long")
    sign = F.signum(value).cast("int")
    return F.when(F.abs(value) < TINY, F.struct(F.lit(0).alias("sign"), F.lit(0).cast("long").alias("at"))).otherwise(F.struct(sign.alias("sign"), (sign * i).alias("at")))


def bucket_value(sign: Column, at: Column, error: float = ERROR) -> Column:
    g = _base(error)
    return F.when(sign == 0, 0.0).otherwise(sign * 2 * F.power(F.lit(g), sign * at) / (g + 1))


def sketch(rows: DataFrame, by: list[str], value: str, error: float = ERROR) -> DataFrame:
    """(by, sign, at, n) of the finite values; combined before the shuffle."""
    x = finite(value)
    return rows.filter(x.isNotNull()).select(*by, bucket(F.col(value), error).alias("b")).groupBy(*by, F.col("b.sign").alias("sign"), F.col("b.at").alias("at")).agg(F.count("*").alias("n"))


def merged_sketch(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "sign", "at").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], shares: list[float], error: float = ERROR) -> DataFrame:
    """(by, share, value): the value of rank floor(share * (n - 1)), within ``error`` of its size. Windows run over buckets, not values."""
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy("sign", "at").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketches.withColumns({"_upto": upto, "_all": F.sum("n").over(w)})
    asked = F.explode(F.array(*map(F.lit, shares))).alias("share")
    rows = ranked.select(*by, asked, "sign", "at", "n", "_upto", "_all").withColumn("_rank", F.floor(F.col("share") * (F.col("_all") - 1)))
    held = rows.filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("n") <= F.col("_rank")))
    return held.select(*by, "share", bucket_value(F.col("sign"), F.col("at"), error).alias("value"))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int = 10, error: float = ERROR) -> DataFrame:
    """(by, bin, low, high, n) of at least one key: ``bins`` ranges between quantiles, from one pass over ``rows``: counts are those of the sketch's buckets.

    A bucket counts for the range that its value falls in, the last one closed on both sides; equal edges make empty ranges, which are left out.
    """
    found = sketch(rows, by, value, error)
    edges = quantiles(found, by, [i / bins for i in range(bins + 1)], error)
    edges = edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("share", "value"))).alias("e"))  # bins + 1 of them
    edges = edges.select(*by, F.transform("e", lambda x: x["value"]).alias("_edges"))
    placed = found.join(edges, by)
    mine = bucket_value(F.col("sign"), F.col("at"), error)
    # the last edge that isn't over the value, at most the one before the last
    at = F.least(F.size(F.filter("_edges", lambda e: e <= mine)), F.lit(bins))
    counted = placed.withColumn("bin", at).groupBy(*by, "bin", F.element_at("_edges", at).alias("low"), F.element_at("_edges", at + 1).alias("high")).agg(F.sum("n").alias("n"))
    return counted.select(*by, "bin", "low", "high", "n")

"""Jobs and parameter grids as small tables that are crossed with series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_cross(collections: DataFrame, timeframes: DataFrame, strategies: DataFrame) -> DataFrame:
    """(collection, symbols array) x timeframe x strategy: dimension tables of a configuration, not data."""
    symbols = collections.select("collection", F.explode("symbols").alias("symbol"))
    return symbols.crossJoin(timeframes).crossJoin(strategies)


def grid_cross(grid: DataFrame) -> DataFrame:
    """``grid`` (strategy, grid map<string,array<string>>) -> (strategy, grid_ordinal, params); the last key varies fastest.

    Keys go in sorted order; an empty grid gives one empty combination, a key without options none.
    """
    keys = F.array_sort(F.map_keys("grid"))
    total = F.aggregate(keys, F.lit(1), lambda n, k: n * F.size(F.col("grid")[k]))
    rows = grid.filter(total > 0).select("strategy", "grid", keys.alias("_keys"), F.explode(F.sequence(F.lit(0), total - 1)).alias("grid_ordinal"))
    after = lambda i: F.aggregate(F.slice("_keys", i + 2, F.size("_keys")), F.lit(1), lambda n, k: n * F.size(F.col("grid")[k]))
    chosen = F.transform("_keys", lambda k, i: F.struct(k, F.get(F.col("grid")[k], F.pmod(F.floor(F.col("grid_ordinal") / after(i)), F.size(F.col("grid")[k])).cast("int"))))
    return rows.select("strategy", F.col("grid_ordinal").cast("int"), F.map_from_entries(chosen).alias("params"))


def strategy_overrides(own: DataFrame, overrides: DataFrame) -> DataFrame:
    """An override's ``grid`` replaces a strategy's grid; else its ``params`` are merged in, the right one winning."""
    joined = own.join(overrides, "strategy", "left")
    kept = F.map_filter("grid", lambda k, v: F.coalesce(~F.map_contains_key("params", k), F.lit(True)))
    merged = F.when(F.col("override_grid").isNotNull(), F.col("override_grid")).otherwise(
        F.map_concat(kept, F.coalesce("params", F.create_map().cast("map<string,array<string>>")))
    )
    static = F.when(F.col("override_grid").isNotNull(), F.coalesce("params", F.create_map().cast("map<string,array<string>>"))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return joined.select("strategy", merged.alias("grid"), static.alias("static_params"))


def grid_of_json(text: Column) -> Column:
    """A JSON object of parameters as a map of options: a list gives its values, any other value is the one option."""
    values = F.from_json(text, "map<string,string>")
    listed = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>"))
    return F.transform_values(values, lambda _, v: F.coalesce(listed(v), F.array(v)))


def search_space(grid: Column) -> tuple[Column, Column]:
    """(search dimensions: lists of several options, fixed: lists of one); empty lists are dropped."""
    return F.map_filter(grid, lambda _, v: F.size(v) > 1), F.map_filter(grid, lambda _, v: F.size(v) == 1)


def min_bars_guard(series: DataFrame, min_bars: int = 2000, dof: int = 100) -> DataFrame:
    """(…, bars, n_params) -> adds skipped, reason, min_bars_required, bars_available: too few bars for a search."""
    needed = F.greatest(F.lit(min_bars), F.lit(dof) * F.col("n_params"))
    skipped = (F.col("n_params") > 0) & (F.col("bars") < needed)
    return series.select(
        "*",
        skipped.alias("skipped"),
        F.when(skipped, "insufficient_bars_for_optimization").alias("reason"),
        needed.cast("long").alias("min_bars_required"),
        F.col("bars").alias("bars_available"),
    )


def budgeted_search(grid: DataFrame, trials: int, seed: int = 0) -> DataFrame:
    """At most ``trials`` combinations of each strategy, in the order of the md5 of ``seed:strategy:ordinal``."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "strategy", "grid_ordinal"))
    w = Window.partitionBy("strategy").orderBy(key, "grid_ordinal")
    return grid.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= trials).drop("_n")

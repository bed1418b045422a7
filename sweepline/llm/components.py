"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_root
from .common import hot_join

#: Links from which on a node with many of them is joined apart, and links that a task works on.
SPLIT_LINKS, TASK_LINKS = 50_000, 100_000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step: neighbours are linked to the smallest node seen from ``a``. A hub's links stay spread over the tasks."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
    rows = both.filter("b > a") if large else both
    joined = hot_join(rows, low, "a", "degree", 2 * n) if n > SPLIT_LINKS else rows.join(low, "a")
    if large:
        out = joined.select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").unionByName(low.select("a", F.col("low").alias("b")))
    return out.distinct().coalesce(max(1, math.ceil(n / TASK_LINKS)))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of any sortable node type -> (node, root), root the smallest node reachable.

    Nodes without links don't appear. Self links and repeated or null links are ignored. Every round ends in a
    checkpoint; rounds grow with the logarithm of the longest chain. Reaching ``max_rounds`` raises.
    """
    shared_root(links.sparkSession)  # sets a checkpoint folder where none is set
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    n, before = edges.count(), None
    for _ in range(max_rounds):
        edges = _star(_star(edges, True, n), False, n).checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if before == state and state[0] == state[2]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = state, state[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

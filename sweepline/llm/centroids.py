"""Exact integer k-means with the dimensions dealt to shards.

The matrix is stored as cells: a row holds up to ``CHUNK_ROWS`` vectors of one chunk and ``width`` of their components (a
column block). A round has two shuffles:

1. Each cell gives its vectors' partial squared distances to its block's slice of the centroids; partial distances of a
   chunk are added up, first within a task, then by chunk, and the smallest sum (ties: smaller number) is the cluster.
2. Each cell joins its chunk's clusters and gives sums and counts of its own columns; they are added up by (block,
   cluster, place), so every shard makes its own slice of the next centroids and no task holds a whole one.

All numbers are integers, so results don't depend on how rows or blocks are dealt. A round's clusters and centroids are written
to the shared folder: lineage stays one round long. The slices of the centroids (k x dimensions numbers) and, while they
are small, the clusters are broadcast by Spark's own size check; beyond it, both are shuffled.

A vector takes part if it has exactly ``dims`` components, none null or non-finite. A null id takes part like any other and
stands last in the order of starts; repeated rows are vectors of their own (they give rows of their own), and starts with equal
ids go by their components. Integers beyond +-2^27 are held there, as squared distances must fit a long; a
sum of distances that doesn't fit is null. Fewer vectors than ``k`` give fewer centroids, an empty table an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, table

#: Vectors in a cell.
CHUNK_ROWS = 2048
#: Largest component, so that 64 squared differences fit a long.
MOST = 1 << 27


def integer_vectors(rows: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return rows.filter((F.size(x) == dims) & fine).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(vectors: DataFrame, width: int) -> DataFrame:
    """(chunk, block, ids, cells): ``ids`` only in block 0, ``cells`` little-endian 32-bit integers, row by row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, len(batch), CHUNK_ROWS):
                some = batch.slice(start, CHUNK_ROWS)
                whole = matrix(some.column("v"))
                blocks = [np.ascontiguousarray(whole[:, at : at + width], "<i4").tobytes() for at in range(0, whole.shape[1], width)]
                ids = [some.column("vec_id").to_pylist()] + [None] * (len(blocks) - 1)
                yield {"chunk": [chunk] * len(blocks), "block": range(len(blocks)), "ids": ids, "cells": blocks}
                chunk += 1

    return map_batches(vectors, cut, "chunk long, block int, ids array<long>, cells binary")


def first_centroids(vectors: DataFrame, k: int, seed: int, width: int) -> DataFrame:
    """(block, cluster, place, value) of the ``k`` vectors with the smallest hash of seed and id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.select(name.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k)  # k rows in all
    numbered = starts.agg(F.array_sort(F.collect_list(F.struct(F.col("name").isNull(), "name", "v"))).alias("rows"))
    numbered = numbered.select(F.posexplode("rows").alias("cluster", "row")).select("cluster", F.posexplode("row.v").alias("at", "value"))
    block = F.floor(F.col("at") / width).cast("int")
    return numbered.select(block.alias("block"), "cluster", (F.col("at") % width).alias("place"), F.col("value").cast("long").alias("value"))


def slices(centroids: DataFrame) -> DataFrame:
    """(block, slice): all values of a block, cluster by cluster."""
    rows = F.array_sort(F.collect_list(F.struct("cluster", "place", "value")))
    return centroids.groupBy("block").agg(F.transform(rows, lambda r: r["value"]).alias("slice"), F.countDistinct("cluster").alias("k"))


def partial_distances(cells: bytes, slice_: np.ndarray, k: int) -> np.ndarray:
    """Squared distances of a cell's rows to each centroid, over its columns only."""
    centres = slice_.reshape(k, -1)
    rows = np.frombuffer(cells, "<i4").reshape(-1, centres.shape[1]).astype(np.int64)
    out = np.empty((len(rows), k), np.int64)
    for i, centre in enumerate(centres):
        gap = rows - centre
        out[:, i] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(shards: DataFrame, centroids: DataFrame) -> DataFrame:
    """(chunk, cluster, distance): 32-bit clusters and 64-bit distances of the chunk's vectors."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunk, held, k = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                part = partial_distances(row["cells"], np.array(row["slice"], np.int64), row["k"])
                if row["chunk"] == chunk:
                    held += part
                    continue
                if held is not None:
                    yield {"chunk": [chunk], "k": [k], "part": [held.tobytes()]}
                chunk, held, k = row["chunk"], part, row["k"]
        if held is not None:
            yield {"chunk": [chunk], "k": [k], "part": [held.tobytes()]}

    def smallest(blocks: pa.Table) -> pa.Table:
        k = blocks.column("k")[0].as_py()
        total = sum(np.frombuffer(p.as_py(), np.int64) for p in blocks.column("part")).reshape(-1, k)
        cluster = total.argmin(1)  # the first of equal ones
        distance = total[np.arange(len(total)), cluster]
        return pa.table({"chunk": blocks.column("chunk")[:1], "cluster": [cluster.astype("<i4").tobytes()], "distance": [distance.astype("<i8").tobytes()]})

    parts = map_batches(shards.select("chunk", "block", "cells").join(slices(centroids), "block"), distances, "chunk long, k int, part binary")
    return parts.groupBy("chunk").applyInArrow(smallest, "chunk long, cluster binary, distance binary")


def moved(shards: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """The next centroids: exact floor of the mean; one without vectors stays."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                cluster = np.frombuffer(row["cluster"], "<i4")
                rows = np.frombuffer(row["cells"], "<i4").reshape(len(cluster), -1).astype(np.int64)
                for c in np.unique(cluster).tolist():
                    mine = rows[cluster == c]
                    total, n = held.get((row["block"], c), (0, 0))
                    held[row["block"], c] = total + mine.sum(0), n + len(mine)
        for (block, c), (total, n) in held.items():
            yield {"block": [block] * len(total), "cluster": [c] * len(total), "place": range(len(total)), "total": total, "n": [n] * len(total)}

    cells = shards.select("chunk", "block", "cells").join(assigned.select("chunk", "cluster"), "chunk")
    sums = map_batches(cells, totals, "block int, cluster int, place int, total long, n long")
    sums = sums.groupBy("block", "cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.expr("(total - pmod(total, n)) div n")
    return centroids.join(sums, ["block", "cluster", "place"], "left").select("block", "cluster", "place", F.coalesce(mean, "value").alias("value"))


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 16) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v) -> rows (vec_id, cluster, distance) and centroids (block, cluster, place, value)."""
    centroids = materialize(first_centroids(vectors, k, seed, width), "centroids")
    shards = materialize(packed(vectors, width), "shards")
    for _ in range(rounds):
        assigned = materialize(nearest(shards, centroids).drop("distance"), "assigned")
        centroids = materialize(moved(shards, assigned, centroids), "centroids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                yield {"vec_id": row["ids"], "cluster": np.frombuffer(row["cluster"], "<i4"), "distance": np.frombuffer(row["distance"], "<i8")}

    last = shards.filter("block = 0").select("chunk", "ids").join(nearest(shards, centroids), "chunk").drop("chunk")
    return materialize(map_batches(last, rows, "vec_id long, cluster int, distance long"), "clusters"), centroids


def with_inertia(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """``rows`` with the sums of distances and the centroid's hash; the joined table has a row for each cluster."""
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    whole = F.sum("part").over(_every())
    per = per.select("cluster", F.col("part").try_cast("long").alias("cluster_inertia"), whole.try_cast("long").alias("inertia"))
    values = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    text = F.array_join(F.transform(values, lambda r: r["value"].cast("string")), ",")
    names = centroids.groupBy("cluster").agg(F.sha2(text, 256).alias("centroid_sha256"))
    return rows.join(per.join(names, "cluster"), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _every():
    from pyspark.sql import Window

    return Window.partitionBy()


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), 64, 1024)
    return with_inertia(*clusters(vectors))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL, a pair of common tables for each round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}
)""",
        f"""cells AS MATERIALIZED (SELECT r, unnest(range({dims})) AS d, unnest(v) AS x FROM kept)""",
        f"""c0 AS MATERIALIZED (
  SELECT cluster, unnest(range({dims})) AS d, unnest(v) AS c FROM (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM kept) WHERE cluster < {k}
)""",
    ]
    near = """a{i} AS MATERIALIZED (
  SELECT r, cluster, distance FROM (
    SELECT r, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM cells JOIN c{i} USING (d) GROUP BY r, cluster)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
)"""
    move = """c{j} AS MATERIALIZED (
  SELECT o.cluster, o.d, coalesce(s.m, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM cells JOIN a{i} USING (r) GROUP BY cluster, d) s ON s.cluster = o.cluster AND s.d = o.d
)"""
    for i in range(rounds):
        steps += [near.format(i=i), move.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    steps.append(f"names AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN names USING (cluster)"""


OP11_SQL = _sql()

"""Hard negatives by shared lists: one list of candidates, in order of an angular upper bound, for each cluster of anchors.

Anchors are clustered by direction. If ``r`` is the largest angle between a cluster's anchors and its centroid, and ``t`` the
angle between a candidate and that centroid, no anchor's inner product with the candidate exceeds |anchor| |candidate|
cos(max(0, t - r)). For each cluster the candidates are sorted by |candidate| cos(...) once, and every anchor of the cluster walks
down that list until the bound certifies that nothing further can enter its result.

All rows are dealt into parts and anchors into bundles (slices of clusters), and a task walks the lists of one bundle over one
part: a list is one list cut into parts, each in order, and the best of the parts are merged. Memory is bounded by ``PART_ROWS`` and
``BUNDLE_ROWS`` whatever label, cluster or copy holds a third of all rows; no label or id is ever a grouping key. Two walks:

1. Positives: the best ``positives`` rows of the anchor's label. A walk ends when the bound is under the worst that counts; anchors of the
   same slice, being rows too, give each other a first value of it.
2. Negatives: a positive of score p has the window low * p <= score <= high * p. A walk ends when the bound is under every window
   or the worst that counts in each. (50 * p <= 100 * score <= 95 * p is compared in integers.)

The bounds are certified with a margin for floating point, so results are exact; scores are exact integers.

Cluster centroids come from at most ``SAMPLE`` anchors, those of smallest hash (a bounded sample fits the index; every row is in
every list). Rows with a null label, a null vector, or a null or non-finite component take no part. A null id is no anchor and
loses ties. Vectors of other lengths count as followed by zeros. Components beyond +-2^27 are held there. Repeated rows are rows of their own: a copy
of an anchor may be its positive, and each copy of an anchor gives rows. No anchors or an empty table give an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, table

#: Anchors the centroids are fitted on, at most.
SAMPLE = 8192
#: Rows of a part, anchors of a bundle and of a slice, on average.
PART_ROWS, BUNDLE_ROWS, SLICE_ROWS = 32_768, 8_192, 1_024
#: Parts at least, so that small inputs use many tasks.
LEAST_PARTS = 32
#: Candidates that the anchors of a slice look at in one step.
STEP = 512
#: Angle and share of a bound that cover rounding.
MARGIN = 1e-6
MOST = 1 << 27


def integer_rows(rows: DataFrame, scale: int = 256, shift: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; labels of every ``shift``-th id are moved by one."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    moved = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.filter(F.col("label").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), whole.alias("v"))


def dense(column, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims).astype(np.float64)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point where every sum fits, else in integers."""
    largest = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero for zero) and lengths."""
    length = np.linalg.norm(rows, axis=1)
    return rows / np.where(length > 0, length, 1)[:, None], length


def fitted(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced starts."""
    unit, _ = directions(sample)
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        best = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, unit)
        seen = np.bincount(best, minlength=k) > 0
        centres[seen] = directions(sums[seen])[0]
    return centres


def sliced_anchors(anchors: DataFrame, dims: int) -> DataFrame:
    """Anchors with their ``slice`` (part of a cluster) and ``bundle`` (slices that a task takes together)."""
    n = anchors.count()
    # the bounded sample; ties of the hash are equal rows
    sample = anchors.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    k = max(1, min(256, n // 64))
    centres = fitted(dense(sample.column("v"), dims), k) if n else np.zeros((1, dims))

    def with_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            best = (directions(dense(batch.column("v"), dims))[0] @ centres.T).argmax(1)
            yield {c: batch.column(c) for c in batch.schema.names} | {"cluster": best}

    found = materialize(map_batches(anchors, with_cluster, "row long, vec_id long, label long, v array<int>, cluster int"), "anchors")
    sizes = {r["cluster"]: r["count"] for r in found.groupBy("cluster").count().collect()}  # at most 256 rows
    start, first, cuts = 0, [], []
    for c in range(k):
        first.append(start)
        cuts.append(max(1, -(-sizes.get(c, 0) // SLICE_ROWS)))
        start += cuts[-1]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    slice_ = at(first) + F.pmod(F.xxhash64("row"), at(cuts).cast("long"))
    bundles = max(1, -(-n // BUNDLE_ROWS))
    return found.withColumn("slice", slice_.cast("int")).withColumn("bundle", (F.col("slice") % bundles).cast("int")).drop("cluster")


class SharedList:
    """A part's rows in the order of one cluster's bound."""

    def __init__(self, rows: np.ndarray, unit: np.ndarray, length: np.ndarray, members: np.ndarray):
        toward, self.reach = directions(members)
        centre = directions(toward.sum(0, keepdims=True))[0][0]
        # a zero anchor's products are all zero, which any angle bounds
        widest = np.arccos(np.clip((toward @ centre)[self.reach > 0], -1, 1)).max(initial=0.0) + MARGIN
        angle = np.arccos(np.clip(unit @ centre, -1, 1))
        bound = length * np.cos(np.clip(angle - widest, 0, np.pi))
        self.order = np.argsort(-bound, kind="stable")
        self.bound, self.rows, self.margin = bound[self.order], rows[self.order], MARGIN * length.max(initial=0.0)

    def limit(self, start: int) -> np.ndarray:
        """For each anchor, a value that no product from place ``start`` on exceeds."""
        rest = self.bound[start] if start < len(self.bound) else -np.inf
        return self.reach * (rest + self.margin) + MARGIN


def best_of(key: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best of each key: higher scores first, ties by smaller id."""
    order = np.lexsort((ident, -score, key))
    sorted_key = key[order]
    new = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.zeros(0, int)
    place = np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)]))
    return order[place < most]


def walk(shared: SharedList, members: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, seeds: list, ids: np.ndarray, most: int):
    """(anchor, window, place in the list, score) of the best ``most`` rows of each anchor's window.

    ``low`` and ``high`` (anchors x windows) bound the scores; ``allowed(anchors, places)`` says which pairs count at all. ``seeds`` are
    score matrices of known rows (anchors x rows, with a mask) that give a first value of the worst score that counts.
    """
    n, windows = low.shape
    floor = low.copy()
    for scores, mask in seeds:
        for w in range(windows):
            fits = np.where(mask & (scores >= low[:, w : w + 1]) & (scores <= high[:, w : w + 1]), scores, np.iinfo(np.int64).min)
            if fits.shape[1] >= most:
                floor[:, w] = np.maximum(floor[:, w], np.partition(fits, -most, axis=1)[:, -most])
    open_ = low <= high
    key, score, place = (np.zeros(0, np.int64) for _ in range(3))
    for start in range(0, len(shared.order), STEP):
        limit = shared.limit(start)
        alive = np.flatnonzero((open_ & (limit[:, None] >= floor)).any(1))
        if not len(alive):
            break
        block = slice(start, start + STEP)
        scores = products(members[alive], shared.rows[block])
        fine = allowed(alive, shared.order[block])
        found = []
        for w in range(windows):
            a, c = np.nonzero(fine & (scores >= floor[alive, w : w + 1]) & (scores <= high[alive, w : w + 1]) & open_[alive, w : w + 1])
            found.append((alive[a] * windows + w, scores[a, c], c + start))
        if not any(len(f[0]) for f in found):
            continue
        key, score, place = (np.concatenate([old, *new]) for old, new in zip((key, score, place), zip(*found)))
        kept = best_of(key, score, ids[shared.order[place]], most)
        key, score, place = key[kept], score[kept], place[kept]
        full, counts = np.unique(key, return_counts=True)
        last = np.cumsum(counts) - 1  # the worst of each key, as best_of sorts
        full, last = full[counts == most], last[counts == most]
        worst = score[last]
        floor[full // windows, full % windows] = np.maximum(floor[full // windows, full % windows], worst)
    return key // windows, key % windows, shared.order[place], score


def _ids(column) -> np.ndarray:
    """Ids for ties: a null one is last."""
    return column.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()


def dealt(rows: DataFrame, anchors: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows for every bundle and anchors for every part, to be grouped by (bundle, part)."""
    parts = max(LEAST_PARTS, -(-n // PART_ROWS))
    bundles = anchors.agg(F.coalesce(F.max("bundle"), F.lit(-1))).first()[0] + 1
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    left = rows.withColumn("part", part).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(max(bundles - 1, 0)))))
    return left, anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), parts


def positives_of(rows: DataFrame, anchors: DataFrame, n: int, dims: int, most: int) -> DataFrame:
    """(anchor_row, anchor_id, place, positive_id, positive_score)."""

    def search(part: pa.Table, bundle: pa.Table) -> pa.Table:
        out = []
        if len(part) and len(bundle):
            v, label, row, ids = dense(part.column("v"), dims), part.column("label").to_numpy(), part.column("row").to_numpy(), _ids(part.column("vec_id"))
            unit, length = directions(v)
            a_v, a_label, a_row, slice_ = dense(bundle.column("v"), dims), bundle.column("label").to_numpy(), bundle.column("row").to_numpy(), bundle.column("slice").to_numpy()
            for s in np.unique(slice_):
                mine = np.flatnonzero(slice_ == s)
                m, of, me = a_v[mine], a_label[mine], a_row[mine]
                shared = SharedList(v, unit, length, m)
                allowed = lambda a, c: (of[a][:, None] == label[c]) & (me[a][:, None] != row[c])  # noqa: E731, B023
                low = np.full((len(m), 1), np.iinfo(np.int64).min)
                high = np.full((len(m), 1), np.iinfo(np.int64).max)
                seeds = [(products(m, m), (of[:, None] == of) & (me[:, None] != me))]
                a, _, c, score = walk(shared, m, allowed, low, high, seeds, ids, most)
                out.append((mine[a], c, score))
        a, c, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"anchor_row": bundle.column("row").take(pa.array(a)), "anchor_id": bundle.column("vec_id").take(pa.array(a)), "positive_id": part.column("vec_id").take(pa.array(c)), "positive_score": pa.array(score)})

    left, right, _ = dealt(rows, anchors, n)
    found = left.groupBy("bundle", "part").cogroup(right.groupBy("bundle", "part")).applyInArrow(search, "anchor_row long, anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last()))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def negatives_of(rows: DataFrame, anchors: DataFrame, n: int, dims: int, most: int, window: tuple[int, int]) -> DataFrame:
    """(anchor_row, place, rank, negative_id, negative_score); ``anchors`` have ``scores``, those of their positives."""
    low_share, high_share = window

    def search(part: pa.Table, bundle: pa.Table) -> pa.Table:
        out = []
        if len(part) and len(bundle):
            v, label, ids = dense(part.column("v"), dims), part.column("label").to_numpy(), _ids(part.column("vec_id"))
            unit, length = directions(v)
            a_v, a_label, slice_ = dense(bundle.column("v"), dims), bundle.column("label").to_numpy(), bundle.column("slice").to_numpy()
            scores = bundle.column("scores").to_pylist()
            wide = max(map(len, scores))
            # an empty window where there is no such positive
            low, high = np.full((len(scores), wide), 1, np.int64), np.zeros((len(scores), wide), np.int64)
            for i, own in enumerate(scores):
                low[i, : len(own)] = [-(-low_share * p // 100) for p in own]
                high[i, : len(own)] = [high_share * p // 100 for p in own]
            for s in np.unique(slice_):
                mine = np.flatnonzero(slice_ == s)
                m, of = a_v[mine], a_label[mine]
                shared = SharedList(v, unit, length, m)
                allowed = lambda a, c: of[a][:, None] != label[c]  # noqa: E731, B023
                seeds = [(products(m, m), of[:, None] != of)]
                a, w, c, score = walk(shared, m, allowed, low[mine], high[mine], seeds, ids, most)
                out.append((mine[a], w, c, score))
        a, w, c, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"anchor_row": bundle.column("row").take(pa.array(a)), "place": pa.array(w + 1).cast(pa.int32()), "negative_id": part.column("vec_id").take(pa.array(c)), "negative_score": pa.array(score)})

    left, right, _ = dealt(rows, anchors, n)
    found = left.groupBy("bundle", "part").cogroup(right.groupBy("bundle", "part")).applyInArrow(search, "anchor_row long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_row", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """(vec_id, label, v) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "v"), "vectors")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    anchors = sliced_anchors(rows.filter(F.col("vec_id") % every == 0), dims)
    found = materialize(positives_of(rows, anchors, n, dims, positives), "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda r: r["positive_score"])
    scored = anchors.join(found.groupBy("anchor_row").agg(scores.alias("scores")).withColumnRenamed("anchor_row", "row"), "row")
    worst = negatives_of(rows, scored, n, dims, negatives, window)
    out = found.join(worst, ["anchor_row", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(integer_rows(table(spark, sf_dir, "embeddings")))


#: The same in SQL, over all pairs of anchors and rows.
OP13_SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM kept a JOIN kept c ON a.r <> c.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS place
  FROM scores WHERE same QUALIFY place <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY a, place ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN (SELECT a, vec_id, score FROM scores WHERE NOT same) n USING (a)
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

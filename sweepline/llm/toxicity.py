"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct hashed terms of a text: linear weights
for single terms, factors for what two terms say together. Terms are runs of letters, lower-cased.
The machine is fitted in numpy by AdaGrad on a bounded sample of labelled rows (``SAMPLE_ROWS`` ids by a hash of the
id, then so many of their different texts by a hash of id and text, chosen in Spark); scoring covers every row in Spark tasks.

Nulls: a null text is an empty one and gets the score of no terms; a null ``doc_id`` is passed on, is not held out
and never a training row; a null label isn't a label. Repeated rows each give a row and are learned from once. Only ``doc_id`` and ``text``
are read, of the labels ``doc_id`` and ``toxic``. With no labelled row the score is 0 for all. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, in_slices, is_held_out, map_arrow, table

#: Labelled rows that the machine is fitted on at most.
SAMPLE_ROWS = 12_000
BUCKET_BITS = 18
LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str) -> np.ndarray:
    """Hashed distinct words of a text."""
    mask, crc = (1 << BUCKET_BITS) - 1, zlib.crc32
    return np.fromiter({crc(w.encode("utf-8", "surrogatepass")) & mask for w in set(LETTERS.findall(text.lower()))}, np.int32)


@dataclass
class FactorizationMachine:
    bias: float
    slots: np.ndarray  # bucket -> row of weights and factors, -1 without
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        known = [s[s >= 0] for s in (self.slots[r] for r in rows)]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        total = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate(known)
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            v = self.factors[flat]
            sums = np.add.reduceat(v, starts)
            squares = np.add.reduceat((v * v).sum(1), starts)
            total[full] += np.add.reduceat(self.weights[flat], starts) + 0.5 * ((sums * sums).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _log_odds(rows: list[np.ndarray], labels: np.ndarray, sure: float, least: int) -> np.ndarray:
    """Log-odds of the buckets whose link with the label is beyond chance (G-squared over ``sure``), else 0."""
    size = 1 << BUCKET_BITS
    flat, of = np.concatenate(rows).astype(np.int64), np.repeat(labels, np.fromiter(map(len, rows), np.int64, len(rows)))
    n, toxic = np.bincount(flat, minlength=size).astype(float), np.bincount(flat, of, size)
    total, positive = len(labels), labels.sum()
    terms_ = ((toxic, positive / total), (n - toxic, 1 - positive / total))
    g = 2 * sum(seen * np.log(np.maximum(seen, 1e-12) / np.maximum(n * share, 1e-12)) for seen, share in terms_)
    odds = np.log((toxic + 0.25) / (n - toxic + 0.25)) - np.log(positive / (total - positive))
    return np.where((g > sure) & (n >= least), odds, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, rate: float = 0.1, sure: float = 12.0, least: int = 3, epochs: int = 12, seed: int = 11) -> FactorizationMachine:
    """AdaGrad on log loss, ``epochs`` times over all rows; terms in fewer than ``least`` rows are left out.

    Linear weights start from the log-odds of terms that are clearly linked with the label; the others start from 0
    and are pulled there more strongly, so that rare words of a few labelled rows gain no weight by chance.
    """
    counts = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), minlength=1 << BUCKET_BITS)
    kept = np.flatnonzero(counts >= least)
    slots = np.full(1 << BUCKET_BITS, -1, np.int32)
    slots[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    rate_of = labels.mean() if len(labels) else 0.0
    bias = float(np.log((rate_of + 1e-6) / (1 - rate_of + 1e-6))) if len(labels) else -30.0
    w, v = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank))
    machine = FactorizationMachine(bias, slots, w, v)
    if not len(labels) or rate_of in (0.0, 1.0) or not len(kept):
        v[:] = 0
        return machine
    w[:] = _log_odds(rows, labels, sure, least)[kept]
    decay = np.where(w == 0, 2e-3, 1e-4)
    gw, gv, gb = np.full(len(kept), 1e-2), np.full((len(kept), rank), 1e-2), 1e-2
    cut = [s[s >= 0] for s in (slots[r] for r in rows)]
    batches = max(1, len(cut) // 128)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(cut)), batches):
            own = [cut[i] for i in part]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            flat, row = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
            vf = v[flat]
            sums = np.stack([np.bincount(row, vf[:, k], len(own)) for k in range(rank)], 1)
            squares = np.bincount(row, (vf * vf).sum(1), len(own))
            z = machine.bias + np.bincount(row, w[flat], len(own)) + 0.5 * ((sums * sums).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, error[row]) / len(own) + decay[touched] * np.sign(w[touched])
            gw[touched] += g * g
            w[touched] -= rate * g / np.sqrt(gw[touched])
            pull = error[row][:, None] * (sums[row] - vf)
            for k in range(rank):
                g = np.bincount(inverse, pull[:, k]) / len(own) + 5e-4 * v[touched, k]
                gv[touched, k] += g * g
                v[touched, k] -= 0.2 * rate * g / np.sqrt(gv[touched, k])
            gb += error.mean() ** 2
            machine.bias -= rate * error.mean() / np.sqrt(gb)
    return machine


def train(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """Fit on labelled rows that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null").distinct()
    chosen = usable.filter(~is_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE_ROWS)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_ROWS rows of 12 bytes

    def run(batches):
        for batch in in_slices(batches):
            yield {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "text_hash": batch["text_hash"], "terms": [terms(t or "").tobytes() for t in batch["text"]]}

    key = ["doc_id", "text_hash", "toxic"]
    different = map_arrow(rows, run, "doc_id long, toxic int, text_hash long, terms binary").groupBy(*key).agg(F.first("terms").alias("terms"))
    # Bounded before it is collected; an id of many texts doesn't crowd out the others.
    found = different.orderBy(F.xxhash64("doc_id", "text_hash"), *key).limit(SAMPLE_ROWS).toPandas().sort_values(key)
    return fit([np.frombuffer(t, np.int32) for t in found["terms"]], found["toxic"].to_numpy(np.float64).clip(0, 1))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see the module's text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for batch in in_slices(batches):
            scores = model.value.scores([terms(t or "") for t in batch["text"]])
            yield {"doc_id": batch["doc_id"], "score": scores.tolist()}

    scored = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic; columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.concatenate([model.value.scores([terms(t or "") for t in texts[i : i + 500]]) for i in range(0, len(texts), 500)] or [np.zeros(0)])
            yield batch.filter(_mask(scores < 0.5))

    return docs.mapInArrow(lambda batches: freeing(run(batches)), docs.schema)


def _mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

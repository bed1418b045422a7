"""Benchmark decontamination by greedy string tiling.

Words of a document and of a benchmark item that share a run of ``seed_words`` words are joined on that run. For each pair so joined the
longest matches of words not yet used are marked again and again, until none of ``seed_words`` is left; the marked share of the
item's words is its coverage. As tiles may stand in any order, passages whose sentences were moved are found too.

The join is one of tables. Items give (run, item), documents (text, place, run); a run is named by two independent Karp-Rabin
values of 64 bits over hashes of its words, so different runs don't meet. Documents first drop the runs that no item
has, by a bit table of the items' runs (``MOST_BITS`` bits at most, whatever the benchmark's size); the rest is joined by Spark, which
splits runs that many documents share. Places of a (text, item) pair come together, with the item's words, and are tiled in one task: equal runs
become stretches of diagonals in slabs of ``SLAB`` pairs, so a word repeated thousands of times on both sides stays bounded.
Texts are named by their SHA-256: copies are tiled once.

An item counts as leaked at coverage ``least`` or more. Items under ``seed_words`` words match as a whole. Such an item
("yes") is reported wherever it stands, but drops only a document that has no other words.

Nulls: a null text is an empty one, in either table; empty items match nothing; null ids are passed on.
Repeated documents each give their rows; items that share an id are items of their own. Only ``doc_id``, ``text``,
``item_id`` are read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, in_slices, map_arrow, map_batches, materialize, numbered, table

TOKENS = re.compile(r"[^\W_]+")
#: Bits of a bit table, as powers of two: 64 for each entry between these bounds.
LEAST_BITS, MOST_BITS = 16, 26
#: Characters of texts that are split together; their words take some fifty times as many bytes.
SLICE_CHARS = 2_000_000
#: Pairs of equal runs looked at together.
SLAB = 1 << 20
#: Odd bases of the two Karp-Rabin values.
BASES = (np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15))


def tokens(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words), np.uint64, len(words))


def rolling(ids: np.ndarray, width: int, base: np.uint64 = BASES[0], at: np.ndarray | None = None) -> np.ndarray:
    """Karp-Rabin values of every run of ``width`` ids, or of those that start ``at`` these places, modulo 2^64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n if at is None else len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * base + (ids[k : k + n] if at is None else ids[at + k])
        return (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


class BitTable:
    """Which leading bits of 64-bit hashes are in a set: a filter that lets through all members and few others."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.shift, self.packed = np.uint64(64 - bits), packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.packed[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def bit_table(rows: DataFrame, hash_: str) -> BitTable:
    """The bit table of a column of hashes; its pages are made in tasks, and at most 2 ** (``MOST_BITS`` - 3) bytes are collected."""
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(64 * max(n, 1)))))
    slot = F.shiftrightunsigned(hash_, 64 - bits)
    slots = rows.select(F.shiftright(slot, 15).alias("page"), slot.bitwiseAND((1 << 15) - 1).cast("int").alias("bit")).distinct()

    def page(found: pa.Table) -> pa.Table:
        own = np.zeros(1 << 15, np.uint8)
        own[found.column("bit").to_numpy()] = 1
        return pa.table({"page": found.column("page")[:1], "own": [np.packbits(own, bitorder="little").tobytes()]})

    packed = np.zeros(1 << (bits - 3), np.uint8)
    for row in slots.groupBy("page").applyInArrow(page, "page long, own binary").toLocalIterator():
        packed[row["page"] << 12 : (row["page"] + 1) << 12] = np.frombuffer(row["own"], np.uint8)
    return BitTable(bits, packed)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # diagonal (doc - item), first place in the item, places


def _stretches(diagonal: np.ndarray, item: np.ndarray) -> Runs:
    """Stretches of neighbouring places on a diagonal."""
    order = np.lexsort((item, diagonal))
    diagonal, item = diagonal[order], item[order]
    new = np.ones(len(item), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (item[1:] != item[:-1] + 1)
    first = np.flatnonzero(new)
    return diagonal[first], item[first], np.diff(np.append(first, len(item)))


def _joined(parts: list[Runs]) -> Runs:
    """Stretches of different slabs as one, where they touch."""
    diagonal, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, diagonal))
    diagonal, start, size = diagonal[order], start[order], size[order]
    new = np.ones(len(start), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + size[:-1])
    first = np.flatnonzero(new)
    return diagonal[first], start[first], np.add.reduceat(size, first) if len(first) else size


def equal_runs(places: np.ndarray, values: np.ndarray, item: np.ndarray) -> Runs:
    """All stretches of equal runs of a document (``places`` in order, their ``values``) and an item (values of all its places)."""
    order = np.argsort(item, kind="stable")
    ordered = item[order]
    left, right = np.searchsorted(ordered, values, "left"), np.searchsorted(ordered, values, "right")
    counts = right - left
    ends, parts, at = np.cumsum(counts), [], 0
    while at < len(places):
        base = ends[at] - counts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + SLAB, "right")))
        n = counts[at:stop]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = order[np.repeat(left[at:stop], n) + inner]
        parts.append(_stretches(np.repeat(places[at:stop], n) - i, i))
        at = stop
    return _joined(parts) if parts else (np.zeros(0, np.int64),) * 3


def tiles_of(runs: Runs, n_doc: int, n_item: int, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of stretches of equal runs of ``width`` words: (start in doc, start in item, words), longest first.

    Between equally long matches the one that is first in the item, then in the document, is marked. Marking ends when the item has
    no ``width`` free words in a row left.
    """
    diagonal, start, size = runs
    heap = list(zip((-(size + width - 1)).tolist(), start.tolist(), (start + diagonal).tolist(), strict=True))
    heapq.heapify(heap)
    used_doc, used_item, out = np.zeros(n_doc, bool), np.zeros(n_item, bool), []
    while heap:
        length, i, d = heapq.heappop(heap)
        length = -length
        taken = np.concatenate([[True], used_item[i : i + length] | used_doc[d : d + length], [True]])
        cuts = np.flatnonzero(taken)
        gaps = np.diff(cuts) - 1
        if len(cuts) == 2:
            out.append((d, i, length))
            used_item[i : i + length] = True
            used_doc[d : d + length] = True
            walls = np.flatnonzero(np.concatenate([[True], used_item, [True]]))
            if np.diff(walls).max() - 1 < width:
                break
            continue
        for k in np.flatnonzero(gaps >= width).tolist():
            heapq.heappush(heap, (-int(gaps[k]), i + int(cuts[k]), d + int(cuts[k])))
    return out


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """``tiles_of`` from ``seeds``: places (doc, item) of equal runs of ``width`` words."""
    d, i = np.array(seeds, np.int64).reshape(-1, 2).T
    return tiles_of(_stretches(d - i, i), len(doc), len(item), width)


def _key(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): hashes of the words of every item that has any, under numbers of their own."""

    def run(batches):
        for batch in in_slices(batches):
            words = [word_hashes(tokens(t or "")).view(np.int64) for t in batch["text"]]
            yield {"item": batch["item"], "item_id": batch["item_id"], "words": [w.tolist() for w in words]}

    rows = materialize(benchmark.select(F.col("item_id").cast("long"), "text").withColumn("item", F.monotonically_increasing_id()), "leak-items")
    return materialize(map_arrow(rows, run, "item long, item_id long, words array<long>").filter("size(words) > 0"), "leak-words")


def _seeds(items: DataFrame, width: int) -> DataFrame:
    """(width, h1, h2, item): an item's different runs; a short item is one run."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"width": [], "h1": [], "h2": [], "item": []}
            for item, words in zip(batch["item"], batch["words"], strict=True):
                ids = np.array(words, np.int64).view(np.uint64)
                own = min(width, len(ids))
                pairs = np.unique(np.stack([rolling(ids, own, b) for b in BASES]), axis=1).view(np.int64)
                for name, values in (("width", [own] * pairs.shape[1]), ("h1", pairs[0].tolist()), ("h2", pairs[1].tolist()), ("item", [item] * pairs.shape[1])):
                    out[name] += values
            yield out

    return map_arrow(items.select("item", "words"), run, "width int, h1 long, h2 long, item long")


def _places(docs: DataFrame, known: BitTable, widths: list[int], seed_words: int) -> DataFrame:
    """(key, n_words, width, place, h1, h2): runs of the documents that the bit table lets through; one place of a short run."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of bounded size

    def run(batches):
        table_ = shared.value
        for batch in in_slices(batches, chars=SLICE_CHARS):
            texts = [t or "" for t in batch["text"]]
            words, codes, ends = numbered([tokens(t) for t in texts])
            flat, ends = word_hashes(words)[codes], np.array(ends)
            sizes = np.diff(ends)
            doc = np.repeat(np.arange(len(texts)), sizes)
            keys: dict[int, bytes] = {}
            for width in widths:
                h1 = rolling(flat, width)
                at = np.flatnonzero(table_.has(h1))
                at = at[at + width <= ends[doc[at] + 1]]  # within one document
                h1, h2, of = h1[at], rolling(flat, width, BASES[1], at), doc[at]
                if width < seed_words:
                    _, first = np.unique(np.stack([of.astype(np.uint64), h1, h2]), axis=1, return_index=True)
                    at, h1, h2, of = at[first], h1[first], h2[first], of[first]
                for d in np.unique(of).tolist():
                    if d not in keys:
                        keys[d] = hashlib.sha256(texts[d].encode("utf-8", "surrogatepass")).digest()
                yield {"key": [keys[d] for d in of.tolist()], "n_words": sizes[of], "width": np.full(len(at), width), "place": at - ends[of], "h1": h1.view(np.int64), "h2": h2.view(np.int64)}

    schema = "key binary, n_words long, width int, place int, h1 long, h2 long"

    def lists(batches):
        return run({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)

    return map_batches(docs.select("text"), lists, schema)


def _found(docs: DataFrame, benchmark: DataFrame, seed_words: int, least: float) -> DataFrame:
    """(key, item_id, item_words, n_words, coverage, matched_words, tiles) of each text and item at coverage ``least`` or more."""
    items = _items(benchmark)
    seeds = materialize(_seeds(items, seed_words), "leak-seeds")
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # at most ``seed_words`` numbers
    joined = _places(docs, bit_table(seeds, "h1"), widths, seed_words).join(seeds, ["width", "h1", "h2"])
    pairs = joined.groupBy("key", "item").agg(F.first("n_words").alias("n_words"), F.first("width").alias("width"), F.array_sort(F.collect_set(F.struct("place", "h1"))).alias("p"))
    pairs = pairs.select("key", "item", "n_words", "width", F.col("p.place").alias("places"), F.col("p.h1").alias("values")).join(items, "item")

    def run(batches):
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            out = {"coverage": [], "matched_words": [], "tiles": []}
            for r in range(len(batch)):
                words = column["words"][r].values.to_numpy().view(np.uint64)
                width = column["width"][r].as_py()
                if width < seed_words:
                    marked = [(0, 0, width)]
                else:
                    places = column["places"][r].values.to_numpy().astype(np.int64)
                    runs = equal_runs(places, column["values"][r].values.to_numpy().view(np.uint64), rolling(words, width))
                    marked = tiles_of(runs, int(column["n_words"][r].as_py()), len(words), width)
                matched = sum(n for *_, n in marked)
                out["coverage"].append(matched / len(words))
                out["matched_words"].append(matched)
                out["tiles"].append(len(marked))
            lengths = np.diff(column["words"].offsets.to_numpy())
            yield {"key": column["key"], "item_id": column["item_id"], "item_words": lengths, "n_words": column["n_words"], **out}

    found = map_batches(pairs, run, "key binary, item_id long, item_words long, n_words long, coverage double, matched_words long, tiles long")
    return materialize(found.filter(F.col("coverage") >= least), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = 5, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, tiles) of the documents and items at coverage ``least`` or more."""
    found = _found(docs, benchmark, seed_words, least)
    listed = found.groupBy("key").agg(F.collect_list(F.struct("item_id", "coverage", "matched_words", "tiles")).alias("leaks"))
    some = _with_some(docs.select(F.col("doc_id").cast("long"), _key().alias("key")), "key", listed)
    return some.join(listed, "key").select("doc_id", F.inline("leaks"))


def _with_some(rows: DataFrame, key: str, others: DataFrame, others_key: str = "key", others_too: bool = False):
    """``rows`` that may have a key of ``others``, by a bit table, and if asked for those that surely have none: so few rows are shuffled by a join."""
    name = F.xxhash64(key)
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(others.select(F.xxhash64(others_key).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(hashes.to_numpy().view(np.uint64)))

    some = rows.filter(maybe(name))
    return (some, rows.filter(~maybe(name))) if others_too else some


def without_leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = 5, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that leak no item, short ones aside (see the module's text); columns stay as they are.

    Only documents whose key may be among the dropped ones, by a bit table, go through a join; the others stay where they are.
    """
    whole = (F.col("item_words") >= seed_words) | (F.col("matched_words") == F.col("n_words"))
    dropped = materialize(_found(docs, benchmark, seed_words, least).filter(whole).select("key").distinct(), "leaked")
    (key,) = free_names(docs, "key")
    some, sure = _with_some(docs.withColumn(key, _key()), key, dropped, others_too=True)
    kept = some.join(dropped.withColumnRenamed("key", key), key, "left_anti")
    return sure.unionByName(kept).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint is the bitwise majority of its shingles' 64-bit hashes. Fingerprints within a Hamming
budget are linked, and linked documents form groups. To spread the self-join over tasks, every distinct
fingerprint enters one trie per *table*: a table puts some blocks of bits first and needs them to be equal. With
``budget + k`` disjoint blocks any two fingerprints within the budget agree on ``k`` of them, so a table for each choice of ``k``
blocks loses nothing; ``k`` grows with the number of fingerprints, so that unrelated ones seldom meet. Inside a
task the trie below such blocks is joined with itself: pairs of nodes are walked level by level, differing bits
are added up, and a pair is dropped as soon as it exceeds the budget. A task returns a spanning forest of the
links it found, never the pairs themselves, so that thousands of near copies stay linear in size.

Nulls: a null text is an empty one; a null ``doc_id`` keeps its row, and its group is named by the smallest
id that isn't null (null if there is none). Repeated rows and equal texts share a fingerprint, hence a group.
Only ``doc_id`` and ``text`` are read, so further columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, free_names, freeing, hot_join, in_slices, lower_ascii, map_arrow, materialize
from .components import connected_components

#: Rows of one block value that a task joins at once; beyond it the value's rows are dealt into parts, joined two by two.
GROUP_ROWS = 4096
#: Rows that a task gathers before it joins the tries it holds.
TASK_ROWS = 60_000
#: Pairs of leaves compared at once.
SLAB = 2_000_000
#: Shingles and sets of one part of a group in the exact check.
PART_SHINGLES, PART_SETS = 200_000, 500
#: MinHash bands and the minima of each; their turns of a hash (xor, odd factor).
BANDS, BAND_ROWS = 40, 6
_TURNS = np.random.default_rng(7).integers(0, 2**64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_TURNS[1] |= np.uint64(1)


def shingle_hashes(text: str, words_each: int, words: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, ``words`` seeds from 42 on: an array [shingle, seed]."""
    tokens = WORDS.findall(lower_ascii(text))
    if not tokens:
        return np.zeros((0, words), np.uint64)
    data = [t.encode("utf-8", "surrogatepass") for t in tokens]
    if len(data) > words_each:
        columns = [data[i : len(data) - words_each + 1 + i] for i in range(words_each)]
        data = list(map(b" ".join, zip(*columns, strict=True)))
    else:
        data = [b" ".join(data)]
    hash64 = xxhash.xxh64_intdigest
    first = np.fromiter((hash64(x, 42) for x in data), np.uint64, len(data))
    if words == 1:
        return first[:, None]
    return np.stack([first, *(_mix(first, seed) for seed in range(1, words))], axis=1)


def _mix(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Another 64 bits from a 64-bit hash: the finishing steps of splitmix64 on hash + seed x golden ratio."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray) -> bytes:
    """A bit is 1 if it is set in over half of the hashes; big-endian bytes, 8 for each seed."""
    n, words = hashes.shape
    if not n:
        return b"\0" * (8 * words)
    counts = np.zeros(64 * words, np.int64)
    for start in range(0, n, 4096):
        part = np.ascontiguousarray(hashes[start : start + 4096]).astype(">u8").view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8 * words), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, bits): ``words`` x 64 bits of SimHash for each row."""

    def run(batches):
        for batch in in_slices(batches):
            yield {
                "doc_id": batch["doc_id"],
                "bits": [majority(shingle_hashes(t or "", shingle_words, words)) for t in batch["text"]],
            }

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, bits binary")


def _trie_pairs(bits: np.ndarray, starts: np.ndarray, budget: int):
    """Walk node pairs of the tries of sorted rows; yields (i, j) of rows within ``budget`` differing bits.

    ``bits`` [row, word] holds the rows in order within each trie, ``starts`` the first row of each trie and the end.
    A node is a range of rows that share a prefix; its children are found from a running count of the next bit.
    """
    depth, n = 64 * bits.shape[1], len(bits)
    low, high = starts[:-1], starts[1:]
    many = high - low > 1
    a0, a1 = low[many], high[many]
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), np.int32)
    for level in range(depth + 1):
        if not len(a0):
            return
        ready = (a1 - a0) * (b1 - b0) <= 64
        if level == depth:
            ready[:] = True
        if ready.any():
            yield from _leaf_pairs(bits, a0[ready], a1[ready], b0[ready], b1[ready], budget)
            a0, a1, b0, b1, err = (x[~ready] for x in (a0, a1, b0, b1, err))
            if not len(a0):
                return
        column = ((bits[:, level >> 6] >> np.uint64(63 - (level & 63))) & np.uint64(1)).astype(np.int64)
        ones = np.zeros(n + 1, np.int64)
        np.cumsum(column, out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        parts = [
            (a0, am, b0, bm, err, None),
            (am, a1, bm, b1, err, None),
            (a0, am, bm, b1, err + 1, None),
            (am, a1, b0, bm, err + 1, ~own),
        ]
        kept = []
        for x0, x1, y0, y1, e, only in parts:
            keep = (x0 < x1) & (y0 < y1) & (e <= budget) & ~((x0 == y0) & (x1 - x0 < 2))
            keep = keep if only is None else keep & only
            kept.append(tuple(v[keep] for v in (x0, x1, y0, y1, e)))
        a0, a1, b0, b1, err = (np.concatenate(v) for v in zip(*kept, strict=True))


def _leaf_pairs(bits, a0, a1, b0, b1, budget):
    sizes = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + SLAB, "right")))
        s = slice(at, stop)
        which = np.repeat(np.arange(stop - at), sizes[s])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes[s]) - sizes[s], sizes[s])
        width = (b1[s] - b0[s])[which]
        i, j = a0[s][which] + inner // width, b0[s][which] + inner % width
        keep = (i != j) & ((a0[s] != b0[s])[which] | (i < j))
        i, j = i[keep], j[keep]
        for word in range(bits.shape[1]):
            seen = np.bitwise_count(bits[i, word] ^ bits[j, word]).astype(np.int32)
            total = seen if word == 0 else total + seen
            near = total <= budget
            i, j, total = i[near], j[near], total[near]
        if len(i):
            yield i, j
        at = stop


def _forest(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Rows (child, smallest row of its component) of those that have a link."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            differ = x != y
            if not differ.any():
                break
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _join_tables(words: int, budget: int):
    def links(frames):
        held, rows = [], 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
        if not held:
            return
        frame = pd.concat(held, ignore_index=True)
        bits = np.frombuffer(b"".join(frame["bits"]), ">u8").astype(np.uint64).reshape(-1, words)
        keys = [frame[c].to_numpy() for c in ("part_b", "part_a", "block")]
        order = np.lexsort([*(bits[:, w] for w in reversed(range(words))), *keys])
        bits = bits[order]
        change = np.zeros(len(bits), bool)
        change[0] = True
        for k in keys:
            k = k[order]
            change[1:] |= k[1:] != k[:-1]
        starts = np.append(np.flatnonzero(change), len(bits))
        child, root = _forest(len(bits), _trie_pairs(bits, starts, budget))
        raw = frame["bits"].to_numpy()[order]
        yield pd.DataFrame({"a": raw[child], "b": raw[root]})

    return lambda frames: freeing(links(frames))


Blocks = tuple[tuple[int, int], ...]  # (first bit, bits) of each


def all_choices(n: int, width: int, budget: int) -> list[Blocks]:
    """Tables that lose no pair within ``budget`` bits: every choice of k of ``budget + k`` blocks, k the least for which
    ``n`` random fingerprints share the blocks with fewer than 1/8 others."""
    k = next((k for k in range(1, 7) if 8 * n <= 2 ** (width * k / (budget + k))), 7)
    cuts = [width * i // (budget + k) for i in range(budget + k + 1)]
    return list(itertools.combinations(((a, b - a) for a, b in itertools.pairwise(cuts)), k))


def even_blocks(n: int, width: int, tables: int, least: int) -> list[Blocks]:
    """``tables`` blocks dealt evenly over the fingerprint, overlapping where they must: of ``least`` bits, and of more where
    ``n`` random fingerprints would share a block with over 4 others."""
    bits = max(least, math.ceil(math.log2(max(n, 4) / 4)))
    return [(((width - bits) * t // max(1, tables - 1), bits),) for t in range(tables)]


def trie_links(nodes: DataFrame, words: int, budget: int, tables: list[Blocks]) -> DataFrame:
    """(a, b) of distinct fingerprints ``bits``: a spanning forest of those within ``budget`` bits that agree on all
    blocks of one of the ``tables``."""
    hexed = F.hex("bits")

    def block_of(offset: int, length: int) -> Column:
        first, last = offset // 4, math.ceil((offset + length) / 4)
        value = F.conv(F.substring(hexed, first + 1, last - first), 16, 10).cast("long")
        return F.shiftright(value, last * 4 - offset - length).bitwiseAND((1 << length) - 1)

    # a table and the value of its blocks, as one key
    blocks = F.array(*(F.xxhash64(F.lit(t), *(block_of(*b) for b in chosen)) for t, chosen in enumerate(tables)))
    rows = nodes.select("bits", F.explode(blocks).alias("block"))
    sizes = materialize(rows.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-blocks")
    parts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    sized = hot_join(rows, sizes, "block", "n", nodes.count() * len(tables)).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    sized = sized.withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("own")) | (F.col("parts") == 1))
    dealt = sized.select("block", "bits", "own", F.explode(others).alias("other")).select(
        "block", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "bits"
    )
    dealt = materialize(dealt, "simhash-tables")
    tasks = max(1, math.ceil(dealt.count() / TASK_ROWS))
    spread = dealt.repartition(tasks, "block", "part_a", "part_b")
    return spread.mapInPandas(_join_tables(words, budget), "a binary, b binary")


def _lowest(nodes: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, n, component_id) of ``nodes`` (key, low, n): the smallest ``low`` of each node's group."""
    named = nodes.join(groups.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    named = materialize(named.select(key, "low", "n", "root"), "near-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    return hot_join(named, lowest, "root", "members", named.count()).select(key, "n", "component_id")


def near_groups(docs: DataFrame, shingle_words: int = 3, words: int = 1, budget: int = 3) -> DataFrame:
    """(doc_id, bits, component_id) of every row; see the module's text."""
    marked = materialize(fingerprints(docs, shingle_words, words), "simhash")
    ids = materialize(marked.groupBy("bits").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-bits")
    links = trie_links(ids.select("bits"), words, budget, all_choices(ids.count(), 64 * words, budget))
    of_bits = _lowest(ids, connected_components(links), "bits")
    return hot_join(marked, of_bits, "bits", "n", marked.count()).select("doc_id", "bits", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract: 3-word shingles, 64 bits, links at 3 or fewer differing bits, found completely."""
    from .common import table

    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("bits")).alias("fingerprint"), "component_id")


def alike(sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """(i, j): a spanning forest of all pairs of sets of distinct hashes with a Jaccard similarity of ``share`` or more.

    Sets are reached from one another: each is held once against those of a fitting size that nothing has reached yet.
    """
    place = np.array(sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i])), np.int64)
    if len(place) < 2:
        return []
    sizes = np.array([len(sets[i]) for i in place], np.int64)
    _, flat = np.unique(np.concatenate([sets[i] for i in place]), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    mark, found = np.zeros(int(flat.max()) + 1, np.int32), []
    rows, row_sizes, starts = np.arange(len(place)), sizes, np.cumsum(sizes) - sizes
    open_, ahead = np.ones(len(place), bool), []
    while True:
        if not ahead:
            left = np.flatnonzero(open_[rows])
            if len(left) < 2:
                return [(int(place[i]), int(place[j])) for i, j in found]
            ahead.append(int(rows[left[0]]))
            open_[ahead[0]] = False
        if 2 * np.count_nonzero(open_[rows]) < len(rows):
            rows = rows[open_[rows]]
            if not len(rows):
                return [(int(place[i]), int(place[j])) for i, j in found]
            row_sizes, flat = sizes[rows], np.concatenate([own[r] for r in rows])
            starts = np.cumsum(row_sizes) - row_sizes
        i = ahead.pop()
        low = np.searchsorted(row_sizes, math.floor(sizes[i] * share), "left")
        high = np.searchsorted(row_sizes, math.ceil(sizes[i] / share), "right")
        if low == high:
            continue
        mark[own[i]] = 1
        both = np.add.reduceat(mark[flat[starts[low] : starts[high - 1] + row_sizes[high - 1]]], starts[low:high] - starts[low])
        mark[own[i]] = 0
        near = (both * (1 + share) >= share * (sizes[i] + row_sizes[low:high]) - 1e-9) & open_[rows[low:high]]
        for j in rows[low:high][near].tolist():
            found.append((i, j))
            ahead.append(j)
            open_[j] = False


def band_keys(shingles: np.ndarray) -> list[int]:
    """MinHash of a set of hashes: one key for each of ``BANDS`` bands of ``BAND_ROWS`` minima; none for an empty set.

    Two sets of Jaccard similarity s have an equal key in a band with probability s ** ``BAND_ROWS``.
    """
    if not len(shingles):
        return []
    low = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024]
        np.minimum(low, ((part[:, None] ^ _TURNS[0]) * _TURNS[1]).min(axis=0), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        keys = _mix(keys ^ column, 1)
    return keys.view(np.int64).tolist()


def band_links(nodes: DataFrame) -> DataFrame:
    """(a, b) of fingerprints ``bits`` whose ``bands`` have a key in common: each with the key's smallest."""
    rows = nodes.select(F.explode("bands").alias("band"), "bits")
    low = rows.groupBy("band").agg(F.min("bits").alias("b"), F.count("*").alias("n")).filter("n > 1")
    low = materialize(low, "near-bands")
    return hot_join(rows, low, "band", "n", nodes.count() * BANDS).filter("bits != b").select(F.col("bits").alias("a"), "b").distinct()


def _marked(docs: DataFrame, shingle_words: int, words: int) -> DataFrame:
    """(id, key, node, size, bits, bands): ``node`` stands for a set of shingles, ``id`` and ``key`` for a row's text."""

    def run(batches):
        for batch in in_slices(batches):
            nodes, sizes, bits, bands = [], [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text or "", shingle_words, words)
                shingles = np.unique(hashes[:, 0])
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sizes.append(len(shingles))
                bits.append(majority(hashes))
                bands.append(band_keys(shingles))
            yield {"id": batch["id"], "key": batch["key"], "node": nodes, "size": sizes, "bits": bits, "bands": bands}

    return map_arrow(_keyed(docs), run, "id long, key binary, node binary, size long, bits binary, bands array<long>")


def _id_of() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def _key_of() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_id_of().alias("id"), _key_of().alias("key"), "text")


def alike_across(sets: list[np.ndarray], few: list[bool], clusters: list, share: float):
    """(i, j) of sets of different clusters, i of the few and j of the others, whose Jaccard similarity is ``share`` or more; one j of each cluster."""
    rest = sorted((j for j, own in enumerate(few) if not own and len(sets[j])), key=lambda j: len(sets[j]))
    if not rest:
        return
    values, flat = np.unique(np.concatenate([sets[j] for j in rest]), return_inverse=True)
    sizes = np.array([len(sets[j]) for j in rest], np.int64)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(values) + 1, np.int32)
    for i in (i for i, own in enumerate(few) if own and len(sets[i])):
        n = len(sets[i])
        low, high = np.searchsorted(sizes, math.floor(n * share), "left"), np.searchsorted(sizes, math.ceil(n / share), "right")
        if low == high:
            continue
        at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
        at = at[values[at] == sets[i]]
        mark[at] = 1
        both = np.add.reduceat(mark[flat[starts[low] : starts[high - 1] + sizes[high - 1]]], starts[low:high] - starts[low])
        mark[at] = 0
        met = {clusters[i]}
        for k in np.flatnonzero(both * (1 + share) >= share * (n + sizes[low:high]) - 1e-9).tolist():
            j = rest[low + k]
            if clusters[j] not in met:
                met.add(clusters[j])
                yield i, j


def _dealt(rows: DataFrame, texts: DataFrame, by: list[str], columns: list[str], links, shingle_words: int) -> DataFrame:
    """``links(rows, sets)`` of each group of ``rows`` that are equal on ``by``, with the rows' shingle sets; a task holds one group at a time."""
    load = rows.agg(F.sum("size")).first()[0] or 0
    spread = rows.join(texts, ["id", "key"]).select(*by, *columns, "text")
    spread = spread.repartition(max(1, math.ceil(load / PART_SHINGLES / 4)), *by).sortWithinPartitions(*by)

    def found(held, sets):
        pairs = list(links(held, sets))
        return {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

    def run(batches):
        at, held, sets = None, [], []
        for batch in in_slices(batches):
            for *values, text in zip(*(batch[c] for c in (*by, *columns)), batch["text"], strict=True):
                key = values[: len(by)]
                if key != at:
                    yield found(held, sets)
                    at, held, sets = key, [], []
                held.append((key[0], *values[len(by) :]))
                sets.append(np.unique(shingle_hashes(text or "", shingle_words, 1)[:, 0]))
        yield found(held, sets)

    return map_arrow(spread, run, "a binary, b binary")


def _parts(rows: DataFrame, least: int = 2) -> DataFrame:
    """Adds ``parts``, how many parts of bounded size the rows of a ``root`` make, and the row's ``part``; roots with fewer than ``least`` rows go."""
    parts = F.greatest(F.ceil(F.sum("size") / PART_SHINGLES), F.ceil(F.count("*") / PART_SETS), F.lit(1)).cast("int")
    sizes = rows.groupBy("root").agg(parts.alias("parts"), F.count("*").alias("members")).filter(F.col("members") >= least)
    joined = hot_join(rows, sizes, "root", "members", rows.count())
    return joined.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("members")


def _checked_links(docs: DataFrame, named: DataFrame, shingle_words: int, share: float) -> DataFrame:
    """(a, b) of nodes that are alike by their exact shingle sets, as far as they have the same ``root`` in ``named``.

    A root's nodes are dealt into parts of bounded size. Every part is linked within itself; one node of each cluster so found goes on
    to the next level, which is dealt and linked in the same way, until a root fits in one part or hardly shrinks. A link not
    found by then joins two different clusters, so one of its ends lies outside the root's largest cluster: such nodes are held
    against all nodes of other clusters, part by part. A large group of near copies costs a few copies of its texts, not one for each part.
    """
    members = materialize(_parts(named.select("root", "node", "size", "id", "key")), "near-candidates")
    texts = _keyed(docs).select("id", "key", "text").join(members.select("id", "key"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    texts = materialize(texts, "near-texts")

    def within(rows, sets):
        found = alike(sets, share)
        reached = {j for _, j in found}
        yield from ((rows[i][1], rows[j][1]) for i, j in found)
        if rows and rows[0][2] > 1:  # the first node of each cluster, without a partner
            yield from ((row[1], None) for i, row in enumerate(rows) if i not in reached)

    links, level, n, before = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), members, members.count(), None
    while n and (before is None or n < 0.9 * before):
        found = materialize(_dealt(level, texts, ["root", "part"], ["node", "parts"], within, shingle_words), "near-links")
        links = links.unionByName(found.filter("b is not null"))
        ahead = found.filter("b is null").select(F.col("a").alias("node"))
        level = materialize(_parts(level.drop("parts", "part").join(ahead, "node")), "near-level")
        before, n = n, level.count()
    large = members.filter("parts > 1")
    return links if large.isEmpty() else links.unionByName(_links_across(large, texts, links, shingle_words, share))


def _links_across(members: DataFrame, texts: DataFrame, links: DataFrame, shingle_words: int, share: float) -> DataFrame:
    """(a, b) of alike nodes of one root that ``links`` leaves in different clusters."""
    clusters = connected_components(links).withColumnRenamed("root", "cluster")
    rows = materialize(members.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "near-clusters")
    sizes = rows.groupBy("root", "cluster").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("n", "cluster")).getField("cluster").alias("largest"), F.sum("n").alias("members"))
    outside = hot_join(rows, largest, "root", "members", rows.count()).filter("cluster != largest")
    few = _parts(outside.select("root", "node", "size", "id", "key", "cluster", F.col("parts").alias("all_parts")), 1)
    few = materialize(few.withColumnsRenamed({"part": "few_part", "parts": "few_parts"}), "near-outside")
    in_roots = few.groupBy("root").agg(F.first("few_parts").alias("few_parts"))
    in_roots = in_roots.join(rows.groupBy("root").agg(F.count("*").alias("members")), "root")
    every = hot_join(rows, in_roots, "root", "members", rows.count())
    columns = ["root", "few_part", "part", "size", "id", "key", "node", "cluster", "few"]
    one = few.select("*", F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("part"), F.lit(True).alias("few")).select(columns)
    other = every.select("*", F.explode(F.sequence(F.lit(0), F.col("few_parts") - 1)).alias("few_part"), F.lit(False).alias("few")).select(columns)

    def across(rows, sets):
        for i, j in alike_across(sets, [r[3] for r in rows], [r[2] for r in rows], share):
            yield rows[i][1], rows[j][1]

    return materialize(_dealt(one.unionByName(other), texts, ["root", "few_part", "part"], ["node", "cluster", "few"], across, shingle_words), "near-across")


def kept_keys(docs: DataFrame, shingle_words: int, words: int, budget: int, least_bits: int, tables: int, share: float) -> DataFrame:
    """(id, key, many): of every group of near copies the smallest id and text hash, and whether several rows have both.

    Groups are rows linked by exact Jaccard similarities of ``share`` or more. Fingerprints and bands only say which nodes may be
    alike; their groups are then checked and built anew from what holds. A null id counts as the largest.
    """
    marked = materialize(_marked(docs, shingle_words, words), "near-sets")
    nodes = marked.groupBy("node").agg(F.max("size").alias("size"), F.min(F.struct("id", "key", "bits", "bands")).alias("first"))
    nodes = materialize(nodes.select("node", "size", "first.bits", "first.id", "first.key", "first.bands"), "near-nodes")
    distinct = nodes.select("bits").distinct()
    candidates = trie_links(distinct, words, budget, even_blocks(nodes.count(), 64 * words, tables, least_bits)).unionByName(band_links(nodes))
    groups = connected_components(candidates).withColumnRenamed("node", "bits")
    named = materialize(nodes.drop("bands").join(groups, "bits", "left").withColumn("root", F.coalesce("root", "bits")).drop("bits"), "near-named")
    groups = connected_components(_checked_links(docs, named, shingle_words, share))
    rooted = nodes.select("node", F.struct("id", "key").alias("first")).join(groups, "node", "left")
    first = rooted.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select("first.id", "first.key")
    several = marked.groupBy("id", "key").agg(F.count("*").alias("n")).filter("n > 1").select("id", "key", F.lit(True).alias("many"))
    return first.join(several, ["id", "key"], "left").select("id", "key", F.coalesce("many", F.lit(False)).alias("many"))


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, words: int = 4, budget: int = 46, least_bits: int = 14, tables: int = 32, share: float = 0.8) -> DataFrame:
    """Keep the row with the smallest id of every group of near copies; columns stay as they are.

    Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, worked out exactly;
    groups are what such pairs link. Which pairs are looked at is found in two ways. 256-bit fingerprints: at 0.8 (cosine 0.89) two
    differ in 39 bits on average, with a standard deviation of 6, and unrelated ones in 128; the budget of 46 bits keeps 9 of 10
    pairs at 0.8. A pair is compared where it agrees on one of 32 blocks; blocks have 14 bits, and more in tables of over 65,536 texts, so that
    unrelated texts seldom meet. MinHash bands find what blocks miss, at every size: 40 bands of six minima miss 5 in a million pairs at 0.8.

    A row without an id counts as the last of its group. Rows that share the kept id stay if they share the kept text, once.
    """
    keys = kept_keys(docs.select("doc_id", "text"), shingle_words, words, budget, least_bits, tables, share)
    id_, key_, many_ = free_names(docs, "id", "key", "many")
    rows = docs.withColumns({id_: _id_of(), key_: _key_of()})
    rows = rows.join(keys.select(F.col("id").alias(id_), F.col("key").alias(key_), F.col("many").alias(many_)), [id_, key_])
    kept = rows.filter(~F.col(many_)).unionByName(rows.filter(many_).dropDuplicates([id_, key_]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))

"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word of a text from the two words on either side of it: embeddings of the four
neighbours (one table for each place) are summed up, go through tanh, and a two-level softmax (class of 64 words, then
word within the class) gives the word's probability. The sum of the conditional log-probabilities over
all words is the text's score.

Vocabulary: word counts over all documents; the most frequent ``N_WORDS`` have ids of their own, the others share
``N_ENDINGS`` ids by their last two letters. A word without an id of its own is charged for its class by the network and for
the word within the class by its spelling: a model of bytes from the last to the first, counted over all such words. Training: the documents are dealt by hash to shards of about ``SHARD_WORDS`` words, whose number
depends on the corpus alone. Each shard trains in order of that hash, from the same start, in numpy, and the parameters are averaged by
trained words, ``ROUNDS`` times; averages are taken in two steps of bounded groups. Round r trains on words r, r + ``STRIDE``, ...
of each text (shifted by its id): with as many rounds as strides every word of every document is trained on once. Copies of a document are one with a
weight. Tasks, files and partitions don't change a score.

Nulls: a null text is an empty one; texts without words have score 0 and no mean. A null ``doc_id`` is passed on.
Repeated rows each give a row. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, map_arrow, materialize, numbered, table

CLASS, CLASSES, WIDTH = 64, 64, 24
SIZE = CLASS * CLASSES
N_ENDINGS = 511
N_WORDS = SIZE - N_ENDINGS - 1
OFFSETS = (-2, -1, 1, 2)
STRIDE, ROUNDS, BATCH = 2, 2, 4096
#: Words that a shard trains on, about, and those that are shuffled together and fitted at a time.
SHARD_WORDS, FITTED_WORDS = 2_000_000, 524_288
#: Runs of three bytes that the spelling keeps; of rarer ones only the last two bytes count.
SPELLED_RUNS = 1 << 20
TOKENS = re.compile(r"\w+")
#: Characters of texts that are split together.
SLICE_CHARS = 4_000_000
#: Words whose ids a task keeps.
HELD_WORDS = 200_000


def distinct_tokens(texts: list[str | None]) -> tuple[list[str], np.ndarray, list[int]]:
    """(distinct words, number of each word in turn, first word of each text and the end)."""
    return numbered([TOKENS.findall((t or "").lower()) for t in texts])


def tokenized(docs: DataFrame) -> DataFrame:
    """(words, counts, doc_ids, sizes, codes): a row for each slice of ``SLICE_CHARS`` characters, its texts as numbers of its own
    distinct words. Texts are split once; all else reads this."""

    def run(batches):
        for batch in in_slices(batches, chars=SLICE_CHARS):
            words, codes, ends = distinct_tokens(batch["text"])
            yield {"words": [words], "counts": [np.bincount(codes, minlength=len(words))], "doc_ids": [batch["doc_id"]], "sizes": [np.diff(ends)], "codes": [codes.astype("<i4").tobytes()]}

    schema = "words array<string>, counts array<long>, doc_ids array<long>, sizes array<int>, codes binary"
    return materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema), "lm-tokens")


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word, n) over all documents."""
    pairs = tokens.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    return pairs.groupBy("word").agg(F.sum("n").alias("n"))


def ending_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % N_ENDINGS


def spelled(word: str) -> bytes:
    """The bytes of a word from the last to the first, between two zeros and one."""
    return b"\0\0" + word.encode("utf-8", "surrogatepass")[::-1] + b"\0"


def spelling_counts(counts: DataFrame, own: set[str]) -> DataFrame:
    """(code, n) over the words that aren't in ``own``: three bytes in a row, or 2**24 + the ending."""
    shared = counts.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        known, seen = shared.value, Counter()
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"], strict=True):
                if word not in known:
                    data = spelled(word)
                    for i in range(len(data) - 2):
                        seen[data[i] << 16 | data[i + 1] << 8 | data[i + 2]] += n
                    seen[(1 << 24) + ending_of(word)] += n
        yield {"code": list(seen), "n": list(seen.values())}

    return map_arrow(counts, run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def bounded_spelling(codes: DataFrame) -> DataFrame:
    """The ``SPELLED_RUNS`` most frequent runs; the rest, with a byte that no text has in place of the first, 65,536 at most; and the endings."""
    runs = codes.filter(F.col("code") < 1 << 24)
    often = runs.orderBy(F.col("n").desc(), "code").limit(SPELLED_RUNS)
    seldom = runs.join(often.select("code"), "code", "left_anti").groupBy((F.col("code").bitwiseAND(0xFFFF) + (0xFF << 16)).alias("code")).agg(F.sum("n").alias("n"))
    return often.unionByName(seldom).unionByName(codes.filter(F.col("code") >= 1 << 24))


class Spelling:
    """log p(word | its ending's class), from ``spelling_counts``: three bytes, then two, then one, then any byte."""

    def __init__(self, counts: dict[int, int]):
        self.levels = [(Counter(), Counter()) for _ in range(3)]
        self.endings = Counter()
        for code, n in counts.items():
            if code >= 1 << 24:
                self.endings[code - (1 << 24)] += n
                continue
            for (seen, before), mask in zip(self.levels, (0xFF, 0xFFFF, 0xFFFFFF), strict=True):
                seen[code & mask] += n
                before[(code & mask) >> 8] += n
        self.total = sum(self.endings.values())
        self.logs: dict[int, float] = {}

    def _log(self, code: int) -> float:
        p = 1 / 256
        for (seen, before), mask in zip(self.levels, (0xFF, 0xFFFF, 0xFFFFFF), strict=True):
            part = code & mask
            p = (seen.get(part, 0) + 4 * p) / (before.get(part >> 8, 0) + 4)
        self.logs[code] = found = math.log(p)  # at most 2**24 of them
        return found

    def log_prob(self, word: str) -> float:
        return float(self.log_probs([word])[0])

    def log_probs(self, words: list[str]) -> np.ndarray:
        """log p of each word; each run of three bytes is looked up once."""
        if not words:
            return np.zeros(0)
        data = np.frombuffer(b"".join(map(spelled, words)), np.uint8).astype(np.int32)
        sizes = np.fromiter((len(w.encode("utf-8", "surrogatepass")) + 1 for w in words), np.int64, len(words))  # runs of a word
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(len(words)), sizes)  # a word has two more bytes than runs
        codes, which = np.unique(data[at] << 16 | data[at + 1] << 8 | data[at + 2], return_inverse=True)
        logs = self.logs
        each = np.fromiter((logs[c] if c in logs else self._log(c) for c in codes.tolist()), float, len(codes))
        total = np.add.reduceat(each[which], first)
        share = np.fromiter(((self.endings.get(ending_of(w), 0) + 0.5) for w in words), float, len(words)) / (self.total + 0.5 * N_ENDINGS)
        return np.minimum(0.0, total - np.log(share))


class Vocabulary(dict):
    """Word -> id; 0 is the space outside a text. Words without an id of their own go by their ending and spelling."""

    def __init__(self, words: list[str], spelling: Spelling | None = None):
        super().__init__((w, i + 1) for i, w in enumerate(words[:N_WORDS]))
        self.spelling = spelling or Spelling({})

    def __missing__(self, word: str) -> int:
        found = 1 + N_WORDS + ending_of(word)
        if len(self) < HELD_WORDS:
            self[word] = found
        return found

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, and log p(word | class) of those without an id of their own (0 of the others)."""
        ids = np.fromiter(map(self.__getitem__, words), "<u2", len(words))
        spelt, unknown = np.zeros(len(words)), np.flatnonzero(ids > N_WORDS)
        spelt[unknown] = self.spelling.log_probs([words[i] for i in unknown.tolist()])
        return ids, spelt


def encode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, within): the words' ids of every document as 16-bit numbers, and what spelling adds to its score;
    written once and read by all later passes. Each distinct word of a slice is looked up once."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            for words, doc_ids, sizes, codes in zip(batch["words"], batch["doc_ids"], batch["sizes"], batch["codes"], strict=True):
                ids, spelt = known.coded(words)
                codes = np.frombuffer(codes, "<i4")
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                upto = np.concatenate([[0.0], np.cumsum(spelt[codes])])
                within = (upto[ends[1:]] - upto[ends[:-1]]).tolist()
                coded, ends = ids[codes], ends.tolist()
                yield {"doc_id": doc_ids, "ids": [coded[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], "within": within}

    return materialize(map_arrow(tokens.select("words", "doc_ids", "sizes", "codes"), run, "doc_id long, ids binary, within double"), "lm-ids")


class Network:
    """Embeddings by place, class and word outputs, in one flat float32 vector."""

    SHAPES = {"e": (len(OFFSETS), SIZE, WIDTH), "c": (CLASSES, WIDTH), "cb": (CLASSES,), "w": (CLASSES, CLASS, WIDTH), "wb": (CLASSES, CLASS)}
    LENGTH = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> Network:
        """Small random embeddings; biases from the words' counts."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.LENGTH, np.float32))
        net.e[:] = rng.normal(0, 0.1, net.e.shape)
        net.c[:] = rng.normal(0, 0.1, net.c.shape)
        net.w[:] = rng.normal(0, 0.1, net.w.shape)
        table_ = (counts + 0.5).reshape(CLASSES, CLASS)
        net.cb[:] = np.log(table_.sum(1) / table_.sum())
        net.wb[:] = np.log(table_ / table_.sum(1, keepdims=True))
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.e[0].take(around[0], 0)
        for k in range(1, len(OFFSETS)):
            h += self.e[k].take(around[k], 0)
        return np.tanh(h, out=h)

    def within(self, h: np.ndarray, bounds: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Outputs of each row's own class, for rows ordered by class."""
        z = np.empty((len(h), CLASS), np.float32)
        for k in seen.tolist():
            s = slice(bounds[k], bounds[k + 1])
            np.matmul(h[s], self.w[k].T, out=z[s])
            z[s] += self.wb[k]
        return z

    def log_probs(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        out = np.empty(len(target), np.float32)
        for start in range(0, len(target), SCORED):
            order, kind, word, bounds = _by_class(target[start : start + SCORED])
            h = self.hidden(around[:, start : start + SCORED][:, order])
            found = _log_softmax_at(h @ self.c.T + self.cb, kind)
            found += _log_softmax_at(self.within(h, bounds, np.flatnonzero(np.diff(bounds))), word)
            out[start + order] = found
        return out

    def train(self, target: np.ndarray, around: np.ndarray, squares: Network, rate: float = 0.08, weight: np.ndarray | None = None) -> None:
        """One AdaGrad step on a batch, of words with equal weights unless they are given."""
        order, kind, word, bounds = _by_class(target)
        around, rows = around[:, order], np.arange(len(target))
        share = np.full(len(target), 1 / len(target), np.float32) if weight is None else (weight[order] / weight.sum()).astype(np.float32)
        h = self.hidden(around)
        p = _pull(h @ self.c.T + self.cb, rows, kind, share)
        dh = p @ self.c
        seen = np.flatnonzero(np.diff(bounds))
        gw, back = np.empty((len(seen), CLASS, WIDTH), np.float32), np.empty_like(dh)
        gc, gcb = p.T @ h, p.sum(0)
        p = _pull(self.within(h, bounds, seen), rows, word, share)
        gb = np.add.reduceat(p, bounds[seen], axis=0)
        for i, k in enumerate(seen.tolist()):
            s = slice(bounds[k], bounds[k + 1])
            np.matmul(p[s].T, h[s], out=gw[i])
            np.matmul(p[s], self.w[k], out=back[s])
        dh += back
        dh *= 1 - h * h
        every = slice(None)
        for name, at, g in (("c", every, gc), ("cb", every, gcb), ("w", seen, gw), ("wb", seen, gb)):
            _step(getattr(self, name), getattr(squares, name), at, g, rate)
        for k in range(len(OFFSETS)):
            near = around[k].astype(np.uint16)
            by_id = np.argsort(near, kind="stable")
            near = near.take(by_id)
            first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1], [True]]))
            upto = np.zeros((len(near) + 1, WIDTH))
            np.cumsum(dh.take(by_id, 0), axis=0, out=upto[1:])
            upto = upto.take(first, 0)
            _step(self.e[k], squares.e[k], near[first[:-1]], (upto[1:] - upto[:-1]).astype(np.float32), rate)


#: Words scored at a time.
SCORED = 16_384


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by class, classes and words within them in that order, first place of each class and the end)."""
    order = np.argsort((target >> 6).astype(np.uint8), kind="stable")
    ordered = target[order]
    kind = ordered >> 6
    return order, kind, ordered & 63, np.searchsorted(kind, np.arange(CLASSES + 1))


_ONES = {n: np.ones(n, np.float32) for n in {CLASS, CLASSES}}


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exp(z - top), its row sums, top). ``top`` is 0 unless a row would leave the range of 32-bit numbers."""
    with np.errstate(over="ignore"):
        p = np.exp(z)
        sums = p @ _ONES[z.shape[1]]
    if np.isfinite(sums).all() and sums.all():
        return p, sums, 0.0
    top = z.max(1)
    p = np.exp(z - top[:, None])
    return p, p @ _ONES[z.shape[1]], top


def _log_softmax_at(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    """log softmax of each row at its column."""
    _, sums, top = _exp(z)
    return z[np.arange(len(z)), column] - top - np.log(sums)


def _pull(z: np.ndarray, rows: np.ndarray, column: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Gradient of the rows' shares of the log loss."""
    p, sums, _ = _exp(z)
    p *= (share / sums)[:, None]
    p[rows, column] -= share
    return p


def _step(values: np.ndarray, squares: np.ndarray, at, g: np.ndarray, rate: float) -> None:
    s = squares[at] + g * g
    squares[at] = s
    values[at] -= rate * g / np.sqrt(s + 1e-8)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, neighbours by place, words of each text) of all texts' words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = np.zeros(2, np.int32)
    flat = np.concatenate([gap, *(x for t in texts for x in (t, gap))]).astype(np.int32)
    first = np.repeat(2 + np.cumsum(sizes + 2) - sizes - 2, sizes)
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[at], np.stack([flat[at + o] for o in OFFSETS]), sizes


def in_shards(encoded: DataFrame, shards: int) -> DataFrame:
    """(shard, place, doc_id, ids, n): copies combined within each task before the shuffle, one shard after the other in a partition."""

    def combined(batches):
        for batch in in_slices(batches, "ids", 4_000_000):
            seen = Counter(zip(batch["doc_id"], batch["ids"], strict=True))
            yield {"doc_id": [d for d, _ in seen], "ids": [i for _, i in seen], "n": list(seen.values())}

    rows = map_arrow(encoded.select("doc_id", "ids"), combined, "doc_id long, ids binary, n long").filter("length(ids) > 0")
    place = F.xxhash64("doc_id", "ids")
    rows = rows.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), "doc_id", "ids", "n")
    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "ids")


def _held(batches):
    """(shard, [(doc_id, ids, n)]) of about ``FITTED_WORDS`` chosen words each, whatever the batches; equal rows in a row are one."""
    shard, rows, size = None, [], 0
    for batch in batches:
        for at, doc_id, ids, n in zip(batch["shard"], batch["doc_id"], batch["ids"], batch["n"], strict=True):
            if rows and (at, doc_id, ids) == (shard, rows[-1][0], rows[-1][1]):
                rows[-1] = (doc_id, ids, rows[-1][2] + n)
                continue
            if rows and (at != shard or size >= 2 * STRIDE * FITTED_WORDS):
                yield shard, rows
                rows, size = [], 0
            shard, size = at, size + len(ids)
            rows.append((doc_id, ids, n))
    if rows:
        yield shard, rows


def _train_round(encoded: DataFrame, net: Network, turn: int, shards: int) -> Network:
    shared = encoded.sparkSession.sparkContext.broadcast(net.flat)
    blocks = 8
    size = math.ceil(Network.LENGTH / blocks)

    def parts(shard, own, seen):
        return {"block": list(range(blocks)), "task": [shard] * blocks, "n": [float(seen)] * blocks, "part": [own.flat[b * size : (b + 1) * size].astype("<f4").tobytes() for b in range(blocks)]}

    def run(batches):
        at, own, squares, seen = None, None, None, 0.0
        for shard, rows in _held(batches):
            if shard != at:
                if seen:
                    yield parts(at, own, seen)
                at, own, squares, seen = shard, Network(shared.value.copy()), Network(np.full(Network.LENGTH, 1e-4, np.float32)), 0.0
            target, around, sizes = windows([np.frombuffer(ids, "<u2") for _, ids, _ in rows])
            shift = np.repeat([zlib.crc32(str(d).encode()) % STRIDE for d, _, _ in rows], sizes)
            inside = np.arange(len(target)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            chosen = np.flatnonzero((inside + shift) % STRIDE == turn % STRIDE)
            weight = np.repeat([float(n) for *_, n in rows], sizes)[chosen]
            _fit(own, squares, target[chosen], around[:, chosen], weight)
            seen += weight.sum()
        if seen:
            yield parts(at, own, seen)

    schema = "block int, task int, n double, part binary"
    trained = materialize(map_arrow(in_shards(encoded, shards), run, schema), "lm-parts")
    n_tasks = trained.count() // blocks
    if not n_tasks:
        return net

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")
        total, weights = np.zeros(len(frame["part"].iloc[0]) // 4), frame["n"].sum()
        for part, n in zip(frame["part"], frame["n"], strict=True):
            total += np.frombuffer(part, "<f4") * (n / weights)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "task": [frame["task"].iloc[0]], "n": [weights], "part": [total.astype("<f4").tobytes()]})

    step = max(1, math.isqrt(n_tasks))
    some = trained.groupBy("block", (F.col("task") % step).alias("lot")).applyInPandas(average, schema)
    whole = some.groupBy("block").applyInPandas(average, schema).orderBy("block").collect()  # the network once
    return Network(np.concatenate([np.frombuffer(r["part"], "<f4") for r in whole]).astype(np.float32))


def _fit(net: Network, squares: Network, target: np.ndarray, around: np.ndarray, weight: np.ndarray) -> None:
    order = np.random.default_rng(len(target)).permutation(len(target))
    for start in range(0, len(order), BATCH):
        own = order[start : start + BATCH]
        net.train(target[own], around[:, own], squares, weight=weight[own])


def learn_vocabulary(tokens: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the counts of its ids, from counts over all documents."""
    counts = materialize(word_counts(tokens), "lm-words")
    top = counts.orderBy(F.col("n").desc(), "word").limit(N_WORDS).collect()  # the vocabulary's size is a parameter
    start = np.zeros(SIZE)
    start[1 : len(top) + 1] = [r["n"] for r in top]
    rest = counts.agg(F.sum("n")).first()[0] or 0
    start[1 + N_WORDS :] = max(0, rest - start.sum()) / N_ENDINGS
    words = [r["word"] for r in top]
    spelling = bounded_spelling(materialize(spelling_counts(counts, set(words)), "lm-spelling")).collect()
    return Vocabulary(words, Spelling({r["code"]: r["n"] for r in spelling})), start


def train(encoded: DataFrame, counts: np.ndarray) -> Network:
    """``counts`` of all ids tell how many words there are, hence the number of shards."""
    shards = max(4, math.ceil(counts.sum() / SHARD_WORDS))
    net = Network.start(counts)
    for turn in range(ROUNDS):
        net = _train_round(encoded, net, turn, shards)
    return net


def score(encoded: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob of encoded documents."""
    shared = encoded.sparkSession.sparkContext.broadcast(net.flat)

    def run(batches):
        own = Network(shared.value)
        for batch in in_slices(batches, "ids", 32_000):
            target, around, sizes = windows([np.frombuffer(b, "<u2") for b in batch["ids"]])
            scores = own.log_probs(target, around).astype(np.float64) if len(target) else np.zeros(0)
            ends = np.concatenate([[0.0], np.cumsum(scores)])
            at = np.concatenate([[0], np.cumsum(sizes)])
            total = (ends[at[1:]] - ends[at[:-1]] + np.array(batch["within"])).tolist()
            n = sizes.tolist()
            yield {"doc_id": batch["doc_id"], "n_words": n, "log_prob": [t if k else 0.0 for t, k in zip(total, n, strict=True)], "mean_log_prob": [t / k if k else None for t, k in zip(total, n, strict=True)]}

    return map_arrow(encoded, run, "doc_id long, n_words long, log_prob double, mean_log_prob double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob of every row, by a network trained on them; see the module's text."""
    tokens = tokenized(docs)
    vocabulary, counts = learn_vocabulary(tokens)
    encoded = encode(tokens, vocabulary)
    return score(encoded, train(encoded, counts))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))

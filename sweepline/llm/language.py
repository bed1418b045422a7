"""Language identification of mixed texts: script ranges, word scores and Viterbi.

A word's letters fall into script ranges, and a script that a language's training texts hardly use rules that
language out for the word. Among the others a word scores by its letter trigrams (word ends marked) under each
language. Viterbi over the words of a text, with a penalty for switching, labels spans; a text's language is the
one whose spans hold most letters. Trigram counts come from a bounded sample of training ids (``SAMPLE_ROWS``), with one text for each id.

Nulls: a null text, or one without a letter, is ``und`` with score 0; a null ``lang`` isn't learned; a null
``doc_id`` is never held out nor learned from. Repeated rows each give a row; ties go to the language first in
alphabetical order. Only ``doc_id``, ``text`` and, for learning, ``lang`` are read. With nothing learned every text is ``und``.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, is_held_out, map_arrow, table

#: Training ids that the model is fitted on at most, with one text each.
SAMPLE_ROWS = 12_000
#: Trigrams are hashed to so many slots.
SLOTS = 1 << 16
SWITCH = 12.0
#: A run of word characters but decimal digits and ``_``: letters, and seldom other numerals such as ½, ² and Ⅷ.
_WORDS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters (Unicode category L) of the lower-cased text."""
    words = _WORDS.findall(text.lower())
    if not words or "".join(words).isalpha():
        return words
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


# Code point ranges of scripts.
SCRIPTS = {
    "latin": (0x0041, 0x024F),
    "greek": (0x0370, 0x03FF),
    "cyrillic": (0x0400, 0x052F),
    "armenian": (0x0530, 0x058F),
    "hebrew": (0x0590, 0x05FF),
    "arabic": (0x0600, 0x06FF),
    "devanagari": (0x0900, 0x097F),
    "thai": (0x0E00, 0x0E7F),
    "hangul": (0xAC00, 0xD7AF),
    "kana": (0x3040, 0x30FF),
    "han": (0x4E00, 0x9FFF),
}
_ENDS = np.array([hi for _, hi in sorted(SCRIPTS.values())])
_STARTS = np.array([lo for lo, _ in sorted(SCRIPTS.values())])
OTHER = len(SCRIPTS)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Number of each code point's script range, ``OTHER`` outside of them."""
    at = np.searchsorted(_ENDS, codes)
    inside = (at < len(_ENDS)) & (codes >= _STARTS[np.minimum(at, len(_STARTS) - 1)])
    return np.where(inside, at, OTHER)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, first slot of each word, script of each word's first letter) of lower-cased words."""
    codes = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    blanks = np.flatnonzero(codes == 32)
    with np.errstate(over="ignore"):
        mixed = (codes[:-2] * 0x9E3779B1 ^ codes[1:-1] * 0x85EBCA77 ^ codes[2:] * 0xC2B2AE3D) * 0x27D4EB2F
    slots = (mixed >> 13) & (SLOTS - 1)
    middle = codes[1:-1] != 32  # a trigram for each letter, around it
    firsts = np.concatenate([[0], np.cumsum(np.diff(blanks) - 1)[:-1]]).astype(np.int64)
    return slots[middle], firsts, scripts_of(codes[blanks[:-1] + 1])


@dataclass
class LanguageModel:
    languages: list[str]
    trigram_scores: np.ndarray  # [slot, language]
    allowed: np.ndarray  # [script, language]
    kept_words: int = 300_000
    known: dict[str, int] = field(default_factory=dict)
    table: list[np.ndarray] = field(default_factory=list)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: mean-free log-likelihoods, -1e9 where the script rules a language out, 0 where it rules out all."""
        slots, firsts, scripts = trigrams(words)
        scores = np.add.reduceat(self.trigram_scores[slots], firsts)
        ok = self.allowed[scripts]
        scores = np.where(ok, scores, -1e9)
        scores[~ok.any(1)] = 0.0
        return scores

    def label(self, texts: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
        """Words and their languages' numbers, text by text."""
        split = [letter_words(t) for t in texts]
        if len(self.known) > self.kept_words:
            self.known, self.table = {}, []
        known = self.known
        fresh = sorted({w for words in split for w in words} - known.keys())
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.table.append(self.word_scores(fresh))
        table_ = np.concatenate(self.table) if len(self.table) > 1 else (self.table[0] if self.table else np.zeros((0, len(self.languages))))
        self.table = [table_]
        ids = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in split]
        return split, viterbi(ids, table_, SWITCH)


def viterbi(ids: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """Best label of every word, all texts abreast: step t handles word t of each text that has one."""
    order = sorted(range(len(ids)), key=lambda k: -len(ids[k]))
    lengths = np.array([len(ids[k]) for k in order])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
    n_states, steps = scores.shape[1], int(lengths[0]) if len(lengths) else 0
    if not n_states or not steps:
        return out
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than t
    flat = np.zeros((int(lengths.sum()),), np.int64)
    starts = np.concatenate([[0], np.cumsum(alive)])
    for column, k in enumerate(order):
        flat[starts[: lengths[column]] + column] = ids[k]
    number = np.min_scalar_type(n_states)
    back = np.zeros((len(flat), n_states), number)
    state = np.zeros((len(ids), n_states))
    states = np.arange(n_states)
    for t in range(steps):
        n, a = alive[t], starts[t]
        s = state[:n]
        if t:
            best = s.argmax(1)
            top = s[np.arange(n), best] - switch
            stay = s >= top[:, None]
            back[a : a + n] = np.where(stay, states, best[:, None])
            s = np.where(stay, s, top[:, None])
        s = s + scores[flat[a : a + n]]
        state[:n] = s - s.max(1, keepdims=True)
    label = np.zeros(len(flat), number)
    now = state.argmax(1)
    for t in range(steps - 1, -1, -1):
        n, a = alive[t], starts[t]
        label[a : a + n] = now[:n]
        now[:n] = back[a + np.arange(n), now[:n]]
    for column, k in enumerate(order):
        out[k] = label[starts[: lengths[column]] + column].astype(np.int64)
    return out


def model_of(languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> LanguageModel:
    """From trigram and script counts [.., language]: add-one frequencies; scripts with at least 2 % of a language's words."""
    scores = np.log((counts + 1) / (counts + 1).sum(0))
    centred = scores - scores.mean(1, keepdims=True) if languages else scores
    return LanguageModel(languages, centred, scripts >= 0.02 * np.maximum(1, scripts.sum(0)))


def train(docs: DataFrame) -> LanguageModel:
    """Fit on at most SAMPLE_ROWS ids, chosen by a hash of the id, and one text of each, in bounded parts a task."""
    usable = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).filter("doc_id is not null and lang is not null and text is not null")
    ids = usable.filter(~is_held_out()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = usable.join(F.broadcast(ids), "doc_id")  # at most SAMPLE_ROWS ids of 8 bytes
    one = F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang"))  # combined before the shuffle: an id repeated counts once
    rows = rows.groupBy("doc_id").agg(one.alias("row")).select("row.*")

    def run(batches):
        slots, scripts = {}, {}
        for batch in in_slices(batches):
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                words = letter_words(text)
                if words:
                    s, _, of = trigrams(words)
                    slots[lang] = slots.get(lang, 0) + np.bincount(s, minlength=SLOTS)
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(of, minlength=OTHER + 1)
        for lang in slots:
            at = np.flatnonzero(slots[lang])
            of = np.flatnonzero(scripts[lang])
            yield {"lang": [lang] * (len(at) + len(of)), "slot": [*at.tolist(), *(-1 - of).tolist()], "n": [*slots[lang][at].tolist(), *scripts[lang][of].tolist()]}

    summed = map_arrow(rows, run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # at most SLOTS rows for each learned language
    languages = sorted(found["lang"].unique())
    counts, scripts = np.zeros((SLOTS, len(languages))), np.zeros((OTHER + 1, len(languages)))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        slot, n = own["slot"].to_numpy(), own["n"].to_numpy()
        counts[slot[slot >= 0], k] += n[slot >= 0]
        scripts[-1 - slot[slot < 0], k] += n[slot < 0]
    return model_of(languages, counts, scripts)


def language_spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, spans): spans of one language each, with their first word, words and letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in in_slices(batches, chars=4_000_000):
            words, labels = shared.value.label([t or "" for t in batch["text"]])
            yield {"doc_id": batch["doc_id"], "spans": [spans(w, x, shared.value.languages) for w, x in zip(words, labels, strict=True)]}

    schema = "doc_id long, spans array<struct<lang: string, first_word: long, n_words: long, n_letters: long>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def spans(words: list[str], labels: np.ndarray, languages: list[str]) -> list[dict]:
    if not len(labels):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]]).tolist()
    return [{"lang": languages[labels[a]], "first_word": a, "n_words": b - a, "n_letters": sum(map(len, words[a:b]))} for a, b in zip(cuts, cuts[1:], strict=False)]


def language_id(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of letters in that language's spans), n_spans."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        value = shared.value
        for batch in in_slices(batches, chars=4_000_000):
            out: dict[str, list] = {"lang_pred": [], "score": [], "n_spans": []}
            for words, labels in zip(*value.label([t or "" for t in batch["text"]]), strict=True):
                if not words or not value.languages:
                    row = ("und", 0.0, 0)
                else:
                    letters = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words)), len(value.languages))
                    top = int(letters.argmax())
                    row = (value.languages[top], float(letters[top] / letters.sum()), int((np.diff(labels) != 0).sum()) + 1)
                for key, v in zip(out, row, strict=True):
                    out[key].append(v)
            yield {"doc_id": batch["doc_id"], **out}

    found = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, n_spans long")
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def op8_language(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))

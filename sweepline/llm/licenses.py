"""License scans by a positional index of rare words.

Templates are licence texts and notices as word sequences. The index holds, for each template, the postings
(word -> template, position) of its words of highest inverse document frequency; frequencies are counted over
all documents. A document looks up those of its words that the index has, rarest first. A posting and the word's
place give the place where the template would start, and the starts of a template's postings are intersected: short
wording needs all its postings at one start, longer wording those of two different words within three places.
Where they agree the template is aligned, word by word, and counts if enough of their words stand at their relative positions and every mandatory key
phrase stands inside. A phrase of the base list is a template that is mandatory as a whole, so its places are exact.

Nulls: a null text is an empty one (no words, no labels, score 0); a null ``doc_id`` is passed on. Repeated rows
each give a row. Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, lower_ascii, map_arrow, table

LICENSE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False
    words: tuple[str, ...] = field(init=False, default=())
    phrases: tuple[tuple[str, ...], ...] = field(init=False, default=())

    def __post_init__(self):
        split = lambda t: tuple(LICENSE_WORDS.findall(lower_ascii(t)))
        object.__setattr__(self, "words", split(self.text))
        object.__setattr__(self, "phrases", tuple(split(k) for k in self.keys or (self.text,)))


def _short(t: Template) -> bool:
    """Wording that counts only as a whole."""
    return t.base or len(t.words) <= 6


# The base list of phrases and labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

# Wording of well-known licences, with the phrases that must be there.
KNOWN = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "Apache License Version 2.0"),
    Template("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2 of the license")),
    Template("gpl-2.0", "GNU General Public License version 2"),
    Template("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3 of the license")),
    Template("gpl-3.0", "GNU General Public License version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("cc-by-nc", "CC BY NC"),
    Template("cc-by-sa", "CC BY SA"),
    Template("cc-by-nd", "CC BY ND"),
    Template("cc-by", "licensed under a Creative Commons Attribution License", ("creative commons attribution",)),
    Template("cc0", "Creative Commons Zero"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("epl", "Eclipse Public License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("bsl", "Boost Software License"),
    Template("all-rights-reserved", "All rights reserved"),
)


class Index:
    """Postings of every template's rarest words: two words of short wording, ``rare`` words of a longer one."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int], rare: int = 5, agree: int = 2, slack: int = 3, share: float = 0.7):
        self.templates, self.agree, self.slack, self.share = templates, agree, slack, share
        n = max(1, frequency.get("", 1))
        self.idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) for t in templates for w in t.words}
        self.rarest = [sorted(set(t.words), key=lambda w: (-self.idf[w], w))[: 2 if _short(t) else rare] for t in templates]
        self.postings: dict[str, list[tuple[int, list[int]]]] = defaultdict(list)
        for k, t in enumerate(templates):
            for w in self.rarest[k]:
                self.postings[w].append((k, [at for at, other in enumerate(t.words) if other == w]))

    def starts(self, words: list[str]) -> dict[int, set[int]]:
        """Places where a template may start: its postings there agree.

        Short wording: all of its postings, at the same start. Longer wording: postings of ``agree`` words or more
        (or all, if it has fewer), at starts that are at most ``slack`` words apart.
        """
        places: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                places[w].append(i)
        found: dict[int, list[set[int]]] = defaultdict(list)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for k, ats in self.postings[w]:
                sets = found[k]
                if _short(self.templates[k]):
                    if w != self.rarest[k][len(sets)] or sets and not sets[0]:
                        continue  # a rarer word of it is missing, or no start is left
                    own = {i - at for i in places[w] for at in ats}
                    found[k] = [own & sets[0] if sets else own, *sets]
                else:
                    sets.append({i - at for i in places[w] for at in ats})
        out = {}
        for k, sets in found.items():
            if _short(self.templates[k]):
                if len(sets) == len(self.rarest[k]) and sets[0]:
                    out[k] = sets[0]
                continue
            needed = min(self.agree, len(self.rarest[k]))
            if len(sets) < needed:
                continue
            reach = range(-self.slack, self.slack + 1)
            support = Counter(s for own in sets for s in {i + d for i in own for d in reach})
            agreed = {s for own in sets for s in own if support[s] >= needed}
            if agreed:
                out[k] = agreed
        return out

    def scan(self, words: list[str]) -> tuple[set[tuple[int, int]], dict[str, float]]:
        """Places (start, base template) and the best score by label."""
        places, scores = set(), {}
        for k, found in self.starts(words).items():
            t = self.templates[k]
            for start in found:
                score = self._aligned(t, words, start)
                if score:
                    scores[t.label] = max(score, scores.get(t.label, 0.0))
                    if t.base:
                        places.add((start, k))
        return places, scores

    def _aligned(self, t: Template, words: list[str], start: int) -> float:
        n = len(t.words)
        if _short(t):  # mandatory as a whole
            return 1.0 if start >= 0 and tuple(words[start : start + n]) == t.words else 0.0
        slack = self.slack
        first = max(0, start - slack)
        window = words[first : start + n + slack]
        same = sum(any(0 <= start + j + d - first < len(window) and window[start + j + d - first] == w for d in range(-slack, slack + 1)) for j, w in enumerate(t.words))
        if same < self.share * n:
            return 0.0
        for phrase in t.phrases:
            m = len(phrase)
            if not any(tuple(window[i : i + m]) == phrase for i in range(len(window) - m + 1)):
                return 0.0
        return same / n


def document_frequency(docs: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """Documents that have each licence word, over all documents; the key "" counts documents."""

    def run(batches):
        counts: Counter = Counter()
        for batch in in_slices(batches):
            for text in batch["text"]:
                counts.update(vocabulary.intersection(LICENSE_WORDS.findall(lower_ascii(text or ""))))
                counts[""] += 1
        yield {"word": list(counts), "n": list(counts.values())}

    found = map_arrow(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}  # at most a row for each licence word


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + KNOWN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; see the module's text."""
    vocabulary = frozenset(w for t in templates for w in t.words)
    index = Index(templates, document_frequency(docs, vocabulary))

    def run(batches):
        for batch in in_slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for text in batch["text"]:
                words = LICENSE_WORDS.findall(lower_ascii(text or ""))
                places, scores = index.scan(words)
                base = {templates[k].label for _, k in places}
                starts = [s for s, _ in places]
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | set(scores))))
                out["score"].append(max(scores.values(), default=0.0))
            yield {"doc_id": batch["doc_id"], **out}

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))

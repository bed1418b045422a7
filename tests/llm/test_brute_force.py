"""Operators against plain versions of what they compute."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sweepline.llm import components, decontaminate, language, licenses, lm_scoring, mixing, simhash, token_counts, token_files, toxicity, weighted_fingerprints
from sweepline.llm.common import lower_ascii

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def rows(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def test_licenses(documents, rows):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    got = {r.doc_id: r for r in licenses.license_scan(documents).collect()}
    hits = 0
    for doc_id, text in rows.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
        places, labels = [], set()
        for label, phrase in phrases.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
        hits += bool(places)
    assert hits > 0


def test_long_license_text_with_edits():
    text = licenses.KNOWN[0].text.lower()
    index = licenses.Index(licenses.BASE + licenses.KNOWN, {})
    words = licenses.LICENSE_WORDS.findall("before " * 30 + text)
    assert index.scan(words)[1]["mit"] == 1.0
    del words[40]
    assert 0.7 < index.scan(words)[1]["mit"] <= 1.0
    assert "mit" not in index.scan([w for w in words if w != "hereby"])[1]


def test_one_posting_is_no_start():
    """A start needs the postings of two words; text around the rarest word alone is not aligned."""
    index = licenses.Index(licenses.BASE + licenses.KNOWN, {})
    k = next(i for i, t in enumerate(index.templates) if t.label == "isc")
    template, (first, second, *_) = index.templates[k].words, index.rarest[k]
    a, b = template.index(first), template.index(second)
    words = ["x"] * 99
    words[20 + a] = first
    assert k not in index.starts(words)
    words[20 + b] = second
    assert {20} <= index.starts(words)[k]
    words[20 + b], words[21 + b] = "x", second  # moved by one word
    assert index.starts(words)[k] == {20, 21}
    words[21 + b], words[30 + b] = "x", second  # too far apart
    assert k not in index.starts(words)


def test_short_wording_needs_all_its_postings_at_one_start():
    index = licenses.Index(licenses.BASE + licenses.KNOWN, {})
    assert index.scan("cc x by cc".split())[0] == set()
    assert {s for s, _ in index.scan("by cc by x cc by".split())[0]} == {1, 4}
    assert "apache-2.0" in index.scan("apache license version 2 0 january 2004".split())[1]


def test_intersected_starts_hold_all_alignments(documents, rows):
    """Aligning every template at every place finds no label that the intersection of postings misses."""
    index = licenses.Index(licenses.BASE + licenses.KNOWN, {})
    for text in [*list(rows.values())[:60], " ".join(t.text for t in licenses.KNOWN)]:
        words = licenses.LICENSE_WORDS.findall(lower_ascii(text or ""))[:600]
        every = {t.label for t in index.templates for s in range(-3, len(words)) if index._aligned(t, words, s)}
        assert every == set(index.scan(words)[1])


def best_segmentation(word, pieces, byte_score):
    text = token_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + byte_score * n, best[end - 1][1] + n)]
        options += [(best[s][0] + pieces[text[s:end]], best[s][1] + 1) for s in range(end) if text[s:end] in pieces]
        best[end] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1]


def test_token_counts(documents, rows):
    import public_tokenizers

    pieces = token_counts.zipf_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    byte_score = min(pieces.values()) - 10
    got = {r.doc_id: r for r in token_counts.token_counts(documents).collect()}
    for doc_id, text in itertools.islice(sorted(rows.items()), 25):
        want = [best_segmentation(w, pieces, byte_score) for w in SPACE.findall(text)]
        assert got[doc_id].n_tokens == sum(c for _, c in want)
        assert got[doc_id].log_prob == pytest.approx(sum(s for s, _ in want))


def test_trie_scores_do_not_depend_on_order():
    pieces = {"▁a": -1.0, "b": -1.0, "ab": -1.5, "▁": -2.0, "▁ab": -1.9}
    words = ["ab", "abb", "a", "é", "ba"]
    trie = token_counts.PreTokenTrie(pieces)
    one = trie.count(words)
    assert one == trie.count(words[::-1]) == {w: trie.count([w])[w] for w in words}
    assert one["ab"] == (1, -1.9) and one["é"][0] == 3


def test_trie_of_random_words():
    rng = np.random.default_rng(5)
    pieces = {"".join(rng.choice(list("▁abc"), rng.integers(1, 5))): float(-rng.integers(1, 40)) / 4 for _ in range(60)}
    words = sorted({"".join(rng.choice(list("abcé"), rng.integers(1, 12))) for _ in range(400)})
    trie = token_counts.PreTokenTrie(pieces)
    got = trie.count(words)
    for w in words:
        score, tokens = best_segmentation(w, pieces, trie.byte_score)
        assert got[w][0] == tokens and got[w][1] == pytest.approx(score)


def test_a_very_long_word_needs_little_memory():
    import tracemalloc

    trie = token_counts.PreTokenTrie({"▁": -1.0, "x": -2.0, "xx": -3.0})
    tracemalloc.start()
    assert trie.count(["x" * 200_000])["x" * 200_000][0] == 100_001
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_weighted_fingerprints(documents, rows):
    got = {r.doc_id: r for r in weighted_fingerprints.fingerprint_pairs(documents).collect()}
    ids, edited_errors, next_errors, prints = sorted(rows), [], [], {}
    for i, doc_id in enumerate(ids):
        text, following = rows[doc_id], rows[ids[(i + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        count = lambda t: Counter(SPACE.findall(t))
        edited_errors.append(r.near_edited - jaccard(count(text), count(edited)))
        next_errors.append(r.near_next - jaccard(count(text), count(following)))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    # 32 samples: a standard deviation of at most 0.09, and no bias beyond chance
    assert np.sqrt(np.mean(np.square(edited_errors))) < 0.12 and abs(np.mean(edited_errors)) < 0.03
    assert np.sqrt(np.mean(np.square(next_errors))) < 0.1 and abs(np.mean(next_errors)) < 0.03


def plain_fingerprint(text, k=3):
    words = SPACE.findall(lower_ascii(text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if linked(values[i], values[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash(spark, documents, rows):
    got = {r.doc_id: r for r in simhash.near_groups(documents).collect()}
    ids = sorted(rows)
    prints = [plain_fingerprint(rows[i]) for i in ids]
    assert [int.from_bytes(got[i].bits) for i in ids] == prints
    roots = components_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [got[i].component_id for i in ids] == [ids[r] for r in roots]


def test_trie_join_of_dense_and_random_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    values = {int(v) for v in rng.integers(0, 2**64, 300, dtype=np.uint64)}
    for b in base:
        for _ in range(25):
            v = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    monkeypatch.setattr(simhash, "GROUP_ROWS", 8)  # deals even small groups into parts
    nodes = spark.createDataFrame([(bytearray(v.to_bytes(8)),) for v in values], "bits binary")
    links = simhash.trie_links(nodes, 1, 3, simhash.all_choices(len(values), 64, 3))
    found = {int.from_bytes(r.node): int.from_bytes(r.root) for r in components.connected_components(links).collect()}
    roots = components_of(values, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [found.get(v, v) for v in values] == [values[r] for r in roots]


def test_near_copies_are_found(spark):
    rng = np.random.default_rng(2)
    texts, groups = [], []
    for g in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for copy in range(3):
            changed = list(words)
            for at in rng.integers(0, 300, 2 * copy):  # similarity of at least 0.8 between any two
                changed[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(changed))
            groups.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [groups[r.doc_id] for r in simhash.one_of_each_group(docs).collect()]
    assert set(kept) == set(range(20)) and len(kept) <= 21


def plain_alike(sets, share):
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])]


def test_forest_of_alike_sets():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, rng.integers(1, 60))
        for _ in range(rng.integers(1, 6)):
            keep = base[rng.random(len(base)) < 0.93]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 4))]).astype(np.uint64)))
    plain = [set(x.tolist()) for x in sets]
    pairs = {(i, j) for i, j in plain_alike(plain, 0.8) if plain[i]}
    found = simhash.alike(sets, 0.8)
    assert {(min(x), max(x)) for x in found} <= pairs and len(pairs) > 20
    at = range(len(sets))
    linked = {(min(x), max(x)) for x in found}
    assert components_of(list(at), lambda a, b: (min(a, b), max(a, b)) in linked) == components_of(list(at), lambda a, b: (min(a, b), max(a, b)) in pairs)


@pytest.mark.parametrize("part", [500, 3])
def test_documents_that_share_a_passage_stay(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_SETS", part)  # 3: even small groups are dealt into parts
    rng = np.random.default_rng(6)
    docs, copies = [], 0
    for _ in range(12):
        shared = [f"w{x}" for x in rng.integers(0, 5000, 260)]
        for _ in range(6):  # similarity of 0.72 to 0.79
            docs.append(" ".join(shared + [f"v{x}" for x in rng.integers(0, 10**6, 40)]))
        docs.append(docs[-1] + " with one more sentence")
        copies += 1
    shingles = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in docs]
    assert len(plain_alike(shingles, 0.8)) == copies and len(plain_alike(shingles, 0.7)) > 100
    kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(len(docs)) if i % 7 != 6]


def test_all_copies_just_over_the_similarity_are_found(spark):
    rng = np.random.default_rng(9)
    docs = []
    for _ in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        docs += [" ".join(words), " ".join(words[:269] + [f"v{x}" for x in rng.integers(0, 10**6, 31)])]
    shingles = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in docs]
    same = [len(a & b) / len(a | b) for a, b in zip(shingles[::2], shingles[1::2], strict=True)]
    assert 0.8 <= min(same) <= max(same) < 0.82
    kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 300, 2))


def test_large_groups_are_linked_across_parts(spark, monkeypatch):
    """Chains of clusters whose members meet in different parts: every link counts, also between clusters found apart."""
    monkeypatch.setattr(simhash, "PART_SETS", 4)
    monkeypatch.setattr(components, "SPLIT_LINKS", 5)
    rng = np.random.default_rng(12)
    docs = []
    for g in range(3):
        words = [f"g{g}w{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(14):  # each differs a little from the one before, so that the ends are far apart
            docs.append(" ".join(words))
            words = list(words)
            words[rng.integers(0, 120)] = f"n{rng.integers(0, 10**9)}"
    shingles = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in docs]
    pairs = set(plain_alike(shingles, 0.8))
    roots = components_of(list(range(len(docs))), lambda a, b: (a, b) in pairs)
    assert len(pairs) < 3 * 14 * 13 / 2 and len(set(roots)) == 3
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(table).collect())
    assert kept == sorted(set(roots))


def test_few_against_others():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(50) < 0.95], rng.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(30)]
    few, clusters = [i % 3 == 0 for i in range(30)], [i % 4 for i in range(30)]
    plain = [set(x.tolist()) for x in sets]
    want = {(i, clusters[j]) for i in range(30) for j in range(30) if few[i] and not few[j] and clusters[i] != clusters[j] and len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])}
    found = list(simhash.alike_across(sets, few, clusters, 0.8))
    assert {(i, clusters[j]) for i, j in found} == want and len(found) == len(want) > 5


def test_near_copies_of_given_documents(spark):
    """All pairs of the given documents by their five-word shingles: the rows that exact groups keep stay, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    sets = []
    for i in ids:
        words = SPACE.findall(lower_ascii(texts[i]))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    by_shingle, pairs = {}, set()
    for n, own in enumerate(sets):
        for s in own:
            by_shingle.setdefault(s, []).append(n)
    for near in by_shingle.values():
        pairs |= {p for p in itertools.combinations(near, 2)} if len(near) < 50 else set()
    linked = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    root = list(range(len(ids)))
    for _ in range(len(ids)):
        before = list(root)
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    want = {ids[r] for r in root}
    got = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    assert len(linked) > 50 and got <= want | {i for i in ids if not sets[ids.index(i)]}
    assert len(want - got) <= 0.02 * (len(ids) - len(want)) + 1  # texts without a word share one place


def test_hot_keys_are_joined_whole(spark):
    from sweepline.llm.common import hot_join

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    table = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as v")
    got = hot_join(rows, table, "k", "n", 5000)
    assert got.count() == 5000 and got.filter("v != k * 2").count() == 0


def test_blocks_lose_no_pair():
    for n in (10, 10**6, 10**8, 10**11):
        tables = simhash.all_choices(n, 64, 3)
        for bits in itertools.combinations(range(0, 64, 7), 3):
            assert any(all(not any(a <= b < a + w for b in bits) for a, w in chosen) for chosen in tables)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def test_token_files(documents, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = {r.doc_id: r for r in token_files.token_output(documents).collect()}
    start = 0
    for doc_id, text in sorted(rows.items()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == want
        start += len(ids)


@pytest.mark.parametrize("text", ["", "it's 'tis", "IT'S", "Ünï-CÖDE,.. x##\"## 12ab", "<|endoftext|>. a<|startoftext|>b <|endoftext||>", "ΣΑΣ İ ß ǅ", "é ̈́ a b c\x1cd\x85e", "漢字 🚨🚨 ½²", "don't,'s 's", "x" * 3000])
def test_chunks_encode_like_whole_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = str(public_tokenizers.path(name))
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        encoder = token_files.Encoder(path)
        assert [x.tolist() for x in encoder.encode(pa.array(["before. ", text, None, text + "'s"]))][1:3] == [want, []]
        assert encoder.by_word == name.startswith("word")


def test_token_files_of_a_tokenizer_that_keeps_white_space(spark, documents, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_files.token_output(documents, path).collect()}
    for doc_id, text in rows.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[doc_id].n_tokens, got[doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_ids_that_do_not_fit():
    import io

    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.id_dtype(path, 1) == "<u2" and token_files.id_dtype(path, 70_000) == "<u4"
    with pytest.raises(ValueError):
        token_files.id_dtype(path, -1)
    with pytest.raises(ValueError):
        token_files.TokenWriter(io.BytesIO()).add(1, np.array([70_000], "<u4"))


def test_damaged_frames_are_noticed():
    import io

    out = io.BytesIO()
    writer = token_files.TokenWriter(out)
    docs = [np.arange(n, dtype=np.uint32) % 50000 for n in (0, 5, 70_000, 3, 70_000)]
    for i, ids in enumerate(docs):
        writer.add(None if i == 1 else i, ids)
    writer.close()
    data = bytearray(out.getvalue())
    reader = token_files.TokenReader(io.BytesIO(data), len(data))
    for i in (4, 0, 2, 1, 3):  # in any order, frame by frame
        doc_id, ids = reader.document(i)
        assert doc_id == (None if i == 1 else i) and ids.tolist() == docs[i].tolist()
    data[20] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        token_files.TokenReader(io.BytesIO(data), len(data)).document(2)


def test_toxicity_held_out(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    joined = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(joined) > 300
    assert sum(r.predicted == r.toxic for r in joined) / len(joined) > 0.97
    assert all(0 <= r.score <= 1 for r in joined)


def test_toxicity_scores_are_plain_pairwise_sums():
    rng = np.random.default_rng(2)
    size = 40
    slots = np.full(1 << toxicity.BUCKET_BITS, -1, np.int32)
    slots[:size] = np.arange(size)
    machine = toxicity.FactorizationMachine(-0.3, slots, rng.normal(0, 1, size), rng.normal(0, 0.5, (size, 4)))
    rows = [rng.choice(size + 5, n, replace=False).astype(np.int32) for n in (0, 1, 2, 7, 30)]
    for row, got in zip(rows, machine.scores(rows), strict=True):
        own = [i for i in row if i < size]
        total = machine.bias + sum(machine.weights[i] for i in own)
        total += sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(own, 2))
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def test_toxicity_learns_from_a_bounded_sample(spark, monkeypatch):
    """An id of very many texts and repeated rows neither passes the bound nor crowds the others out."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 50)
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.update(rows=rows, labels=labels))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = [(ids[0], f"hot text {k}") for k in range(400)] + [(i, f"text of {i}") for i in ids for _ in range(3)]
    labels = [(i, i % 2) for i in ids]
    toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels * 2, "doc_id long, toxic int"))
    assert len(seen["rows"]) == len(seen["labels"]) <= 50
    few = [(i, f"word{'abcdefghij'[i % 10]} {'xyz'[i % 3]}") for i in ids[:20]]
    toxicity.train(spark.createDataFrame(few * 4, "doc_id long, text string"), spark.createDataFrame(labels[:20], "doc_id long, toxic int"))
    assert len(seen["rows"]) == 20 and seen["labels"].tolist() == [i % 2 for i in ids[:20]]


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        insult, group = rng.random(2) < 0.5
        extra = rng.integers(100, 200, 5).tolist()
        rows.append(np.array(sorted({*extra, *([1] if insult else []), *([2] if group else [])}), np.int32))
        labels.append(float(insult and group))
    machine = toxicity.fit(rows, np.array(labels))
    both, one = machine.scores([np.array([1, 2], np.int32), np.array([1], np.int32)])
    assert both > 0.5 > one
    assert machine.factors[machine.slots[1]] @ machine.factors[machine.slots[2]] > 0


def test_leaks(spark, data, documents, rows):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, items).collect()}
    verbatim = {(d, i.item_id) for i in items.collect() for d, t in rows.items() if i.text in t}
    assert verbatim and verbatim <= found


def test_reordered_passages_and_bit_tables(spark, monkeypatch):
    item = "one two three four five six seven. alpha beta gamma delta epsilon zeta eta."
    docs = spark.createDataFrame([(1, "xx alpha beta gamma delta epsilon zeta eta yy one two three four five six seven zz"), (2, "one two three four five other words"), (3, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(0, item), (1, "some other item of words that no text has")], "item_id long, text string")
    for bits, slab in ((26, 1 << 20), (16, 1)):
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        monkeypatch.setattr(decontaminate, "SLAB", slab)
        got = decontaminate.leaks(docs, items).collect()
        assert [(r.doc_id, r.item_id, r.coverage, r.tiles) for r in got] == [(1, 0, 1.0, 2)]
        assert [r.doc_id for r in decontaminate.without_leaks(docs, items).orderBy("doc_id").collect()] == [2, 3]


def test_a_short_item_drops_only_documents_of_its_words(spark):
    docs = spark.createDataFrame([(1, "I say yes to this and to that"), (2, "Yes!"), (3, "no"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "yes"), (1, ""), (2, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [1, 3, 4]


def plain_tiles(doc, item, width):
    """Greedy string tiling by trying all places again and again."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return out
        out.append(best)
        used_d |= set(range(best[0], best[0] + best[2]))
        used_i |= set(range(best[1], best[1] + best[2]))


def test_tiles_equal_plain_tiling():
    rng = np.random.default_rng(4)
    for _ in range(150):
        doc, item = rng.integers(0, 3, rng.integers(3, 40)), rng.integers(0, 3, rng.integers(3, 20))
        seeds = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if (doc[d : d + 3] == item[i : i + 3]).all()]
        got = decontaminate.tiles(doc, item, seeds, 3) if seeds else []
        assert got == plain_tiles(doc.tolist(), item.tolist(), 3)


def test_languages_held_out(documents):
    got = {r.doc_id: r for r in language.language_id(documents).collect()}
    held = [r for r in documents.collect() if got[r.doc_id].held_out and r.lang]
    assert held and sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(6)
    scores = rng.normal(0, 3, (30, 3))
    ids = [rng.integers(0, 30, n) for n in (0, 1, 5, 3, 5)]
    got = language.viterbi(ids, scores, 2.0)
    for own, labels in zip(ids, got, strict=True):
        value = lambda path: sum(scores[w, p] for w, p in zip(own, path, strict=True)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: E731, B023
        best = max((value(p) for p in itertools.product(range(3), repeat=len(own))), default=0)
        assert value(labels.tolist()) == pytest.approx(best)


def test_viterbi_of_many_languages():
    n = 300
    scores = np.full((n, n), -5.0)
    np.fill_diagonal(scores, 5.0)
    (got,) = language.viterbi([np.arange(n)], scores, 0.5)
    assert got.tolist() == list(range(n))


def test_numerals_are_not_letters(spark, documents):
    model = language.train(documents)
    texts = ["½ ² Ⅷ ①", "٣ 12 _", "ª", "the½word and the other²"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.language_id(docs, model).collect()}
    assert got[0] == got[1] == "und" and got[2] != "und" and got[3] == "en"
    assert language.letter_words("the½word é漢² Ⅷ") == ["the", "word", "é漢"]


def test_mixed_text_has_spans(spark, documents):
    model = language.train(documents)
    texts = {}
    for r in documents.filter("length(text) between 300 and 2000").collect():
        texts.setdefault(r.lang, r.text)
    docs = spark.createDataFrame([(1, texts["en"] + " " + texts["de"]), (2, "Это русский текст"), (3, "123 !!!")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in language.language_spans(docs, model).collect()}
    assert [s.lang for s in spans[1]][0] == "en" and [s.lang for s in spans[1]][-1] == "de" and len(spans[1]) <= 4
    assert {r.doc_id: r.lang_pred for r in language.language_id(docs, model).collect()}[3] == "und"


def test_mixing_by_loop(spark, data, documents, rows):
    sources = {r.doc_id: r.source for r in documents.collect()}
    sizes = {d: len(SPACE.findall(t)) for d, t in rows.items()}
    by = {s: sum(n for d, n in sizes.items() if sources[d] == s) for s in sorted(set(sources.values()))}
    weights = dict(zip(by, itertools.cycle((5, 2, 1))))
    targets, open_ = {}, set(by)
    while True:  # share by weight, stop what is over its cap, share the rest again
        left = sum(by.values()) - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s]}
        if not over:
            targets |= share
            break
        targets |= {s: 3 * by[s] for s in over}
        open_ -= over
    plan = mixing.mix_plan(documents).collect()
    largest = max(sizes.values())
    for s in by:
        own = [r for r in plan if r.source == s]
        assert own[0].target == pytest.approx(targets[s])
        assert abs(sum(r.taken for r in own) - targets[s]) <= 3 * largest
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in plan)
    again = mixing.mix_plan(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in plan) == sorted((r.doc_id, r.taken) for r in again)
    emitted = Counter(r.doc_id for r in mixing.mixed(documents).collect())
    assert emitted == Counter({r.doc_id: r.copies for r in plan if r.copies})


def test_mixing_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    want = sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.OP9_SQL})").fetchall())
    got = sorted(map(tuple, mixing.op9_mixing(spark, data).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert got == want


def test_network_learns_and_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    counts = np.ones(lm_scoring.SIZE)
    net, squares = lm_scoring.Network.start(counts), lm_scoring.Network(np.full(lm_scoring.Network.LENGTH, 1e-4, np.float32))
    texts = [np.array([1 + (s + i) % 7 for i in range(50)], np.int32) for s in rng.integers(0, 7, 60)]
    target, around, _ = lm_scoring.windows(texts)
    before = net.log_probs(target, around).mean()
    for _ in range(30):
        net.train(target, around, squares)
    assert net.log_probs(target, around).mean() > before + 3
    one = np.repeat(around[:, 10:11], lm_scoring.SIZE, axis=1)
    assert np.exp(net.log_probs(np.arange(lm_scoring.SIZE), one).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_a_batch_takes_two_softmaxes_whatever_its_classes(monkeypatch):
    calls, plain = [], lm_scoring._exp
    monkeypatch.setattr(lm_scoring, "_exp", lambda z: calls.append(len(z)) or plain(z))
    net, squares = lm_scoring.Network.start(np.ones(lm_scoring.SIZE)), lm_scoring.Network(np.full(lm_scoring.Network.LENGTH, 1e-4, np.float32))
    rng = np.random.default_rng(4)
    target, around = rng.integers(0, lm_scoring.SIZE, 300), rng.integers(0, lm_scoring.SIZE, (4, 300))
    net.train(target, around, squares)
    assert calls == [300, 300]
    got = net.log_probs(target, around)
    assert calls == [300] * 4
    for i in range(0, 300, 20):
        h = np.tanh(sum(net.e[k][around[k, i]] for k in range(4)))
        kind, word = divmod(int(target[i]), lm_scoring.CLASS)
        zs = ((net.c @ h + net.cb, kind), (net.w[kind] @ h + net.wb[kind], word))
        assert got[i] == pytest.approx(sum(float(z[at] - np.log(np.exp(z).sum())) for z, at in zs), abs=1e-4)


def test_windows_by_loop():
    texts = [np.array([5, 6, 7], np.int32), np.array([], np.int32), np.array([8], np.int32)]
    target, around, sizes = lm_scoring.windows(texts)
    assert target.tolist() == [5, 6, 7, 8] and sizes.tolist() == [3, 0, 1]
    assert around.T.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def test_scores_tell_shuffled_texts(spark, documents):
    vocabulary, counts = lm_scoring.learn_vocabulary(lm_scoring.tokenized(documents))
    net = lm_scoring.train(lm_scoring.encode(lm_scoring.tokenized(documents), vocabulary), counts)
    texts = [r.text for r in documents.filter("length(text) > 1000 and lang = 'en'").limit(15).collect()]
    rng = np.random.default_rng(3)
    noise = [" ".join("".join(rng.permutation(list(w))) for w in t.split()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts + noise)), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in lm_scoring.score(lm_scoring.encode(lm_scoring.tokenized(docs), vocabulary), net).collect()}
    assert sum(got[i] > got[i + len(texts)] for i in range(len(texts))) > 0.8 * len(texts)


def test_invented_words_score_below_the_words_they_stand_for(spark, documents):
    vocabulary, counts = lm_scoring.learn_vocabulary(lm_scoring.tokenized(documents))
    net = lm_scoring.Network.start(counts)
    texts = [r.text for r in documents.filter("length(text) > 1000 and lang = 'en'").collect()]
    texts = [t for t in texts if any(vocabulary[w] > lm_scoring.N_WORDS for w in lm_scoring.TOKENS.findall(t.lower()))]
    junk = [lm_scoring.TOKENS.sub(lambda m: m[0] if vocabulary[m[0].lower()] <= lm_scoring.N_WORDS else "qxzjvk" + m[0][-2:], t) for t in texts]
    assert len(texts) >= 5
    docs = spark.createDataFrame(list(enumerate(texts + junk)), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in lm_scoring.score(lm_scoring.encode(lm_scoring.tokenized(docs), vocabulary), net).collect()}
    assert all(got[i] > got[i + len(texts)] for i in range(len(texts)))


def test_words_without_an_id_are_charged_for_their_spelling(monkeypatch):
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 4)
    seen = Counter()
    for word, n in (("zebra", 3), ("cobra", 2), ("quux", 1)):
        data = lm_scoring.spelled(word)
        for i in range(len(data) - 2):
            seen[data[i] << 16 | data[i + 1] << 8 | data[i + 2]] += n
        seen[(1 << 24) + lm_scoring.ending_of(word)] += n
    vocabulary = lm_scoring.Vocabulary(["the", "a"], lm_scoring.Spelling(seen))
    plain = lm_scoring.Spelling(seen)
    text = "The zebra a ZEBRA quux, unseen words cobra zebra the ümlaut"
    words = re.findall(r"\w+", text.lower())
    own = {"the": 1, "a": 2}

    def by_bytes(word):
        """The same by plain loops over the counts."""
        data, total = lm_scoring.spelled(word), 0.0
        for x, y, z in zip(data, data[1:], data[2:]):
            p = 1 / 256
            for run, before in (((z,), ()), ((y, z), (y,)), ((x, y, z), (x, y))):
                counts = Counter({c: n for c, n in seen.items() if c < 1 << 24})
                of = lambda tail: sum(n for c, n in counts.items() if tuple(c.to_bytes(3, "big"))[3 - len(tail) :] == tail)  # noqa: E731, B023
                head = lambda h: sum(n for c, n in counts.items() if tuple(c.to_bytes(3, "big"))[2 - len(h) : 2] == h)  # noqa: E731, B023
                p = (of(run) + 4 * p) / (head(before) + 4)
            total += math.log(p)
        endings = {c - (1 << 24): n for c, n in seen.items() if c >= 1 << 24}
        return min(0.0, total - math.log((endings.get(lm_scoring.ending_of(word), 0) + 0.5) / (sum(endings.values()) + 0.5 * lm_scoring.N_ENDINGS)))

    for _ in range(2):
        ids, spelt = vocabulary.coded(words)
        assert ids.tolist() == [own.get(w) or 1 + lm_scoring.N_WORDS + lm_scoring.ending_of(w) for w in words]
        assert spelt == pytest.approx([0.0 if w in own else by_bytes(w) for w in words])
        assert plain.log_prob("zebra") == pytest.approx(by_bytes("zebra"))
    assert vocabulary.coded([])[0].tolist() == [] and vocabulary.coded(["the", "a"])[1].tolist() == [0.0, 0.0]


def test_log_probability_by_plain_sums(spark, documents, rows):
    vocabulary, counts = lm_scoring.learn_vocabulary(lm_scoring.tokenized(documents))
    encoded = lm_scoring.encode(lm_scoring.tokenized(documents), vocabulary)
    net = lm_scoring.train(encoded, counts)
    got = {r.doc_id: r for r in lm_scoring.score(encoded, net).collect()}
    softmax = lambda z: z - np.log(np.exp(z - z.max()).sum()) - z.max()
    for doc_id in sorted(rows)[:12]:
        words = re.findall(r"\w+", (rows[doc_id] or "").lower())[:400]
        ids = [vocabulary[w] for w in words]
        total = 0.0
        for i, (word, own) in enumerate(zip(words, ids, strict=True)):
            h = np.tanh(sum(net.e[k][ids[i + o] if 0 <= i + o < len(ids) else 0].astype(float) for k, o in enumerate((-2, -1, 1, 2))))
            total += softmax(net.c.astype(float) @ h + net.cb)[own // 64] + softmax(net.w[own // 64].astype(float) @ h + net.wb[own // 64])[own % 64]
            total += vocabulary.spelling.log_prob(word) if own > lm_scoring.N_WORDS else 0.0
        short = spark.createDataFrame([(doc_id, " ".join(words))], "doc_id long, text string")
        (found,) = lm_scoring.score(lm_scoring.encode(lm_scoring.tokenized(short), vocabulary), net).collect()
        assert found.n_words == len(words) and found.log_prob == pytest.approx(total, rel=1e-4)
        if len(words) < 400:
            assert got[doc_id].log_prob == pytest.approx(total, rel=1e-4)


def test_scores_dont_depend_on_tasks(spark, documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 20_000)
    copies = documents.unionByName(documents.limit(1).crossJoin(spark.range(50)).drop("id"))
    runs = []
    for docs in (copies.repartition(1), copies.repartition(7)):
        runs.append(sorted((r.doc_id, r.n_words, r.log_prob) for r in lm_scoring.pseudo_likelihood(docs).collect()))
    assert [r[:2] for r in runs[0]] == [r[:2] for r in runs[1]]
    assert np.allclose([r[2] for r in runs[0]], [r[2] for r in runs[1]], rtol=1e-6, atol=1e-6)


def test_weights_are_copies():
    counts = np.ones(lm_scoring.SIZE)
    texts = [np.array([1, 2, 3, 4, 5], np.int32), np.array([9, 8, 7], np.int32)]
    nets = []
    for given, weight in ((texts, [3.0] * 5 + [1.0] * 3), ([texts[0]] * 3 + [texts[1]], None)):
        net, squares = lm_scoring.Network.start(counts), lm_scoring.Network(np.full(lm_scoring.Network.LENGTH, 1e-4, np.float32))
        target, around, _ = lm_scoring.windows(given)
        net.train(target, around, squares, weight=None if weight is None else np.array(weight))
        nets.append(net.flat)
    assert np.allclose(*nets, atol=1e-5)


def test_rare_runs_keep_their_last_bytes(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SPELLED_RUNS", 2)
    codes = [(0x616263, 9), (0x616264, 8), (0x656263, 1), (0x666263, 2), ((1 << 24) + 5, 3)]
    got = {r.code: r.n for r in lm_scoring.bounded_spelling(spark.createDataFrame(codes, "code int, n long")).collect()}
    assert got == {0x616263: 9, 0x616264: 8, 0xFF6263: 3, (1 << 24) + 5: 3}


def plain_leaks(docs, items, width=5, least=0.5):
    """Every text against every item by plain tiling."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for doc_id, text in docs:
        doc = split(text)
        for item_id, words in ((i, split(t)) for i, t in items):
            if 0 < len(words) < width:
                if any(doc[k : k + len(words)] == words for k in range(len(doc) - len(words) + 1)):
                    out.append((doc_id, item_id, 1.0, len(words), 1))
            elif words:
                marked = plain_tiles(doc, words, width)
                n = sum(t[2] for t in marked)
                if n / len(words) >= least:
                    out.append((doc_id, item_id, n / len(words), n, len(marked)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_all_pairs(spark, monkeypatch, seed):
    """Neither lost nor false finds, over a small alphabet where chance matches and repeated words are common."""
    monkeypatch.setattr(decontaminate, "SLAB", 7)
    rng = np.random.default_rng(seed)
    words = lambda n, k: " ".join("abcdefghij"[i] for i in rng.integers(0, k, n))
    items = [(i, words(rng.integers(1, 14), 5)) for i in range(12)] + [(20, "a a a a a a a a"), (20, "b a b a b a"), (None, "c d e a b c"), (21, None), (22, "")]
    docs = [(i, words(rng.integers(0, 60), 5)) for i in range(40)] + [(50, "a " * 90), (51, "b a " * 40), (50, "a " * 90), (None, items[3][1]), (52, None)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_leaks(docs, items)


def test_leaks_of_the_documents_are_no_false_finds(spark, data, documents, rows):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known = {i.item_id: split(i.text) for i in items.collect()}
    for r in decontaminate.leaks(documents, items).collect():
        doc, item = split(rows[r.doc_id]), known[r.item_id]
        runs = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        covered = {k + j for k in range(len(item) - 4) if tuple(item[k : k + 5]) in runs for j in range(5)}
        assert r.coverage >= 0.5 and len(covered) >= r.matched_words >= 0.5 * len(item)


def test_words_repeated_on_both_sides_are_quick(spark):
    import time

    docs = spark.createDataFrame([(1, "same " * 60_000), (2, "same other " * 20_000)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "same " * 200), (1, "other same " * 100)], "item_id long, text string")
    began = time.time()
    got = sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(1, 0, 1.0, 200, 1), (2, 1, 1.0, 200, 1)] and time.time() - began < 60


def test_memory_of_a_long_word_is_bounded(monkeypatch):
    import tracemalloc

    pieces = {"▁": -1.0, "a": -2.0, "ab": -2.5, "abc": -2.6, "bcab": -3.0, "▁ab": -2.2}
    whole = token_counts.PreTokenTrie(pieces)
    words = ["abcabcab" * 40, "abcabcab" * 40 + "x", "abcabcab" * 39 + "zé", "b", "abcab"]
    want = whole.count(words)
    monkeypatch.setattr(token_counts, "DEEPEST", 5)
    assert whole.count(words) == want
    monkeypatch.setattr(token_counts, "DEEPEST", 4096)
    tracemalloc.start()
    whole.count(["abc" * 200_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6

"""Centroids, hard negatives and main text against plain versions; hot ids of languages; token ids of every code point."""

import hashlib
import math
import random
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from sweepline.llm import centroids, hard_negatives, language, main_text, token_files

# --- centroids


def plain_lloyd(rows, k, rounds, scale=1024, seed=3):
    """rows: (id, list) -> ({position: (cluster, distance)}, centroids)."""
    vectors = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    named = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in named[:k]]

    def assign():
        out = []
        for _, v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (cluster, _) in zip(vectors, found) if cluster == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *a) for (i, _), a in zip(vectors, assign())], centres


@pytest.mark.parametrize(("dims", "width", "k", "chunk"), [(6, 4, 3, 7), (5, 5, 4, 1000), (7, 2, 30, 3)])
def test_centroids_equal_plain_lloyd(spark, monkeypatch, dims, width, k, chunk):
    monkeypatch.setattr(centroids, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(dims)
    rows = [(i if i % 9 else None, rng.normal(0, 1, dims).round(2).tolist()) for i in range(50)] + [(7, [0.5] * dims)] * 8
    if k == 30:
        rows = rows[:20]  # fewer vectors than centroids
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, final = centroids.clusters(centroids.integer_vectors(frame, dims, 1024), k, 4, 3, width)
    want, centres = plain_lloyd(rows, k, 4)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    table = {(r.cluster, r.block * width + r.place): r.value for r in final.collect()}
    assert table == {(c, d): x for c, centre in enumerate(centres) for d, x in enumerate(centre)}
    full = centroids.with_inertia(got, final).collect()
    assert len(full) == len(rows)
    for r in full:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, chunk string, block string, part string, slice string"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.25, -0.5, 0.125, 1.0]
    rows = [(1, good), (1, good), (None, good), (2, None), (3, []), (4, good[:3]), (5, [*good, 1.0]), (6, [None, 1.0, 1.0, 1.0]), (7, [nan, 1.0, 1.0, 1.0]), (8, [inf, 1.0, 1.0, 1.0]), (9, [0.0] * 4), (10, [1e30, -1e30, 0.0, 0.0])]
    return spark.createDataFrame([(i, v, 1, *"abcdef") for i, v in rows], VECTORS)


def test_centroids_of_odd_rows(spark):
    rows = odd_vectors(spark)
    got, _ = centroids.clusters(centroids.integer_vectors(rows, 4, 1024), 2, 3)
    assert sorted(str(r.vec_id) for r in got.collect()) == ["1", "1", "10", "9", "None"]
    for none in (rows.limit(0), rows.filter("vec_id = 2")):
        out = centroids.with_inertia(*centroids.clusters(centroids.integer_vectors(none, 4, 1024), 2, 3))
        assert out.count() == 0


def test_chunks_and_blocks_dont_change_the_result(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = centroids.integer_vectors(rows, 64, 1024)
    a, b = (centroids.clusters(v, 8, 2, 3, w)[0] for v, w in ((vectors, 16), (vectors.repartition(7), 9)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


# --- hard negatives


def plain_negatives(rows, every=50, positives=5, negatives=3):
    kept = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: sys.maxsize if i is None else i
    out = []
    for n, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), last(i), own == label) for m, (i, own, w) in enumerate(kept) if m != n))
        for score, i, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score][:negatives]
            out += [(anchor, i, rank, j, -score, -s) for rank, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(frame, **options):
    found = hard_negatives.hard_negatives(hard_negatives.integer_rows(frame), **options)
    last = lambda i: sys.maxsize if i is None else i
    return sorted((r.anchor_id, last(r.positive_id), r.rank, last(r.negative_id), r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, seed):
    for name, value in (("PART_ROWS", 60), ("BUNDLE_ROWS", 5), ("SLICE_ROWS", 3), ("LEAST_PARTS", 3), ("STEP", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    chance = random.Random(seed)
    centre = [[chance.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(260):
        v = [round(x + chance.gauss(0, 0.6), 1) for x in chance.choice(centre)]
        rows.append((i * 5, v, chance.randrange(4)))
    rows += [(50, rows[10][1], rows[10][2])] + [(3000 + i, rows[20][1], i % 2) for i in range(80)] + [(None, rows[0][1], 1), (None, rows[0][1], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert mined(frame) == plain_negatives(rows)


def test_hard_negatives_of_the_table(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label")
    assert mined(frame) == plain_negatives([tuple(r) for r in frame.collect()])


def test_negative_and_zero_scores_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [0.7, 0.0], 2), (50, [0.0, 0.0], 2), (6, [0.5], 2), (8, [], 1), (9, None, 1), (10, [1.0, 1.0], None), (12, [float("nan"), 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert mined(frame) == plain_negatives([(i, None if v is None else (v + [0.0, 0.0])[:2], label) for i, v, label in rows])
    assert mined(frame.limit(0)) == [] and mined(frame.filter("vec_id = 1")) == []
    assert mined(odd_vectors(spark)) == []


def test_large_components_are_exact():
    a = np.array([[2.0**27, 3.0], [-(2.0**27), 1.0]])
    want = [[int(x) * int(y) + int(p) * int(q) for y, q in a.tolist()] for x, p in a.tolist()]
    assert hard_negatives.products(a, a).tolist() == want


def test_a_walk_ends_early():
    rng = np.random.default_rng(4)
    directions = rng.normal(0, 1, (20, 16))
    rows = np.rint(100 * np.concatenate([d + rng.normal(0, 0.05, (500, 16)) for d in directions]))
    unit, length = hard_negatives.directions(rows)
    members = rows[:40]
    shared = hard_negatives.SharedList(rows, unit, length, members)
    scores = hard_negatives.products(members, shared.rows)
    for start in (0, 64, 5_000):
        assert (scores[:, start:] <= shared.limit(start)[:, None]).all()  # the bound holds
    tenth = np.sort(scores, axis=1)[:, -10]
    certified = next(s for s in range(0, len(rows), 100) if (shared.limit(s) < tenth).all())
    assert certified < len(rows) / 5


# --- main text

TREE = main_text.trained()
STORM = "Storms crossed the coast on Monday, officials said, and left the harbour closed for a second day while crews cleared the road."


def read(page):
    return main_text.main_text(page, TREE)


def test_pages_of_the_table(spark, data):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in main_text.extracted(pages).collect()}
    given = pages.collect()
    assert len(got) == len(given)
    for r in given:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = (" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


PAGES = {
    "around an article": (
        f"""<!doctype html><html><head><title>T</title><style>a>b{{}}</style><script>if(a<b){{document.write("<p>no</p>")}}</script></head><body class="has-sidebar"><!-- <p>no</p> -->
        <div id="cookie-banner"><p>We use cookies on this site. <a href=#>Accept</a></p></div><header class="site-header"><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav></header>
        <div class="page-wrap content"><aside class="sidebar"><h2>Latest</h2><p>{STORM}</p></aside><main><article class="post"><header><h1>Coast &amp; harbour</h1></header><p>{STORM}<p>Short one.<div class="ad">Buy {STORM}</div>
        <p>A <b>bold</b> &lt;tag&gt; and <a href="x">link</a>,&nbsp;ok<br>line&#8212;two</p><ul><li>one<li>two</ul><form><label>Email</label><input><button>Go</button></form><p>Last &copy; 1 < 2.</p><div class="share"><a href=#>Tweet</a></div></article></main>
        <section id="comments"><h3>Comments</h3><article class="comment"><p>{STORM}</p></article></section></div><footer><p>{STORM}</p></footer><script>var t="</p>";""",
        ["Coast & harbour", STORM, "Short one.", "A bold <tag> and link, ok line—two", "one", "two", "Last © 1 < 2."],
    ),
    "plain divisions": (
        f"<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><table><tr><td><a>x</a><td><a>y</a></table><h1>Title of it here</h1><div>{STORM}</div><div>Brief line.</div><div>{STORM} {STORM}</div><div><a>More</a> <a>Less</a></div><div>Copyright 2020 us</div>",
        ["Title of it here", STORM, "Brief line.", f"{STORM} {STORM}"],
    ),
    "an article in a form, as some servers write": (f"<body><form><nav><a>Home</a></nav><div role=main><p>{STORM}</p></div><div role=contentinfo>{STORM}</div></form>", [STORM]),
    "left open": (f"<article><p><span class=ad>Buy now<p>{STORM}<p><b>Word.<p>{STORM}<div>{STORM}", [STORM, "Word.", STORM, STORM]),
    "head without an end": (f"<head><title>No</title><style>p{{}}</style><article><p>{STORM}</article>", [STORM]),
    "invisible": (f'<article><p style="display: none">{STORM}</p><p hidden>{STORM}</p><noscript>{STORM}</noscript><template><p>{STORM}</p></template><p>{STORM}</p></article>', [STORM]),
    "tags in attributes and stray ends": (f"""</div></article><article><p title="a > b" data-x='<p>no</p>'>{STORM}</i></p></div><p>{STORM}</p></article>""", [STORM, STORM]),
    "references cut by tags": ("<article><p>" + STORM + " &amp;lt; &#x41;<b>&#66;</b>&notanentity;</p></article>", [STORM + " &lt; AB¬anentity;"]),
    "upper case": (f"<BODY><NAV><A HREF=x>Home</A></NAV><ARTICLE><P>{STORM}</P></ARTICLE><ASIDE>{STORM}</ASIDE>", [STORM]),
    "menus in the content": (f'<div id=content><ul class=menu><li><a>One</a><li><a>Two</a></ul><h2>The storm of Monday</h2><p>{STORM}</p><div class="related-posts"><a>{STORM}</a></div></div>', ["The storm of Monday", STORM]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_makes(name):
    page, want = PAGES[name]
    assert read(page).split("\n") == want


def test_odd_pages(spark):
    rows = [(1, "u", None, 5), (1, "u", "", 5), (None, None, " \n", 5), (2, "u", "<", 5), (3, "u", "<!--", 5), (4, "u", f"<article><p>{STORM}", 5), (4, "u", f"<article><p>{STORM}", 5), (5, "u", "<article><p>𝒳 é</p></article>", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in main_text.extracted(frame).collect())
    assert got == sorted([("1", "", 0), ("1", "", 0), ("None", "", 0), ("2", "", 0), ("3", "", 0), ("4", STORM, len(STORM)), ("4", STORM, len(STORM)), ("5", "𝒳 é", 3)])
    assert main_text.extracted(frame.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<", "<div ", '<div a="', "<script>", "<b class=ad>", "<!--", "<![CDATA[", "&amp", "</p>", "<p>"])
def test_time_is_in_proportion(part):
    import time

    took = []
    for n in (30_000, 120_000):
        began = time.process_time()
        read(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_the_tree_fits_its_table():
    pages = [np.array(p) for p in main_text.LABELLED]
    x, y = np.concatenate([main_text.features(*p[:, :4].T) for p in pages]), np.concatenate([p[:, 4] for p in pages])
    assert ((main_text.decide(TREE, x) >= 0.5) == y).mean() == 1.0
    held = [np.array(p) for i, p in enumerate(main_text.LABELLED) if i % 4]
    part = main_text.train(np.concatenate([main_text.features(*p[:, :4].T) for p in held]), np.concatenate([p[:, 4] for p in held]))
    rest = [p for i, p in enumerate(pages) if i % 4 == 0]
    x, y = np.concatenate([main_text.features(*p[:, :4].T) for p in rest]), np.concatenate([p[:, 4] for p in rest])
    assert ((main_text.decide(part, x) >= 0.5) == y).mean() > 0.85


# --- token ids and languages


def test_ids_of_every_code_point_before_a_mark():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain, own = Tokenizer.from_file(path), token_files.Encoder(path)
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    for mark in (".", "?!", "'s,"):
        texts = [" ".join(f"a{c}{mark} {c}{mark}" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
        want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
        for text, ids, found in zip(texts, want, own.encode(pa.array(texts)), strict=True):
            assert found.tolist() == ids, text[:80]


def test_a_hot_id_is_spread_over_files(spark):
    rows = [(7, f"text number {i % 3}") for i in range(3000)] + [(None, "x")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    folder = token_files.new_folder(spark, "hot-test")
    import public_tokenizers

    manifest = token_files.write_token_files(docs, str(public_tokenizers.path("word_bpe_49k.json")), folder)
    assert max(r.n_docs for r in manifest.collect()) < 2500
    found = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    assert len(found) == 4000 and [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda i: (i is not None, i))


def test_a_repeated_id_changes_no_prediction(spark, documents):
    from pyspark.sql import functions as F

    usual = language.train(documents)
    ids = documents.filter("lang = 'en' and doc_id is not null").filter(~language.is_held_out()).orderBy(F.xxhash64("doc_id")).limit(1)
    hot = documents.join(ids.select("doc_id"), "doc_id").select(documents.columns).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(12_000)))).drop("n")
    other = language.train(documents.unionByName(hot))
    assert other.languages == usual.languages and np.array_equal(other.trigram_scores, usual.trigram_scores)

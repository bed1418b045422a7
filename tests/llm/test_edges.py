"""Every operator on odd rows and on an empty table; every stage keeps the columns of documents."""

import pytest

from sweepline.llm import decontaminate, language, licenses, lm_scoring, mixing, simhash, token_counts, token_files, toxicity, weighted_fingerprints

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (99, 0, 1), (10, 1, 0)], LABELS)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(0, "the quick brown fox is released"), (None, "a dog and the cat are here now"), (2, None), (3, ""), (4, "!!!"), (5, "cc by")], "item_id long, text string")


OPERATORS = {
    "licenses": lambda d, la, it: licenses.license_scan(d),
    "token_counts": lambda d, la, it: token_counts.token_counts(d),
    "fingerprints": lambda d, la, it: weighted_fingerprints.fingerprint_pairs(d),
    "simhash": lambda d, la, it: simhash.near_groups(d),
    "token_files": lambda d, la, it: token_files.token_output(d),
    "toxicity": lambda d, la, it: toxicity.toxicity(d, la),
    "language": lambda d, la, it: language.language_id(d),
    "mixing": lambda d, la, it: mixing.mix_plan(d),
    "lm_scoring": lambda d, la, it: lm_scoring.pseudo_likelihood(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, odd_docs, labels, items):
    out = OPERATORS[name](odd_docs, labels, items).collect()
    assert len(out) == odd_docs.count()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd_docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, no_docs, labels, items):
    assert OPERATORS[name](no_docs, labels, items).count() == 0


@pytest.mark.parametrize("name", ["toxicity"])
def test_no_labels(name, odd_docs, labels):
    assert {r.score < 0.5 for r in toxicity.toxicity(odd_docs, labels.filter("false")).collect()} == {True}


def test_leaks_on_odd_rows(spark, odd_docs, no_docs, items):
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect()}
    assert found == {(1, 0), (2, 0), (9, 5)}
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(odd_docs, items.filter("false")).count() == 0


STAGES = {
    "toxicity": lambda d, la, it: toxicity.without_toxic(d, la),
    "simhash": lambda d, la, it: simhash.one_of_each_group(d),
    "decontamination": lambda d, la, it: decontaminate.without_leaks(d, it),
    "mixing": lambda d, la, it: mixing.mixed(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(name, odd_docs, no_docs, labels, items):
    out = STAGES[name](odd_docs, labels, items)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert STAGES[name](no_docs, labels, items).count() == 0


def test_dedup_keeps_one_of_each_text(odd_docs):
    kept = [r.doc_id for r in simhash.one_of_each_group(odd_docs).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 6, 7, 8, 9, 10]
    assert kept.count(None) == 1  # one text has no id in any of its rows


@pytest.mark.parametrize("name", ["simhash", "mixing"])
def test_stages_keep_columns_named_like_their_own(spark, name, labels, items):
    names = ["_id", "_source", "_size", "_nth", "_time", "p_id", "p_source", "_text", "id", "key", "many", "part", "node", "copies", "rank"]
    rows = [(i, f"some text number {i} with a few words", "en", "a", 9, *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    out = STAGES[name](docs, labels, items)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()} and out.count() > 0

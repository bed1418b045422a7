import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, bits string, size long, term string, frame string"


def make(spark, rows):
    """(doc_id, text, lang, source) rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 7, "x", 3, "y", "z") for i, t, lang, s in rows], SCHEMA)


LONG = " ".join(f"word{i % 997}" for i in range(60_000)) + " " + "x" * 50_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, other white space and marks."""
    rows = [
        (1, "the quick brown fox is released under the mit license", "en", "a"),
        (1, "the quick brown fox is released under the mit license", "en", "a"),
        (2, "the quick brown fox is released under the mit license", "en", None),
        (None, "the dog and the cat", "en", "a"),
        (None, None, None, None),
        (3, None, "de", "b"),
        (4, "", "de", "b"),
        (5, " \t\n\x0b\f\r ", None, "b"),
        (6, LONG, "en", "c"),
        (7, "!!! ??? ...", None, "c"),
        (8, "Ünïcödé İstanbul ΣΑΣ 　 漢字 🚨 <|endoftext|> it's", "fr", "é"),
        (9, "CC BY CC BY CC BY", "en", ""),
        (10, "a", "en", "c"),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()

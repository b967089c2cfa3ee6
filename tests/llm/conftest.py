import os

import pytest

from sessionloom.llm.common import prepare

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def session(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def table(session):
    """A table of documents from (doc_id, text, source) rows, with columns whose names the operators use inside."""

    def make(rows, clashing=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
        df = session.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "1 as digest", "2 as rank", "3 as size", "4 as words", "5 as item", "6 as rep", "7 as place", "8 as taken", "9 as digest_of_text", "10 as copy_no") if clashing else df

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, a repeated id with another text, very long texts, odd characters."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"),
        (6, "one  two three\nfour five six"), (None, "a text without an id, long enough to be cut and to be looked at " * 3), (7, long_text), (8, long_text + " tail"),
        (9, "x" * 150_000), (10, "日本語 🙂 é \x00 ß Ω" * 5, None), (11, "same id, first text", "b"), (11, "same id, second text", "b"), (12, "<|endoftext|> | !!! ...", None),
    ]


@pytest.fixture(scope="session")
def small_docs(session):
    return session.read.parquet(os.path.join(SMALL, "documents.parquet"))


@pytest.fixture(scope="session")
def larger_docs(session):
    return session.read.parquet(os.path.join(LARGER, "documents.parquet"))

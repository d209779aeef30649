import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns that clash by name."""
    long_text = "one two three four five six seven eight nine ten " * 4000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", "x", "y"),
        (2, "alpha beta gamma  delta epsilon zeta eta theta iota kappa", "en", "a", "x", "y"),
        (3, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa", None, None, None, None),
        (4, "", "en", "a", "x", "y"),
        (5, None, "en", "a", "x", "y"),
        (None, "text of a row without an id, and some more words to pass", "en", "a", "x", "y"),
        (7, long_text, "en", "b", "x", "y"),
        (8, long_text + "tail", "en", "b", "x", "y"),
        (9, "x" * 50_000, "en", "b", "x", "y"),
        (10, "mail bob@mail.example.com token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" now", "en", "b", "x", "y"),
        (10, "mail bob@mail.example.com token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" now", "en", "b", "x", "y"),
        (11, "two words", "en", "b", "x", "y"),
        (12, "Two  words", "en", "b", "x", "y"),
        (13, " \t\n\x0b\x0c\r ", "en", "b", "x", "y"),
        (14, "café 日本語 \U0001f600 <|endoftext|> don't we'll   end ", "en", "b", "x", "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, n string")

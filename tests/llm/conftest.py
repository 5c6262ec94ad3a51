"""Small tables with every odd case."""

from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"
CLASHING = ["hash", "node", "a.b", "epoch", "block", "__hash", "__key", "__same", "__start", "__id", "__t", "__n", "__lost", "__s", "__row", "n", "k0", "start", "id", "t", "h", "v0", "l", "i", "lit", "K"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in CLASHING)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns."""
    long = "the cat sat on the mat and looked at the moon " * 20_000
    rows = [
        (1, "A plain text of some words about nothing much at all, in the end.", "en", "s1"), (1, "A plain text of some words about nothing much at all, in the end.", "en", "s1"),
        (2, None, "en", "s1"), (3, "", "en", None), (4, "   \n ", None, "s2"), (None, "A text without a number that is found nowhere else in here.", "en", "s1"), (5, long, "en", "s2"), (6, long + "end", "en", "s2"),
        (7, "!!! ??? ...", "en", "s1"), (8, "Un texte court en langue française, pour voir.", "fr", "s3"), (9, "Un texte court en langue française, pour voir.", "fr", "s3"), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, None, *("x" + x for x in CLASHING)) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

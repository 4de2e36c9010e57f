"""Fixture tables for the training-data operators."""

from __future__ import annotations

import pytest

AWKWARD = [
    (1, "the cat sat on the mat and looked at the dog all day long", "en", "a", 57),
    (2, "the cat sat on the mat and looked at the dog all day long", "en", "a", 57),
    (2, "the cat sat on the mat and looked at the dog all day long", "en", "a", 57),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \t\n ", None, "b", 4),
    (6, "word", "en", "b", 4),
    (None, "a text without an id", "en", "b", 20),
    (7, "tab\tand no break, été 中文 \U0001f600 \x1c end", "fr", "c", 30),
    (8, "long " * 30000, "en", "c", 150000),
]


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table, with columns of clashing names on request."""

    def make(rows=AWKWARD, clash=()):
        df = spark.createDataFrame(list(rows), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        for name in clash:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def saved(tmp_path_factory):
    """Write tables below a folder of their own, as the queries read them."""

    def save(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return save

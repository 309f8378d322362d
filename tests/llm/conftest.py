from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and long texts, repeated rows, ties, several scripts.
ODD = [
    (1, None, None, "s", 1), (None, "abc def, the longer line here", "en", "s", None), (1, None, None, "s", 1), (2, "x y " * 3000, "en", None, None),
    (2, "x y " * 3000, "en", None, None), (3, "", "en", "s", 0), (4, "naïve 漢字 text\n\nwith lines", "fr", "s", 1), (5, "a", "en", "s", 1),
    (6, "12 34", "de", "s", 1), (7, "ABC DEF, the longer line here", None, "s", 1), (8, "\t \n", "en", "s", 3), (9, "z" * 5000, "es", "s", 5000)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()

"""Rows and a fixture shared by the tests of the training-data operators."""

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Documents with extra columns whose names clash with those the operators make.
DOCS = "doc_id long, text string, lang string, source string, n_words string, w string, hashes int, spans string, `_text` string"
ODD = [(None, None), (None, "a b"), (7, ""), (7, ""), (8, " \t\n\x0b "), (9, None), (10, "Été naïve \U0001f600 \x1c x")]


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text[, lang[, source]])."""
    def build(rows):
        full = [(*row, *("en", "s")[len(row) - 2 :], "x", "x", 1, "x", "x") for row in rows]
        return spark.createDataFrame(full, DOCS)

    return build

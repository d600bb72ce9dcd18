"""Small tables with the awkward rows that every operator must survive."""

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and a clashing extra column."""
    rows = [
        (None, None, None, None, "x"),
        (1, None, "en", "a", "x"),
        (2, "", None, "a", None),
        (3, "word " * 60_000, "en", "a", "x"),
        (4, "The same text twice, word for word.", "en", "b", "x"),
        (4, "The same text twice, word for word.", "en", "b", "x"),
        (5, "The same text twice, word for word.", None, "b", "x"),
        (6, " \n\t \n", "fr", None, "x"),
        (None, "An id is missing here but the words are not.", "en", "b", "x"),
        (7, "É\x00 \U0001f600 <|endoftext|> 'll   tab\tend\n\n", "fr", "c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bits string")

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and blank texts, a very long one, ties, repeated rows and a clashing extra column."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "a", 4),
        (5, "Éa été ça " * 30, "fr", "b", 300),
        (5, "Éa été ça " * 30, "fr", "b", 300),
        (None, "a row without an id", "en", "a", 19),
        (6, "word " * 40_000, "en", "a", 200_000),
        (7, "\x00\ud7ff𝄞 tail", "en", "a", 8),
        (8, "one two three four five six seven", "en", "a", 33),
    ]
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], DOCS + ", shard int, failure_bits string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)

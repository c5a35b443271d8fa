import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A null, an empty text, blanks, one word, a repeated row, equal texts under other ids, a null id, and a very long text.
EDGES = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 5), (4, "word", "en", "b", 4), (4, "word", "en", "b", 4), (5, "word", "de", "b", 4),
    (None, "one two three four five six", "fr", "a", 27), (7, "one two three four five six", None, "a", 27), (8, "long " * 50_000, "en", "b", 250_000),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

import pytest

#: Rows with nulls, empty texts, ties, repeated rows, a long text and a column whose name an operator may use.
COMMON = "The quick brown fox jumps over the lazy dog while seven wizards quietly boil water for tea in the yard"
EDGE = [
    (1, COMMON + " and then they sleep", "en", "a", 3, "x"),
    (2, None, "en", "a", 4, "x"),
    (3, "", None, None, None, None),
    (4, "  \n\t ", "de", "b", 5, "x"),
    (5, "One", "de", "b", 1, "y"),
    (6, COMMON + " and then they sleep", "en", "a", 3, "x"),
    (7, "Released under the MIT License. " + COMMON.upper(), "en", None, 9, "x"),
    (None, COMMON, "en", "c", 1, "x"),
    (8, "wörter größer é " * 3000, "de", "hot", 1, "x"),
    (9, "one two three", "es", "hot", 1, "x"),
    (9, "one two three", "es", "hot", 1, "x"),
    (10, "prefix words here " + COMMON, "en", "hot", 1, "x"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, {} string"


@pytest.fixture(scope="session")
def edge(spark):
    """A function from the name of a clashing column to the edge rows."""
    return lambda name="score": spark.createDataFrame(EDGE, COLUMNS.format(name)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS.format("score"))

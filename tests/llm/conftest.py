import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nAnd then it sleeps for a while.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog.\nAnd then it sleeps for a while.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog.\nAnd then it sleeps for a while.", "en", "a", 10),
    (3, "The  quick brown fox jumps over the lazy dog. And then it sleeps for a while. ", None, "b", None),
    (4, "", "en", "a", 0),
    (5, None, "en", None, None),
    (6, " \n\t ", "en", "a", 4),
    (None, "A text without an id.", "en", "a", 1),
    (7, "I've <|endoftext|> İSTANBUL'S café 日本語 ½ ﬁ 🤖 ẹ́ x\x1cy J̌ ΟΔΟΣ", "xx", "c", 1),
    (8, "word " * 6000, "en", "a", 1),
    (9, "z" * 5000, "en", "a", 1),
    (10, "one two three\n\none two three\n\none two three", "en", "a", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["d", "r", "h", "fp", "node", "key", "keys", "salt", "sha", "norm", "n", "start", "component", "component_id", "keep", "copy", "y", "__s", "__u", "__m", "n_removed", "removed_words"]
    return docs.select("*", *[F.lit("x").alias(c) for c in names])

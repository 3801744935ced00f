import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    base = "the quick brown fox jumps over the lazy dog while seven grey geese look on from the old stone bridge at noon"
    rows = [
        (1, base, "en", "a", 3), (2, base, "en", None, 3), (2, base, "en", None, 3), (3, None, None, "b", None), (4, "", "en", "b", 0), (5, " \n\t", None, None, 1),
        (6, base + " today", None, "a", 9), (7, "word " * 30_000, "en", "a", 150_000), (8, "12 34 !!", "de", "c", 8), (9, "é", "fr", "c", 1), (10, base.upper(), "en", "a", 3),
        (None, base, "en", "a", 3), (11, "eins zwei drei vier fünf sechs sieben acht", "de", "c", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = ["h", "n", "fp", "id", "word", "words", "mark", "row", "topic", "weight", "p", "block", "held_out", "score", "component", "mix_p", "row_id"]
    for c in clash:
        from pyspark.sql import functions as F

        docs = docs.withColumn(c, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

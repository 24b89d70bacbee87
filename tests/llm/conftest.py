import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 701}{'x' * (i % 5)}" for i in range(9000))

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("_m", T.StringType()), T.StructField("n_words", T.IntegerType()),
])


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "yes", "m", 1)


@pytest.fixture
def documents(spark):
    """Makes a documents table, with further columns whose names clash with results, from (doc_id, text, ...) rows."""
    return lambda rows: spark.createDataFrame([document(*r) for r in rows], DOCUMENTS)


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (None, LONG), (None, None), (6, "é" * 3000, None, None),
        (7, "one two three", "en", None), (8, "one two three", None, "b"), (9, "  x\u0085y", "", ""), (10, "a b c d e"), (11, "A B C D E"),
    ]

import pytest
from pyspark.sql import types as T

#: Names that the operators use themselves.
CLASH = ["node", "key", "host", "keys", "own", "score", "row", "text_hash", "n_lines", "topic", "kept", "factor", "part"]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
COPY = "one two three four five six seven eight nine ten eleven twelve\nthe end of it"
ODD = [
    (1, COPY, "en", "a"), (2, COPY, "en", "a"), (2, COPY, "en", "a"), (3, COPY + " now", None, "b"), (4, None, "en", None),
    (5, "", "de", "a"), (6, " \n\t ", "de", "a"), (7, "word", "en", "b"), (8, "Word", "en", "b"), (9, LONG, "en", "a"),
    (None, COPY, "en", "a"), (None, None, None, None), (12, "b c", "xx", "b"), (12, "other text here", "xx", "b"),
    (13, "É ñ ß 漢字 😀 <|endoftext|> don't", "fr", "c"), (14, "x" * 5000, "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns named like the operators' own."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
              T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
              T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]]
    rows = [(*r, None if r[1] is None else len(r[1]), *(["keep"] * len(CLASH))) for r in ODD]
    return spark.createDataFrame(rows, T.StructType(fields)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

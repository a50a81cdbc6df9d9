import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.", "a"),
    (2, "", "a"),
    (3, None, "b"),
    (4, "  \t\n ", None),
    (5, LONG, "a"),
    (6, "naïve café 漢字 😀 mail a@b.co", "b"),
    (6, "naïve café 漢字 😀 mail a@b.co", "b"),
    (7, "The quick brown fox jumps over the lazy dog.", "c"),
    (None, "id is null", "a"),
    (None, None, None),
]

#: Columns whose names the operators use themselves.
CLASHES = ("uid", "level", "sequence_id", "offset", "key", "fp", "spans", "kept", "size", "rank", "grp", "open", "source_size")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and clashing extra columns."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in CLASHES]
    )
    return spark.createDataFrame([(*row, *[None] * len(CLASHES)) for row in TEXTS], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

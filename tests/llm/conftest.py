import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
# names that operators use inside, as further columns
CLASHING = ("key", "doc", "fp", "n", "sig", "words", "ids", "bytes", "line", "gone", "score", "task", "x", "y", "h", "root", "component_id", "n_hit")


@pytest.fixture
def documents(spark):
    """(id, text) pairs -> a table like documents; ``clashing`` adds columns whose names operators use inside."""

    def make(rows, clashing=False):
        df = spark.createDataFrame([(d, t, "en", None, None if t is None else len(t)) for d, t in rows], DOCS)
        if clashing:
            df = df.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASHING])
        return df

    return make


@pytest.fixture(scope="session")
def small(spark):
    """(id, text) of the smallest table of documents."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]

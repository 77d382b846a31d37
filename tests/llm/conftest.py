import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tariffscope.llm.common import importable

#: A table with a column that clashes with what operators add, and one they never read.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("n_words", T.StringType()), T.StructField("row", T.StringType()), T.StructField("body", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark: SparkSession):
    """Frame of documents from texts, or (doc_id, text) or (doc_id, text, lang) tuples."""
    importable(spark)

    def build(rows):
        full = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "x", None, 7) for r in full], SCHEMA).repartition(3)

    return build


@pytest.fixture
def by_id():
    """Rows of a frame as dictionaries by document, sorted when an id repeats."""

    def collect(df):
        found = {}
        for row in df.collect():
            found.setdefault(row["doc_id"], []).append(row.asDict())
        return found

    return collect


@pytest.fixture
def sample_docs(spark, sample):
    importable(spark)
    return spark.read.parquet(f"{sample}/documents.parquet")


import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """``make_docs([(doc_id, text), ...])``: a frame with the columns of documents."""
    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], DOC)
    return make


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    """[(doc_id, text)] of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

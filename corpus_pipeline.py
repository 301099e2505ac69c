"""A training corpus from raw documents: the stages in order.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that go on to
the next one, which reads them back from Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, near_dedup, packing, quality_rules, secret_scan
from corpusmill.llm.common import table
from corpusmill.llm.queries import tokenizer_path, trusted_documents
from corpusmill.session import checkpoint_dir


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    return quality_rules.keep_good(docs, trusted_documents(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component."""
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars`` follows the new text."""
    return secret_scan.redact(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return packing.pack(packing.tokenized_pieces(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", keep_good_documents),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

# Sketches, permutations of hash values and packing have no SQL form; the tests
# hold the pipeline against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage is written as Parquet in the
    shared checkpoint folder and read again by the next.  A stage's folder is deleted
    once the next one is written; that of the last holds the result and stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs

"""Helpers shared by the operators of this subpackage.

Words are runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``).
``bytes.split()`` and ``bytes.lower()`` implement exactly that rule and the
lower-casing of A-Z only, so texts travel to Python as UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import reliable_checkpoint, ship_package

SHINGLE_WORDS = 5

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(df: DataFrame) -> DataFrame:
    """Make the package importable in the Python workers of ``df``'s session."""
    ship_package(df.sparkSession)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    return reliable_checkpoint(df)


def cut_anew(df: DataFrame) -> DataFrame:
    """``cut``, and Spark's size estimate of the result starts anew from its default.

    A checkpoint keeps the estimate of the plan it replaces, and a join multiplies those of its two sides.
    In a loop that joins what it has cut before, the number of digits grows by a factor in every round, up to
    single numbers that fill the driver's memory.  Rows, partitioning and order are those of ``cut``.
    """
    done = cut(df)
    jvm, query = df.sparkSession._jvm, done._jdf.queryExecution()
    plan, session = query.analyzed(), done._jdf.sparkSession()
    anew = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        session, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, anew), df.sparkSession)


def word_hashes(words: list) -> np.ndarray:
    """64-bit hash of each word (bytes)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their order is that of a random hash."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in text order."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, np.uint64(n))
    for i in range(n):
        acc = acc * _MUL + hashes[i:i + m]
    return mix(acc)


def shingles(text: bytes | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a lower-cased text;
    a text of fewer words is one shingle, a text without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(n, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def local_rank(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df``, the result of ``cut``, with a column ``out``: the 0-based, gapless rank of each row among the rows with the same ``keys``.

    Works in two passes over the checkpoint, so that a key holding most rows is
    never gathered in one task: rows are counted per (partition, key), the
    counts are summed up over the partitions, and each row adds its rank within
    its own partition.  Inside a partition rows follow ``order``.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_pid", F.spark_partition_id())
    counts = rows.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and key
    base = counts.select("_pid", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_pid", *keys).orderBy(*order)
    return (rows.withColumn("_r", F.row_number().over(within))
            .join(base, ["_pid", *keys])
            .withColumn(out, F.col("_base") + F.col("_r") - 1)
            .drop("_pid", "_base", "_r"))

"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default bound of ``broadcast_if_small``.
BROADCAST_BYTES = 32 << 20


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Make heavy per-row work (splitting and tokenising long texts) use the
    whole cluster.

    A scan yields one task per file split / row group; a table written as a
    few large row groups would leave most cores idle until the first
    shuffle.  When the input has fewer partitions than ``factor`` x the
    default parallelism, rows are redistributed round-robin (deterministic
    on retry: Spark sorts before a round-robin repartition).  An input
    already split finer, as any large table is, is returned unchanged - no
    shuffle is added at scale."""
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size (the text length of
    all its values, plus 16 bytes each) is at most ``limit``; beyond it ``df``
    itself, to be joined by a shuffle.  The rows of the join are the same."""
    value = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    size = df.agg(F.sum(value.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df

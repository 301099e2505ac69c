"""Exact, consecutive global row indices without a single-partition window.

Two passes over identical partitions:

1. per-partition row counts (one small row per partition),
2. prefix sums of those counts give each partition's offset; the offsets
   table (size = number of partitions, never data-sized) is broadcast back
   and ``idx = offset + position inside the partition``.

The position inside a partition is ``monotonically_increasing_id() -
(partition_id << 33)``.  Both passes must see the same partitions in the same
order, so the input is first put in its final order (range sort) and cut with
a reliable checkpoint; recomputation after an executor loss then re-reads the
checkpoint instead of re-sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import reliable_checkpoint

_SHIFT = 1 << 33


def _offsets(counts: DataFrame, part_cols, start: int) -> DataFrame:
    # one row per partition (or file split): bounded by the partition count
    w = Window.orderBy(*part_cols).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)) + F.lit(start))


def global_index(df: DataFrame, order_by, col: str = "idx", start: int = 0,
                 checkpoint: bool = True) -> DataFrame:
    """Add ``col`` = 0-based (or ``start``-based) position of each row in the
    order of ``order_by`` (which must be a total order: add an id to break
    ties).  Sort = one range shuffle; then two passes over the checkpoint."""
    order_by = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    s = df.orderBy(*order_by)
    if checkpoint:
        s = reliable_checkpoint(s)
    s = s.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offs = _offsets(counts, ["__pid"], start).select("__pid", "__off")
    return (s.join(F.broadcast(offs), "__pid")
             .withColumn(col, (F.col("__off") + F.col("__mid") - F.col("__pid") * F.lit(_SHIFT)).cast("bigint"))
             .drop("__pid", "__mid", "__off"))


def file_order_index(df: DataFrame, col: str = "row", start: int = 0) -> DataFrame:
    """Row number in *file order* (file path, then byte offset, then line) of
    a file scan (CSV, JSON lines, text, Parquet), without sorting the data.

    Uses the hidden ``_metadata`` columns of file sources: rows are counted
    per file split (one small row per split) and each split's offset is the
    prefix sum over splits ordered by (file_path, file_block_start).  The scan
    is deterministic, so both passes see the same rows.  ``df`` must be the
    file scan itself (before any shuffle)."""
    s = (df.withColumn("__file", F.col("_metadata.file_path"))
           .withColumn("__block", F.col("_metadata.file_block_start"))
           .withColumn("__mid", F.monotonically_increasing_id()))
    counts = s.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"),
                                                F.min("__mid").alias("__first"))
    offs = _offsets(counts, ["__file", "__block"], start).select("__file", "__block", "__off", "__first")
    return (s.join(F.broadcast(offs), ["__file", "__block"])
             .withColumn(col, (F.col("__off") + F.col("__mid") - F.col("__first")).cast("bigint"))
             .drop("__file", "__block", "__mid", "__off", "__first"))


def chunk(df: DataFrame, idx: str, size: int, chunk_col: str, slot_col: str | None = None) -> DataFrame:
    """``chunk = idx div size`` (and ``slot = idx mod size``): fixed-size shards,
    parts and batches; the last one partial."""
    if size < 1:
        raise ValueError("size must be >= 1")
    out = df.withColumn(chunk_col, (F.col(idx) / F.lit(size)).cast("bigint"))
    if slot_col:
        out = out.withColumn(slot_col, F.pmod(F.col(idx), F.lit(size)).cast("bigint"))
    return out


def prefix_sum(df: DataFrame, order_by, values, outs, checkpoint: bool = True) -> DataFrame:
    """Running sums of ``values`` in the total order ``order_by`` (inclusive),
    exact and without a single-partition window: sort, checkpoint, per-
    partition totals (one small row per partition) prefix-summed into
    offsets, then a running sum inside each partition."""
    order_by = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    values = [values] if isinstance(values, str) else list(values)
    outs = [outs] if isinstance(outs, str) else list(outs)
    s = df.orderBy(*order_by)
    if checkpoint:
        s = reliable_checkpoint(s)
    s = s.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    tot = s.groupBy("__pid").agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(values)])
    w0 = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__pid", *[F.coalesce(F.sum(f"__t{i}").over(w0), F.lit(0)).alias(f"__o{i}")
                                 for i in range(len(values))])
    w = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(F.broadcast(offs), "__pid")
    for i, (v, o) in enumerate(zip(values, outs)):
        out = out.withColumn(o, F.col(f"__o{i}") + F.sum(v).over(w))
    return out.drop("__pid", "__mid", *[f"__o{i}" for i in range(len(values))])

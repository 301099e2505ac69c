"""Seeded caption draw, seeded shuffle, fixed-size batches.

All randomness is a hash of (key, seed, epoch), so a task recomputed after an
executor loss draws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import hashing as H
from corpusmill.operators.indexing import chunk, global_index


def random_caption(pool, key, seed: int = 0, epoch: int = 0) -> Column:
    """One caption drawn uniformly from the pool (null for an empty pool)."""
    p = F.col(pool) if isinstance(pool, str) else pool
    i = H.draw_index(F.size(p), key, seed, epoch)
    return F.when(F.size(p) > 0, F.get(p, i.cast("int")))


def random_caption_index(pool, key, seed: int = 0, epoch: int = 0) -> Column:
    p = F.col(pool) if isinstance(pool, str) else pool
    return F.when(F.size(p) > 0, H.draw_index(F.size(p), key, seed, epoch))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 0, epoch: int = 0,
                   num_partitions: int | None = None, hash_kind: str = "xxhash64") -> DataFrame:
    """Full seeded shuffle: range-partition on h = xxhash64(key, seed,
    epoch) (or the md5 draw other engines reproduce) and sort inside
    partitions, so partition order followed by row order is the shuffled
    order.  The number of partitions is the session's unless given.  Adds the
    column ``shuffle_h``."""
    hv = (H.shuffle_hash(key, seed, epoch) if hash_kind == "xxhash64"
          else H.md5_u32(key, F.lit(seed), F.lit(epoch)))
    h = df.withColumn("shuffle_h", hv)
    ranged = (h.repartitionByRange(num_partitions, "shuffle_h", key) if num_partitions
              else h.repartitionByRange("shuffle_h", key))
    return ranged.sortWithinPartitions("shuffle_h", key)


def batches(df: DataFrame, key: str, batch_size: int, seed: int = 0, epoch: int = 0,
            hash_kind: str = "xxhash64") -> DataFrame:
    """Fixed-size batches of the seeded shuffle: ``idx`` (0-based
    position in the shuffled order), ``batch_id = idx div B``, ``slot = idx
    mod B``; the last batch may be partial.  ``hash_kind="md5"`` gives an
    order that other engines can reproduce."""
    hv = (H.shuffle_hash(key, seed, epoch) if hash_kind == "xxhash64"
          else H.md5_u32(key, F.lit(seed), F.lit(epoch)))
    h = df.withColumn("shuffle_h", hv)
    indexed = global_index(h, ["shuffle_h", key], col="idx")
    return chunk(indexed, "idx", batch_size, "batch_id", "slot")

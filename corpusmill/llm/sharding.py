"""Weighted rendezvous sharding of stable record keys.

Every shard draws a number from the record key and its own name; the record goes
to the shard with the best draw.  With ``u`` the hash of (key, shard) mapped into
(0, 1), the draw is ``-ln(u) / weight`` and the smallest wins, which gives each
shard a share in proportion to its weight.  A draw depends on nothing but the key
and the shard, so a new shard takes over only the records it wins itself and no
record moves between old shards; the share that moves is the new shard's weight
over the total.

Cases: a null key is a key of its own, so its records share a shard.  Rows with
the same key go to the same shard, each with a slot of its own.  A null text has
size 1 (no bytes, plus 1) and checksum 0.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, local_rank

SHARDS = 8


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 ...) with the best draw for ``key``."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def draw(shard: int, weight: float) -> Column:
        # 53 bits of the hash, moved off 0
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / weight).alias("draw"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[draw(i, w) for i, w in enumerate(weights)]))["shard"]


def assign(docs: DataFrame, weights: list[float], key_col: str = "doc_id", text_col: str = "text",
           new_weight: float | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard``: the shard of every
    record, its place in it, and its shard once one more of ``new_weight`` (by
    default the mean weight) is there."""
    if not weights or min(weights) <= 0:
        raise ValueError("every weight must be positive")
    key, text = F.col(key_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    grown = [*weights, new_weight or sum(weights) / len(weights)]
    # only these narrow rows are checkpointed and shuffled, never the texts
    rows = cut(docs.select(
        key.alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard")))
    return local_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], key_col: str = "doc_id",
                 column: str = "shard") -> None:
    """Write ``docs`` to one folder per shard below ``path``.  The shards split a
    hot key range evenly, and a task writes one file per shard it holds."""
    docs.withColumn(column, rendezvous(F.col(key_col), weights)).write.partitionBy(column).parquet(path)

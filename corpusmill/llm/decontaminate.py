"""Benchmark decontamination: short test items inside long documents.

Containment of an item is the share of its five-word shingles that a document
has, anywhere in its text.  Search by size-partitioned MinHash:

* Items are partitioned by set size (powers of two).  An item keeps its ``k``
  smallest shingle hashes, all of them if it has no more.  The largest value kept
  in a partition is the partition's cutoff.
* A document's signature for a partition is its hashes up to that cutoff, however
  long the document is.  If it contains a share t of an item, each value the item
  kept is in the signature with probability t, so ``need`` shared values are asked
  for: all that t demands if the item kept its whole set, else 3 of 16 (a chance
  of 2e-8 to miss at t = 0.8).
* A bitmap of fixed size over the items' kept values drops the other hashes of a
  document before anything is shuffled; it has no false negatives.
* Candidates are verified by exact shingle containment on the full texts.

Cases: a null or blank text has no shingles, neither contains nor is found.  A
text of one to four words is one shingle of all its words, so an item that short is
not found in longer documents (the oracle SQL has the same rule).  Repeated items are
reported each by their id; repeated documents once per different text.  A null
document id is reported as null.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, mix, ready, shingles, signed

KEPT = 16              # values kept per item
NEED = 3               # of them, how many a containing document must show
FILTER_BITS = 1 << 24  # bits of the bitmap: 2 MB


def _item_signatures(batches, k, percent):
    for rb in batches:
        rows = []
        for item, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            s = shingles(text)
            if len(s):
                need = -(-percent * len(s) // 100) if len(s) <= k else NEED
                rows.append((item, len(s).bit_length(), need, signed(s[:k]).tolist()))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], rb.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
             pa.array(cols[3], pa.list_(pa.int64()))], ["item_id", "part", "need", "kept"])


def _position(values: np.ndarray, part, bits: int) -> np.ndarray:
    return mix(values + np.asarray(part, np.uint64)) & np.uint64(bits - 1)


def _positions(batches, bits):
    for rb in batches:
        values, parts = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        pos = _position(values.astype(np.int64).view(np.uint64), parts.astype(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int64) + 1)], ["pos"])


def _document_hits(batches, cutoffs, bitmap, bits):
    """Documents with at least one hash that the bitmap knows, and those hashes."""
    known = np.frombuffer(bitmap.value, np.uint8)
    for rb in batches:
        keep, parts, values = [], [], []
        for i, text in enumerate(rb.column(1).to_pylist()):
            s = shingles(text)
            ps, vs = [], []
            for part, cutoff in cutoffs:
                sig = s[:np.searchsorted(s, cutoff, "right")]
                at = _position(sig, part, bits)
                hit = sig[(known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                vs += signed(hit).tolist()
                ps += [part] * len(hit)
            if vs:
                keep.append(i)
                parts.append(ps)
                values.append(vs)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rb.column(0).take(at), rb.column(1).take(at), pa.array(parts, pa.list_(pa.int32())),
             pa.array(values, pa.list_(pa.int64()))], ["doc_id", "text", "parts", "vals"])


def _contained(batches, percent):
    """Rows ``doc_id, item_id, text_key, text, item`` whose item is contained in the text."""
    last, last_set = None, None
    for rb in batches:
        keep, sizes, found = [], [], []
        for i, (text, item) in enumerate(zip(rb.column(3).to_pylist(), rb.column(4).to_pylist())):
            if text != last:
                last, last_set = text, shingles(text)
            s = shingles(item)
            n = len(np.intersect1d(s, last_set, assume_unique=True))
            if 100 * n >= percent * len(s):
                keep.append(i)
                sizes.append(len(s))
                found.append(n)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([rb.column(0).take(at), rb.column(1).take(at), rb.column(2).take(at),
                                          pa.array(sizes, pa.int64()), pa.array(found, pa.int64())],
                                         ["doc_id", "item_id", "text_key", "n_item", "n_found"])


def _bitmap(index: DataFrame, bits: int) -> bytes:
    """The bitmap of the kept values: at most ``bits / 8`` bytes, whatever the
    number of items.  Spark builds it in blocks of 4 KB."""
    pos = index.select("v", "part").mapInArrow(lambda it: _positions(it, bits), "pos bigint")
    blocks = (pos.groupBy(F.bitmap_bucket_number("pos").alias("block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("set")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for block, part in blocks:  # 1-based blocks of 32768 bits
        at = (block - 1) * 4096
        out[at:at + 4096] = np.frombuffer(bytes(part), np.uint8)[:len(out) - at]
    return out.tobytes()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", percent: int = 80,
                 k: int = KEPT, bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, text_key, item_id, n_item, n_found`` for each document that has at
    least ``percent`` of an item's shingles; ``text_key`` is the hash of its text."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    tests = ready(items).select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("item"))
    signatures = cut(tests.mapInArrow(lambda it: _item_signatures(it, k, percent),
                                      f"item_id {item_type}, part int, need int, kept array<bigint>"))
    index = signatures.select("item_id", "part", "need", F.explode("kept").alias("v"))
    # one row per size partition (at most 64); hashes are unsigned, so the order flips the sign bit
    flip = F.col("v").bitwiseXOR(F.lit(-(1 << 63)))
    tops = index.groupBy("part").agg(F.max(flip).alias("top")).collect()
    cutoffs = [(r["part"], np.uint64((r["top"] ^ (-1 << 63)) & (2**64 - 1))) for r in tops]
    known = docs.sparkSession.sparkContext.broadcast(_bitmap(index, bits))

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    hits = cut(src.mapInArrow(lambda it: _document_hits(it, cutoffs, known, bits),
                              f"doc_id {id_type}, text binary, parts array<int>, vals array<bigint>")
               ).withColumn("row", F.monotonically_increasing_id())
    pairs = hits.select("row", F.explode(F.arrays_zip("parts", "vals")).alias("e"))
    cand = (pairs.select("row", F.col("e.parts").alias("part"), F.col("e.vals").alias("v"))
            .join(index, ["part", "v"]).groupBy("row", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
            .filter("n >= need").select("row", "item_id"))
    full = (hits.select("row", "doc_id", "text").join(cand, "row").join(tests, "item_id")
            .select("doc_id", "item_id", F.xxhash64("text").alias("text_key"), "text", "item"))
    found = full.mapInArrow(
        lambda it: _contained(it, percent),
        f"doc_id {id_type}, item_id {item_type}, text_key bigint, n_item bigint, n_found bigint")
    return found.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns.  Rows are
    matched by id and text, so a null or repeated id takes no clean row with it."""
    bad = contaminated(docs, items, id_col, text_col, percent=percent).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"])
                     & (F.xxhash64(docs[text_col]) == bad["_bad_key"]), "left_anti")

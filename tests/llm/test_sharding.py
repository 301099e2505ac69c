"""Sharding: stability, shares by weight, gapless slots."""
import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import sharding as H


def restated(key, weights):
    def draw(shard, weight):
        h = xxhash.xxh64_intdigest((key if key is not None else "\0null").encode(), 42)
        # Spark hashes an int as 4 bytes, seeded with the hash so far
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), h)
        return -math.log(((h >> 11) + 0.5) / 2 ** 53) / weight
    return min(range(len(weights)), key=lambda s: draw(s, weights[s]))


def test_assignment(make_docs):
    rows = [(i, f"text {i % 7}") for i in range(700)] + [(5, None), (5, "again"), (None, "é"), (None, None), (8, "")]
    docs = make_docs(rows).selectExpr("*", "1 as shard", "2 as slot")
    got = H.assign(docs, [1.0] * 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        key = None if r.doc_id is None else str(r.doc_id)
        assert r.shard == restated(key, [1.0] * 8)
        assert r.grown_shard in (r.shard, 8) and r.grown_shard == restated(key, [1.0] * 9)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert H.assign(make_docs([]), [1.0]).count() == 0


def test_weights(spark):
    ids = spark.range(40000)
    n = {r.s: r["count"] for r in ids.groupBy(H.rendezvous(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).count().collect()}
    assert [round(n[i] / 40000, 2) for i in range(3)] == [pytest.approx(x, abs=0.015) for x in (0.125, 0.25, 0.625)]
    moved = ids.filter(H.rendezvous(F.col("id"), [1.0] * 8) != H.rendezvous(F.col("id"), [1.0] * 9)).count()
    assert abs(moved / 40000 - 1 / 9) < 0.01


def test_bad_weights_and_files(spark, make_docs, tmp_path):
    with pytest.raises(ValueError):
        H.assign(make_docs([]), [1.0, 0.0])
    H.write_shards(make_docs([(i, "t") for i in range(50)]), str(tmp_path / "out"), [1.0, 1.0])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}

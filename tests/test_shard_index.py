"""A1: samples fetched by an index of their shards."""
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import shard_index as SI
from corpusmill.sources import shards as SH


def _tar(path, samples):
    with tarfile.open(path, "w") as tf:
        for key, members in samples:
            for ext, data in members:
                info = tarfile.TarInfo(f"{key}.{ext}")
                info.size = len(data)
                tf.addfile(info, io.BytesIO(data))


def _json(i):
    return json.dumps({"image": f"i{i}", "captions-pt": [f"c{i}"], "more": "é" * (i % 7)}, ensure_ascii=False).encode()


@pytest.fixture
def shards(tmp_path):
    """Three shards; samples without an image, without JSON, with both kinds of image, with a name too long for a plain header."""
    for s in range(3):
        rows = []
        for i in range(s * 40, s * 40 + 40):
            members = [("json", _json(i)), ("png", b"\x89PNG" + bytes([i]) * (i * 50))]
            if i % 10 == 3:
                members = members[:1]
            if i % 10 == 5:
                members = members[1:]
            if i % 10 == 7:
                members.append(("jpg", b"\xff\xd8" + bytes([i])))
            rows.append((f"s{i:04d}" + "x" * (150 if i % 10 == 9 else 0), members))
        _tar(tmp_path / f"{s:05d}.tar", rows)
    return str(tmp_path)


def _rows(df):
    return sorted((r.shard, r.key, None if r.img is None else bytes(r.img), r.json) for r in df.collect())


@pytest.mark.parametrize("split", [1 << 10, 128 << 20])
@pytest.mark.parametrize("images", [True, False])
def test_fetches_what_the_scan_reads(spark, shards, split, images):
    pattern = shards + "/{00000..00002}.tar"
    index = SI.write_index(spark, pattern, shards + "/index")
    got = SI.fetch(index, images, split)
    assert _rows(got) == _rows(SH.read_shards(spark, pattern, images))
    assert got.columns == SH.read_shards(spark, pattern, images).columns


def test_one_shard_is_many_tasks(spark, shards):
    index = SI.write_index(spark, shards + "/00002.tar", shards + "/index")
    got = SI.fetch(index, True, 16 << 10)
    assert got.rdd.getNumPartitions() >= 5
    parts = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 4


def test_reads_the_chosen_members_only(spark, shards):
    """The bytes of all other samples are destroyed; the chosen ones are read all the same."""
    path = shards + "/00001.tar"
    index = SI.write_index(spark, path, shards + "/index")
    chosen = index.filter(F.col("key").isin("s0044", "s0061"))
    want = _rows(SI.fetch(chosen))
    assert [r[1] for r in want] == ["s0044", "s0061"]
    keep = [(r.at, r.at + r["size"]) for r in chosen.collect()]
    data = bytearray(open(path, "rb").read())
    for i in range(len(data)):
        if not any(a <= i < b for a, b in keep):
            data[i] = 0
    open(path, "wb").write(data)
    assert _rows(SI.fetch(chosen)) == want
    wanted = spark.createDataFrame([("s0061",), ("s0061",), ("none",)], "key string")
    assert _rows(SI.fetch(index.join(wanted, "key", "left_semi"))) == want[1:]


def test_index_is_from_headers_and_follows_new_shards(spark, shards):
    dst = shards + "/index"
    assert SI.write_index(spark, shards + "/00000.tar", dst).count() == 40
    before = set(os.listdir(dst))
    index = SI.write_index(spark, shards + "/{00000..00002}.tar", dst)
    assert index.count() == 120 and before <= set(os.listdir(dst))
    assert index.groupBy("shard").agg(F.max("pos").alias("m")).filter("m != 39").count() == 0
    assert SI.write_index(spark, shards + "/{00000..00002}.tar", dst).count() == 120


def test_a_changed_shard_fails(spark, shards):
    index = SI.write_index(spark, shards + "/00000.tar", shards + "/index")
    _tar(shards + "/00000.tar", [("other", [("json", b"{}")])])
    with pytest.raises(Exception, match="has changed since it was indexed"):
        SI.fetch(index).collect()


def test_empty_shard_and_empty_choice(spark, tmp_path):
    _tar(tmp_path / "e.tar", [])
    index = SI.write_index(spark, str(tmp_path / "e.tar"), str(tmp_path / "index"))
    assert index.count() == 0 and SI.fetch(index).count() == 0


def test_stream_goes_on_where_it_stopped(spark, shards):
    """Two shards, a stop, the third: every sample once."""
    dst, out = shards + "/index", shards + "/out"
    SI.write_index(spark, shards + "/{00000..00001}.tar", dst, shards_per_file=1)

    def run():
        q = (SI.stream_samples(spark, dst).select("shard", "key", "json").writeStream.format("parquet")
             .option("checkpointLocation", shards + "/ckpt").trigger(availableNow=True).start(out))
        q.awaitTermination()
        return [p for p in q.recentProgress if p["numInputRows"]]
    assert len(run()) == 2                       # one index file a batch
    assert not run()
    SI.write_index(spark, shards + "/{00000..00002}.tar", dst, shards_per_file=1)
    assert len(run()) == 1
    got = spark.read.parquet(out)
    assert got.count() == got.select("key").distinct().count() == 120
    want = SH.read_shards(spark, shards + "/{00000..00002}.tar", False)
    assert got.exceptAll(want.select("shard", "key", "json")).count() == 0

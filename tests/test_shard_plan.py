"""Planned shards: exact sizes, one order, resumed runs equal to uninterrupted ones."""
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import shard_plan as SP
from corpusmill.sources import shards as SH


def samples(spark, n):
    """Rows in no order, with an image on some; image bytes of either kind."""
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id")).repartition(5)
    img = F.when(F.col("id") % 3 == 0, F.concat(F.unhex(F.lit("FFD8")), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8"))) \
           .when(F.col("id") % 3 == 1, F.encode(F.lit("png"), "utf-8"))
    return df.select("id", F.format_string("k%04d", "id").alias("name"), F.to_json(F.struct(F.col("id").cast("string").alias("image"))).alias("json"),
                     img.alias("img"))


def tars(path):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(path).glob("*.tar"))}


@pytest.mark.parametrize("max_bounds", [SP.MAX_BOUNDS, 0])
@pytest.mark.parametrize("order_by", [["id"], ["name"], ["g", "id"]])
def test_pieces_are_those_of_the_row_number(spark, order_by, max_bounds):
    df = samples(spark, 103).withColumn("g", F.when(F.col("id") % 4 > 0, F.col("id") % 4))
    plan = SP.make_plan(df, order_by, 10)
    assert (plan.total, plan.pieces) == (103, 11)
    got = SP.in_pieces(SP.place(df, plan, without=[2, 5], max_bounds=max_bounds), plan).withColumn("p", F.spark_partition_id()).collect()
    key = lambda r: tuple((v is not None, v) for v in (r[c] for c in order_by))
    want = {r.id: i // 10 for i, r in enumerate(sorted(df.collect(), key=key))}
    assert {r.id: r.no for r in got} == {i: n for i, n in want.items() if n not in (2, 5)}
    assert all(r.p == r.no for r in got)


def test_shards_hold_every_sample_once(spark, tmp_path):
    path = str(tmp_path / "s")
    SP.write_planned(samples(spark, 57), path, "id", img_col="img", size=10, start_shard=3)
    assert list(tars(path)) == [f"{i:05d}.tar" for i in range(3, 9)]
    back = SH.read_shards(spark, path + "/{00003..00008}.tar").collect()
    assert sorted((r.key, int(r.sample.image)) for r in back) == [(f"sample{30 + i:05d}", i) for i in range(57)]
    want = {r.id: r.img for r in samples(spark, 57).collect()}
    assert all(r.img == want[int(r.sample.image)] for r in back)
    assert sorted((r.shard, r.samples, r.ok) for r in SP.check_shards(spark, path).collect()) == \
        [(s, 7 if s == 8 else 10, True) for s in range(3, 9)]
    # a damaged and a lost shard
    with open(f"{path}/00004.tar", "r+b") as f:
        f.write(b"?")
    (tmp_path / "s" / "00005.tar").rename(tmp_path / "lost.tar")
    assert {r.shard for r in SP.check_shards(spark, path).filter("not ok").collect()} == {4, 5}


def test_an_aborted_run_resumes_with_identical_shards(spark, tmp_path):
    whole, path = str(tmp_path / "whole"), str(tmp_path / "s")
    df = samples(spark, 95)
    SP.write_planned(df, whole, "name", img_col="img", size=10)
    # the first run may write six shards, the next loses a sample of shard 7 and fails there
    SP.write_planned(df, path, "name", img_col="img", size=10, only=range(0, 10, 2))
    assert list(tars(path)) == [f"{i:05d}.tar" for i in range(0, 10, 2)]
    before = {p: p.stat().st_mtime_ns for p in Path(path).glob("*.tar")}
    with pytest.raises(Exception, match="9 samples instead of the 10"):
        SP.write_planned(df.filter("id <> 75"), path, "name", img_col="img", size=10)
    assert "00007.tar" not in tars(path)
    assert not list(Path(path).glob("*7.json")) and 7 not in {r.shard for r in SP.read_ledger(spark, path).collect()}
    SP.write_planned(df, path, "name", img_col="img", size=10)
    assert tars(path) == tars(whole) and len(tars(path)) == 10
    assert {p: p.stat().st_mtime_ns for p in before} == before     # finished shards were not written again
    assert not [p for p in Path(path).iterdir() if "inprogress" in p.name and p.name.startswith(".0")]
    ledgers = [sorted(map(tuple, SP.read_ledger(spark, p).collect())) for p in (path, whole)]
    assert ledgers[0] == ledgers[1]
    SP.write_planned(df, path, "name", img_col="img", size=10)      # nothing left to do
    assert {p: p.stat().st_mtime_ns for p in before} == before
    with pytest.raises(ValueError, match="planned by"):
        SP.write_planned(df, path, "id", img_col="img", size=10)


def test_whole_rows_are_shuffled_once(spark):
    df = samples(spark, 50)
    plan = SP.make_plan(df.select("id"), "id", 10)
    text = SP.in_pieces(SP.place(df.select("id", "img"), plan), plan)._jdf.queryExecution().executedPlan().toString()
    # one for the pieces, one that the samples of this test have dealt themselves
    assert text.count("Exchange") == 2 and "rangepartitioning" not in text


def test_nothing_to_write(spark, tmp_path):
    path = str(tmp_path / "s")
    assert SP.write_planned(samples(spark, 9).limit(0), path, "id").pieces == 0
    assert tars(path) == {} and SP.check_shards(spark, path).count() == 0


def test_parts(spark, tmp_path):
    df = samples(spark, 45).withColumn("g", F.col("id") % 2)
    SP.write_parts(df.drop("img"), str(tmp_path / "p"), ["g", "id"], 20)
    back = spark.read.parquet(str(tmp_path / "p")).collect()
    order = sorted(range(45), key=lambda i: (i % 2, i))
    assert {r.id: r.part for r in back} == {i: n // 20 for n, i in enumerate(order)}
    assert all(json.loads(r.json)["image"] == str(r.id) for r in back)

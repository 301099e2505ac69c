"""Corpus construction quirks (B1-B14) and the exact global index."""
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus as CP
from corpusmill.operators.indexing import chunk, global_index


def test_positional_zip_stops_at_shortest_and_checks_sync(spark):
    orig = spark.createDataFrame([(0, 1, "a"), (1, 1, "b"), (2, 2, "c")], "pos long, image_id long, caption string")
    t1 = spark.createDataFrame([(0, 1, "x"), (1, 1, "y"), (2, 2, "z")], "pos long, image_id long, caption string")
    t2 = spark.createDataFrame([(0, " u "), (1, "v")], "pos long, caption string")
    z = CP.positional_zip(orig, t1, t2)
    assert z.count() == 2
    g = CP.group_captions(z).first()
    assert g.captions_en == ["a", "b"] and g.captions_pt == ["x", "u", "y", "v"]
    bad = spark.createDataFrame([(0, 9, "x")], "pos long, image_id long, caption string")
    with pytest.raises(Exception, match="Not synced"):
        CP.positional_zip(orig, bad, t2).collect()


def test_split_alias_and_single_caption(spark):
    rows = spark.createDataFrame([("validation", "f1", "c1"), ("train", "f2", "c2")], "split string, filename string, caption string")
    r = CP.select_split(rows, "val").collect()
    assert len(r) == 1 and r[0].captions_pt == ["c1"] and r[0].captions_en == []


def test_translator_slice(spark):
    df = spark.createDataFrame([(["m0", "g0", "m1", "g1"], ["only"])], "a array<string>, b array<string>")
    r = df.select(CP.translator_slice(F.array(), "a", "pt", "marian").alias("m"),
                  CP.translator_slice(F.array(), "a", "pt", "google").alias("g"),
                  CP.translator_slice(F.array(), "b", "pt", "google").alias("one")).first()
    assert r.m == ["m0", "m1"] and r.g == ["g0", "g1"] and r.one == ["only"]
    with pytest.raises(ValueError):
        CP.translator_slice(F.array(), "a", "pt", None)


def test_insert_translations_append_create_and_missing(spark):
    s = spark.createDataFrame([("000000001", "en1", None), ("000000002", "en2", ["old"]), ("000010000", "en3", None)],
                              "key string, caption string, captions_pt array<string>")
    t1 = spark.createDataFrame([(1, "t1a"), (2, "t1b")], "row long, caption string")
    t2 = spark.createDataFrame([(1, " t2a "), (2, "t2b")], "row long, caption string")
    ins, miss = CP.insert_translations(s, t1, t2)
    got = {r.key: (r.captions_en, r.captions_pt) for r in ins.collect()}
    assert got["000000001"] == (["en1"], ["t1a", "t2a"])
    assert got["000000002"] == (["en2"], ["old", "t1b"])
    assert [r.row for r in miss.collect()] == [10000]


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "idx long, cap string")
    assert sorted(r.idx for r in CP.dedup_keep_first(df, "cap", "idx").collect()) == [1, 2]


def test_merge_translations_missing_gets_empty(spark):
    s = spark.createDataFrame([("a",), ("b",)], "image string")
    t = spark.createDataFrame([(1, " a", "t2 "), (0, "a ", "t1")], "row long, image string, translated_caption string")
    got = {r.image: r.generated_captions_pt for r in CP.merge_translations(s, t).collect()}
    assert got == {"a": ["t1", "t2"], "b": []}


def test_quarantine_keeps_everything(spark):
    df = spark.createDataFrame([(1, ""), (2, "ok"), (3, None)], "id long, t string")
    good, bad = CP.quarantine(df, {"empty": F.col("t") != ""})
    assert [r.id for r in good.collect()] == [2]
    assert sorted((r.id, r.reject_reason) for r in bad.collect()) == [(1, "empty"), (3, "empty")]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_global_index_exact_under_any_partitioning(spark, parts):
    df = spark.range(0, 1000).repartition(parts).withColumn("k", (F.col("id") * 7919) % 1000)
    idx = global_index(df, ["k"], col="idx")
    rows = idx.select("k", "idx").collect()
    assert sorted(r.idx for r in rows) == list(range(1000))
    assert all(r.idx == sorted(x.k for x in rows).index(r.k) for r in rows[:50])
    sizes = chunk(idx, "idx", 300, "shard").groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in sizes] == [300, 300, 300, 100]


def test_insert_translations_reads_only_the_files_its_branch_needs(spark):
    """A sample that has translations needs no row of the second file, and keeps its other columns."""
    s = spark.createDataFrame([("000000000", "a", ["x"], ["old"], 7), ("000000001", "b", None, None, 8), ("000000002", None, ["y"], ["e"], 9)],
                              "key string, caption string, captions_pt array<string>, captions_en array<string>, n int")
    t1 = spark.createDataFrame([(0, "t0"), (1, "t1"), (2, "t2")], "row bigint, caption string")
    t2 = spark.createDataFrame([(5, "u")], "row bigint, caption string")
    ins, miss = CP.insert_translations(s, t1, t2)
    got = {r.key: (r.captions_en, r.captions_pt, r.n) for r in ins.collect()}
    assert got == {"000000000": (["a"], ["x", "t0"], 7), "000000002": (["e"], ["y", "t2"], 9)}
    assert [r.key for r in miss.collect()] == ["000000001"]

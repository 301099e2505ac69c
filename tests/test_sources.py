"""Sources and sinks on generated files."""
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files as FS
from corpusmill.sources import shards as SH


def test_brace_expansion():
    assert SH.expand_braces("d/{00000..00002}.tar") == ["d/00000.tar", "d/00001.tar", "d/00002.tar"]
    assert SH.expand_braces("a{1,2}::b/{8..10}") == ["a1", "a2", "b/8", "b/9", "b/10"]


def _make_shard(path, samples):
    with tarfile.open(path, "w") as tf:
        for key, js, img in samples:
            for ext, data in (("png", img), ("json", json.dumps(js).encode())):
                ti = tarfile.TarInfo(f"{key}.{ext}")
                ti.size = len(data)
                tf.addfile(ti, io.BytesIO(data))


def test_shard_scan_and_sink_roundtrip(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for s in range(3):
        _make_shard(os.path.join(src, "%05d.tar" % s),
                    [(f"sample{s}{i:04d}", {"image": f"i{s}_{i}", "captions-pt": [f"c{s}{i}"]}, b"\x89PNG" + bytes([i]))
                     for i in range(5)])
    df = SH.read_shards(spark, os.path.join(src, "{00000..00002}.tar"))
    assert df.count() == 15
    assert df.filter(F.col("img").isNull()).count() == 0
    nimg = SH.read_shards(spark, os.path.join(src, "{00000..00002}.tar"), include_images=False)
    assert nimg.filter(F.col("img").isNotNull()).count() == 0
    numbered = SH.number_samples(df.select("key", "json", "img"), ["key"], shard_size=4, start_shard=2)
    out = os.path.join(tmpdir_path, "out")
    SH.write_shards(numbered, out, img_col="img")
    names = sorted(os.listdir(out))
    assert names == ["00002.tar", "00003.tar", "00004.tar", "00005.tar"]
    back = SH.read_shards(spark, os.path.join(out, "{00002..00005}.tar"))
    sizes = {r.shard: r["count"] for r in back.groupBy("shard").count().collect()}
    assert sizes == {"00002.tar": 4, "00003.tar": 4, "00004.tar": 4, "00005.tar": 3}
    assert sorted(r.key for r in back.collect())[0] == "sample00008"   # start_shard * shard_size


def test_csv_to_tsv_counts_records_not_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    with open(p, "w") as f:
        f.write('h1,h2\n"multi\nline",x\n  keep me  ,y\n')
    out = FS.csv_to_tsv(spark, p, os.path.join(tmpdir_path, "o"), skip=1, blank_line=True)
    assert [r._c0 for r in out.collect()] == ["multi\nline", "keep me"]


def test_translation_layouts_and_file_order(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "t")
    os.makedirs(d)
    for i in range(2):
        with open(os.path.join(d, f"part{i}.tsv"), "w") as f:
            for j in range(3):
                f.write(f"u{i}{j}\ten{i}{j}\tpt{i}{j}\n")
    df = FS.read_translation_table(spark, d, "cc12m")
    rows = sorted((r.row, r.caption) for r in df.collect())
    assert rows == [(0, "pt00"), (1, "pt01"), (2, "pt02"), (3, "pt10"), (4, "pt11"), (5, "pt12")]


def test_manifests(spark, tmpdir_path):
    coco = os.path.join(tmpdir_path, "coco.json")
    json.dump({"annotations": [{"image_id": 42, "caption": "a cat"}, {"image_id": 7, "caption": "a dog"}]}, open(coco, "w"))
    assert [(r.pos, r.image_id) for r in FS.read_coco(spark, coco).orderBy("pos").collect()] == [(0, 42), (1, 7)]
    kp = os.path.join(tmpdir_path, "k.json")
    json.dump({"images": [{"filename": "f.jpg", "split": "test", "sentences": [{"raw": "s1"}, {"raw": "s2"}]}]}, open(kp, "w"))
    r = FS.read_karpathy(spark, kp).first()
    assert r.filename == "f.jpg" and [s.raw for s in r.sentences] == ["s1", "s2"]
    sk = os.path.join(tmpdir_path, "s.json")
    json.dump({"train": [{"filename": "a", "caption": "x"}], "validation": [{"filename": "b", "caption": "y"}], "test": []},
              open(sk, "w"))
    assert sorted((r.split, r.filename) for r in FS.read_split_keyed(spark, sk).collect()) == [("train", "a"), ("validation", "b")]


def test_split_manifests_are_bounded(spark, tmpdir_path):
    """A source of many items is many manifests, and positions count on over them."""
    rows = [(s, n, f"f{i:03d}", f"text {s} {i}") for s, size in (("big", 50), ("small", 2), (None, 5))
            for n in FS.SPLITS for i in range(size)]
    path = os.path.join(tmpdir_path, "m")
    FS.write_split_keyed(spark.createDataFrame(rows, "source string, split string, filename string, caption string"), path, 4)
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".json")]
    assert len(files) == 13 + 1 + 2
    assert max(len(x) for f in files for x in json.load(open(f)).values()) == 4
    got = sorted((r.split, r.pos, r.filename, r.caption) for r in FS.read_split_keyed(spark, path, 4).collect())
    assert got == sorted((n, int(f[1:]), f, c) for _, n, f, c in rows)


def test_source_queries_grow_with_the_data(spark, monkeypatch):
    """a7 writes many bounded manifests and a8 many files a class, with the same result."""
    from corpusmill.plans import queries as Q
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables not present")
    seen = {}

    def spy(name):
        plain = getattr(FS, name)

        def read(spark, path, *args):
            seen[name] = [os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.startswith("part-")]
            return plain(spark, path, *args)
        monkeypatch.setattr(FS, name, read)

    spy("read_split_keyed")
    spy("scan_labelled_folder")
    plain = [sorted(map(tuple, f(spark, "/root/testdata/sf0.001").collect())) for f in (Q.a7_split_manifest, Q.a8_labelled_folder)]
    before = {k: len(v) for k, v in seen.items()}
    monkeypatch.setattr(Q, "MANIFEST_ITEMS", 3, raising=False)
    monkeypatch.setattr(Q, "FOLDER_FILE_ROWS", 5, raising=False)
    small = [sorted(map(tuple, f(spark, "/root/testdata/sf0.001").collect())) for f in (Q.a7_split_manifest, Q.a8_labelled_folder)]
    assert small == plain and all(len(v) > before[k] for k, v in seen.items())


def test_labelled_folder(spark, tmpdir_path):
    for c in ("zebra", "ant"):
        os.makedirs(os.path.join(tmpdir_path, "root", c))
        for i in range(2):
            open(os.path.join(tmpdir_path, "root", c, f"{i}.jpg"), "wb").write(b"x")
    df = FS.scan_labelled_folder(spark, os.path.join(tmpdir_path, "root"))
    got = sorted((r.class_name, r.class_idx) for r in df.collect())
    assert got == [("ant", 0), ("ant", 0), ("zebra", 1), ("zebra", 1)]


def test_voc_split_and_objects(spark, tmpdir_path):
    sp = os.path.join(tmpdir_path, "split.txt")
    open(sp, "w").write("000005  1\n\n000007 -1\n")
    assert [r.image for r in FS.read_split_list(spark, sp).collect()] == ["000005", "000007"]
    xml = os.path.join(tmpdir_path, "a.xml")
    open(xml, "w").write("<annotation><filename>000005.jpg</filename><object><name>chair</name><bndbox><xmin>1</xmin>"
                         "<ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>dog</name><bndbox>"
                         "<xmin>5</xmin><ymin>6</ymin><xmax>7</xmax><ymax>8</ymax></bndbox></object></annotation>")
    got = sorted((r.name, r.xmin, r.ymax) for r in FS.read_objects(spark, xml).collect())
    assert got == [("chair", 1, 4), ("dog", 5, 8)]


def test_registry_and_metric_sink(spark, tmpdir_path):
    reg = os.path.join(tmpdir_path, "reg.json")
    json.dump([{"name": "d1", "type": "classification_multiclass", "num_classes": 3,
                "train": {"index_path": "t", "files_for_local_usage": ["a"], "num_images": 10},
                "test": {"index_path": "t", "files_for_local_usage": ["a"], "num_images": 5}}], open(reg, "w"))
    got = sorted((r.split, r.num_images) for r in FS.read_registry(spark, reg).collect())
    assert got == [("test", 5), ("train", 10)]
    m = spark.createDataFrame([("d1", "accuracy", 51.2)], "dataset string, metric string, result double")
    out = os.path.join(tmpdir_path, "metrics")
    FS.append_metrics(m, out, "run1")
    FS.append_metrics(m, out, "run2")
    assert spark.read.json(out).count() == 2


def test_small_helpers(spark, tmpdir_path):
    from corpusmill.functions import text as TX
    from corpusmill.operators import corpus as CP
    df = spark.createDataFrame([(42, ["a", "b"])], "image_id long, captions array<string>")
    assert df.select(TX.image_file_name("image_id").alias("f")).first().f == "000000000042.jpg"
    assert df.select(TX.sample_key(F.lit(7)).alias("k")).first().k == "sample00007"
    assert df.select(TX.shard_row_key(F.lit("000030042")).alias("r")).first().r == 30042
    ex = CP.explode_list(df, "captions", keep=("image_id",)).collect()
    assert [(r.image_id, r.pos, r.text) for r in ex] == [(42, 0, "a"), (42, 1, "b")]
    js = SH.sample_json(df, {"captions": "captions-pt"}).first().json
    assert json.loads(js) == {"captions-pt": ["a", "b"]}
    p = os.path.join(tmpdir_path, "t2.csv")
    open(p, "w").write('"first, quoted"\nsecond\n')
    assert [(r.pos, r.caption) for r in FS.read_csv_captions(spark, p).orderBy("pos").collect()] == \
        [(0, "first, quoted"), (1, "second")]
    t = os.path.join(tmpdir_path, "tr.tsv")
    open(t, "w").write("img1.jpg#0\tum gato\nimg1.jpg#1\tdois gatos\n")
    assert [(r.row, r.image) for r in FS.read_translation_tsv(spark, t).orderBy("row").collect()] == \
        [(0, "img1.jpg#0"), (1, "img1.jpg#1")]


def test_delimited_files_keep_fields_and_text(spark, tmpdir_path):
    """Quoted line breaks, doubled quotes, ragged records, blanks and empty fields."""
    src = os.path.join(tmpdir_path, "a.csv")
    with open(src, "w") as f:
        f.write('h1\na,b,c\n"diz ""oi"" aqui","x\ny",z,,\n  hi "x" ,q\n"t\tb",""\n')
    want = [["h1"], ["a", "b", "c"], ['diz "oi" aqui', "x\ny", "z", "", ""], ['  hi "x" ', "q"], ["t\tb", ""]]
    assert [r.fields for r in FS.read_records(spark, src).orderBy("rec").collect()] == want
    dst = os.path.join(tmpdir_path, "tsv")
    FS.csv_to_tsv(spark, src, dst)
    assert [r.fields for r in FS.read_records(spark, dst, sep="\t").orderBy("rec").collect()] == want
    rows = [("  hi \"x\" ", "u1"), ("a\nb\tc", "u2"), ("", "u3")]
    FS.export_caption_url(spark.createDataFrame(rows, "caption string, url string"), dst)
    back = FS.read_delimited(spark, dst, ["caption", "url"], "\t").collect()
    assert sorted((r.caption or "", r.url) for r in back) == sorted(rows)
    table = os.path.join(tmpdir_path, "t.tsv")
    with open(table, "w") as f:
        f.write('"um\ndois"\tu0\n"diz ""oi"""\tu1\ntres\tu2\n')
    got = {r.row: (r.caption, r.url) for r in FS.read_translation_table(spark, table, "other").collect()}
    assert got == {0: ("um\ndois", "u0"), 1: ('diz "oi"', "u1"), 2: ("tres", "u2")}


def test_unknown_sample_fields_are_kept(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "00000.tar")
    _make_shard(path, [("sample00000", {"image": "i", "similarities-xh": [0.5], "mood": "x", "other": [1, 2]}, b"p")])
    s = SH.read_shards(spark, path, include_images=False).first().sample
    assert s["similarities-xh"] == [0.5] and s["extra"] == {"mood": "x", "other": "[1,2]"}


def test_broadcast_and_shuffle_sides_agree(spark):
    from corpusmill.operators.partitioning import broadcast_if_small
    left = spark.range(100).withColumnRenamed("id", "k")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(0, 100, 3)], "k bigint, v string")
    small, large = broadcast_if_small(right), broadcast_if_small(right, limit=0)
    plan = lambda r: left.join(r, "k")._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" in plan(small) and "broadcast" not in plan(large)
    rows = lambda r: sorted((x.k, x.v) for x in left.join(r, "k").collect())
    assert rows(small) == rows(large) and len(rows(small)) == 34

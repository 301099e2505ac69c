"""Elements of JSON documents: equal to a whole parse, however the document is split."""
import json
import random

import pytest

from corpusmill.sources import files as FS
from corpusmill.sources import json_arrays as J

WORDS = ["plain", "a, b", "q\"uote", "back\\slash", "\\", "\"", "[x]", "{y}", "}],", "é,ü", " ", "line\nbreak", "", "annotations",
         "\\\",\\"]


def value(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rnd.choice(WORDS) for _ in range(rnd.randrange(4)))
    if kind < 5:
        return rnd.choice([None, True, -1.5, 10**12])
    if kind < 7:
        return {rnd.choice(WORDS) + str(i): value(rnd, depth + 1) for i in range(rnd.randrange(4))}
    return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def document(rnd, n):
    """The array among other fields, some of which hold arrays of its name further down."""
    out = {"info": {"annotations": [1, 2, {"annotations": [3]}]}, "note": "annotations", "a,annotations": [7, 8], "list": [["annotations"], 4]}
    out["annotations"] = [value(rnd) for _ in range(n)]
    out["after"] = [{"annotations": [5]}, value(rnd)]
    return out


@pytest.fixture
def split_size(spark):
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set(key, size or before)
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_any_split_gives_the_same_elements(spark, tmp_path, split_size):
    rnd = random.Random(5)
    docs = {f"d{i}.json": document(rnd, n) for i, n in enumerate((60, 0, 25, 1))}
    for i, (name, doc) in enumerate(docs.items()):
        text = json.dumps(doc, ensure_ascii=bool(i % 2), indent=(None, 1, None, 3)[i]) + "\n" * (i % 3)
        (tmp_path / name).write_text(text, encoding="utf-8")
    want = {(name, i): e for name, doc in docs.items() for i, e in enumerate(doc["annotations"])}
    for size in ("17", "101", None):
        split_size(size)
        got = J.read_array_texts(spark, str(tmp_path), "annotations").collect()
        assert len(got) == len(want)
        assert {(r.file.rsplit("/", 1)[1], r.pos): json.loads(r.text) for r in got} == want, size
        if size == "101":
            assert J._lines(spark, str(tmp_path / "d0.json"), ",").rdd.getNumPartitions() > 10


def test_states_compose_at_every_comma():
    """Both starts of every rest of a document: one of them is right, and the scan agrees with the summary."""
    text = json.dumps(document(random.Random(6), 12), indent=1)
    inside, depth = False, 0
    for piece in text.split(","):
        scan = J.Scanner("annotations", inside, depth, False)
        list(scan.events(piece + ","))
        inside, change = J.passed(piece + ",", inside)
        depth += change
        assert (scan.inside, scan.depth) == (inside, depth)
    assert (inside, depth) == (False, 0)


@pytest.mark.parametrize("text", ['{"annotations": []}', '{"annotations" : [ \n ], "x": [1, 2]}', '{"annotations": null}', '{"annotations": "[1, 2]"}',
                                  '{"annotations": {"a": 1, "b": [2, 3]}}', '{"x": {"annotations": [1, 2]}}', "{}", ""])
def test_nothing_to_read(spark, tmp_path, split_size, text):
    (tmp_path / "d.json").write_text(text)
    split_size("5")
    assert J.read_array_texts(spark, str(tmp_path / "d.json"), "annotations").collect() == []


def test_repeated_field_and_single_elements(spark, tmp_path, split_size):
    (tmp_path / "d.json").write_text('{"a": [], "a": [null], "b": [9], "a": [{}, "x,]"], "a": [ ]}')
    for size in ("3", None):
        split_size(size)
        got = J.read_array_texts(spark, str(tmp_path / "d.json"), "a").orderBy("pos").collect()
        assert [(r.pos, json.loads(r.text)) for r in got] == [(0, None), (1, {}), (2, "x,]")]


def test_long_element_over_many_splits(spark, tmp_path, split_size):
    long = {"image_id": 2, "caption": "w, é" * 3000}
    (tmp_path / "d.json").write_text(json.dumps({"annotations": [{"image_id": 1, "caption": "a"}, long, {"image_id": 3}]}, ensure_ascii=False))
    split_size("200")
    got = FS.read_coco(spark, str(tmp_path / "d.json")).orderBy("pos").collect()
    assert [(r.pos, r.image_id, r.caption) for r in got] == [(0, 1, "a"), (1, 2, long["caption"]), (2, 3, None)]


def test_written_documents_are_json(spark, tmp_path):
    rows = spark.createDataFrame([(json.dumps({"image_id": i, "caption": f'c "{i}", x'}),) for i in range(23)], "element string")
    J.write_arrays(rows.repartition(4), str(tmp_path / "m"), "annotations", head={"info": {"y": [1]}})
    J.write_arrays(rows.limit(0), str(tmp_path / "e"), "annotations")
    found = [json.loads(p.read_text()) for p in sorted((tmp_path / "m").glob("*.txt"))]
    assert len(found) == 4 and all(x["info"] == {"y": [1]} for x in found)
    got = FS.read_coco(spark, str(tmp_path / "m")).collect()
    assert sorted(r.image_id for r in got) == list(range(23))
    assert sorted((r.pos, r.image_id) for r in got) == sorted((i, a["image_id"]) for x in found for i, a in enumerate(x["annotations"]))
    assert FS.read_coco(spark, str(tmp_path / "e")).count() == 0

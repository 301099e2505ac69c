"""Label vocabularies, gather, prediction export, shard grouping."""
import json
import os

from pyspark.sql import functions as F

from corpusmill.operators import zeroshot as Z
from corpusmill.sources import files as FS
from corpusmill.sources import shards as SH


def test_imagenet_vocabulary(spark):
    ann = spark.createDataFrame(
        [("a.jpg", 2, "dog", "cão", "animal"), ("b.jpg", 1, "cat", "gato", "animal"), ("c.jpg", 2, "dog", "cão", "animal")],
        "filename string, id int, fine_grained_label string, translated_fine_grained_label string, "
        "translated_coarse_grained_label string")
    v = sorted((r.target, r.label, r.n_files) for r in Z.vocabulary_from_annotations(ann, "translated_fine_grained_label").collect())
    assert v == [(0, "gato", 1), (1, "cão", 2)]


def test_last_name_wins_first_position_kept(spark):
    rows = spark.createDataFrame([(0, 5, "a"), (1, 3, "b"), (2, 5, "c")], "pos long, id long, name string")
    got = sorted((r.class_id, r.name, r.first_pos) for r in Z.vocabulary_last_wins(rows, "id", "name").collect())
    assert got == [(3, "b", 1), (5, "c", 0)]


def test_translate_labels(spark):
    c = spark.createDataFrame([("chair",), ("sofa",)], "class_name string")
    m = spark.createDataFrame([("chair", "cadeira")], "source string, target string")
    got = {r.class_name: r.label for r in Z.translate_labels(c, m).collect()}
    assert got == {"chair": "cadeira", "sofa": None}


def test_gather_repeats_and_order(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_idx long, v string")
    idx = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "pos long, idx long")
    got = [r.v for r in Z.gather(rows, idx).orderBy("pos").collect()]
    assert got == ["c", "a", "c"]


def test_prediction_export(spark, tmpdir_path):
    probs = spark.createDataFrame([(0, 1, 0.25), (0, 0, 0.7500004), (1, 0, 1.0), (1, 1, 0.0)],
                                  "row_idx long, class_idx long, prob double")
    out = os.path.join(tmpdir_path, "pred")
    FS.export_predictions(probs, out, {"model_name": "m", "n_shot": 0})
    rows = {r.row_idx: (r.probs, r.model_name) for r in spark.read.json(out).collect()}
    assert rows[0] == ([0.75, 0.25], "m") and rows[1][0] == [1.0, 0.0]


def test_group_shards():
    paths = [f"{i:05d}.tar" for i in range(5)]
    assert SH.group_shards(paths, 250_000) == [paths[0:3], paths[3:5]]
    assert SH.group_shards(paths, 100_000) == [[p] for p in paths]

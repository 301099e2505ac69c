"""Delimited files, JSON manifests, labelled folders, XML
annotations, metric and prediction sinks, the dataset registry."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as TX
from corpusmill.operators.indexing import global_index
from corpusmill.operators.partitioning import broadcast_if_small
from corpusmill.session import reliable_checkpoint
from corpusmill.sources.json_arrays import read_array
from corpusmill.sources.records import fields_of, read_record_texts

# Column layouts of the translation tables, by dataset.
TRANSLATION_LAYOUTS = {
    "cc12m": ["url", "en-caption", "caption"],
    "wit": ["en-caption", "caption", "url"],
    "other": ["caption", "url"],
    "second": ["caption"],
}


def _string_schema(cols) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def read_delimited(spark: SparkSession, path: str, cols, sep: str = ",") -> DataFrame:
    """Header-less delimited file(s) with the given string columns, and ``rec``, the number of
    each record in file order.  Quoted fields may hold separators, line breaks and doubled quotes; a file
    of any size is read by many tasks all the same (``records``).  Empty fields are null."""
    schema = ", ".join(f"`{c}` string" for c in cols)
    return fields_of(read_record_texts(spark, path, sep), schema, sep).select("rec", "f.*")


# ---------------------------------------------------------------- A4

def read_translation_table(spark: SparkSession, path: str, layout: str, sep: str = "\t") -> DataFrame:
    """A4: header-less delimited translation file with the column layout of
    its dataset (``cc12m``, ``wit``, anything else, or ``second``), plus
    ``row`` = record number in file order (the lookup key of B5)."""
    cols = TRANSLATION_LAYOUTS.get(layout, TRANSLATION_LAYOUTS["other"])
    return read_delimited(spark, path, cols, sep).withColumnRenamed("rec", "row")


# ---------------------------------------------------------------- A5 / A6

def read_records(spark: SparkSession, path: str, sep: str = ",", rec: str = "rec") -> DataFrame:
    """(rec, fields array<string>): the records of delimited file(s) with all
    their fields, however many each has; ``rec`` counts records in file order.  The separators outside of quoted
    fields give the number of fields, and the largest one the width of the one parse."""
    q = re.escape(sep)
    bare = F.regexp_replace("text", f'(^|{q})"([^"]|"")*+"', "$1")
    texts = reliable_checkpoint(read_record_texts(spark, path, sep).withColumn(
        "n", F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1))
    width = texts.agg(F.max("n")).first()[0] or 1
    wide = fields_of(texts, ", ".join(f"c{i} string" for i in range(width)), sep, keep_empty=True)
    fields = F.slice(F.array(*[F.col(f"f.c{i}") for i in range(width)]), F.lit(1), F.col("n"))
    return wide.select(F.col("rec").alias(rec), F.transform(fields, lambda x: F.coalesce(x, F.lit(""))).alias("fields"))


def tsv_line(fields, sep: str = "\t"):
    """Column: one delimited record from an array of strings, text unchanged.
    A field with the separator, a quote or a line break is quoted, quotes
    inside are doubled; null is empty."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    field = lambda x: F.when(x.rlike(f'["\r\n{sep}]'), quoted(x)).otherwise(F.coalesce(x, F.lit("")))
    return F.array_join(F.transform(fields, field), sep)


def csv_to_tsv(spark: SparkSession, src: str, dst: str, skip: int = 0, blank_line: bool = False) -> DataFrame:
    """A5: rewrite a CSV as TSV, skipping the first ``skip`` CSV *records*
    (quoted newlines stay inside a record); with ``blank_line`` only the
    first column, stripped.  Every record keeps all its fields.  Returns the
    written frame (rec, fields, and the first field as _c0)."""
    out = read_records(spark, src).filter(F.col("rec") >= skip)
    if blank_line:
        out = out.select("rec", F.array(TX.strip(F.coalesce(F.get("fields", F.lit(0)), F.lit("")))).alias("fields"))
    out = out.orderBy("rec").withColumn("_c0", F.get("fields", F.lit(0)))
    out.select(tsv_line(F.col("fields")).alias("value")).write.mode("overwrite").text(dst)
    return out


def export_caption_url(df: DataFrame, dst: str, caption: str = "caption", url: str = "url") -> None:
    """Project caption and URL to a TSV, text unchanged."""
    df.select(tsv_line(F.array(caption, url)).alias("value")).write.mode("overwrite").text(dst)


# ---------------------------------------------------------------- A7

# The fields of a COCO annotation and of a Karpathy image.
COCO_ANNOTATION = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("caption", T.StringType())])
KARPATHY_IMAGE = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("sentences", T.ArrayType(T.StructType([T.StructField("raw", T.StringType())])))])
_SPLIT_ITEM = T.ArrayType(T.StructType([T.StructField("filename", T.StringType()),
                                        T.StructField("caption", T.StringType())]))
SPLIT_KEYED_SCHEMA = T.StructType([T.StructField(s, _SPLIT_ITEM) for s in ("train", "validation", "test")])


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """A7 COCO-style: (pos, image_id, caption), pos = position in the document's list.  A document of any size is many tasks."""
    return read_array(spark, path, "annotations", COCO_ANNOTATION).select("pos", "e.image_id", "e.caption")


def read_csv_captions(spark: SparkSession, path: str) -> DataFrame:
    """A second translation as a one-column CSV: (pos, caption) in file order."""
    return read_delimited(spark, path, ["caption"]).withColumnRenamed("rec", "pos")


def read_karpathy(spark: SparkSession, path: str) -> DataFrame:
    """A7 Karpathy-style: (filename, split, sentences array<struct<raw>>); read as ``read_coco``."""
    return read_array(spark, path, "images", KARPATHY_IMAGE).select("e.filename", "e.split", "e.sentences")


SPLITS = ("train", "validation", "test")


def write_split_keyed(items: DataFrame, path: str, size: int) -> None:
    """A7 sink: ``items`` (source, split, filename, caption) as split-keyed
    manifests below ``source=.../chunk=.../``.  A manifest has at most ``size``
    items of each split, in file name order, and chunk ``n`` starts at position
    ``n * size`` of each: a source of any size is many bounded manifests."""
    ties = items.withColumn("__tie", F.xxhash64("caption"))
    idx = global_index(ties, ["source", "split", "filename", "__tie"], col="__idx")
    # one row per source and split
    first = idx.groupBy(F.col("source").alias("__s"), F.col("split").alias("__p")).agg(F.min("__idx").alias("__first"))
    at = F.col("__idx") - F.col("__first")
    placed = (idx.join(broadcast_if_small(first), F.col("source").eqNullSafe(F.col("__s")) & F.col("split").eqNullSafe(F.col("__p")))
              .withColumn("chunk", F.floor(at / size).cast("bigint")))
    item = F.struct("__idx", "filename", "caption")
    bare = lambda x: F.struct(x["filename"].alias("filename"), x["caption"].alias("caption"))
    lists = placed.groupBy("source", "chunk").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("split") == n, item))), bare).alias(n) for n in SPLITS])
    lists.write.partitionBy("source", "chunk").json(path)


def read_split_keyed(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """A7 split-keyed: (split, pos, filename, caption) from ``{train: [...],
    validation: [...], test: [...]}``.  ``size``: the manifests are those of
    ``write_split_keyed`` with that size, and positions count on over the chunks."""
    j = spark.read.schema(SPLIT_KEYED_SCHEMA).json(path, multiLine=True)
    start = F.lit(0) if size is None else F.col("chunk").cast("bigint") * size
    long = j.select(start.alias("start"), F.expr("stack(3, 'train', train, 'validation', validation, 'test', test)")
                    .alias("split", "items"))
    return long.select("start", "split", F.posexplode("items").alias("pos", "it")).select(
        "split", (F.col("start") + F.col("pos")).cast("bigint").alias("pos"), "it.filename", "it.caption")


def read_translation_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Karpathy translation TSV (image#n, caption) with its file ``row``."""
    return read_delimited(spark, path, ["image", "caption"], "\t").withColumnRenamed("rec", "row")


# ---------------------------------------------------------------- A8

def scan_labelled_folder(spark: SparkSession, root: str) -> DataFrame:
    """One row per file under ``root/<class>/``: (path, class_name,
    class_idx); classes numbered in sorted name order.  Only the path
    column is read (no file contents)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
                  .select("path"))
    files = files.withColumn("class_name", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    classes = global_index(files.select("class_name").distinct(), ["class_name"], col="class_idx")
    return files.join(broadcast_if_small(classes), "class_name")


# ---------------------------------------------------------------- A9

def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """Image ids of a split list (first token of each non-empty line)."""
    t = spark.read.text(path)
    return (t.filter(F.trim("value") != "")
             .select(F.split(F.trim("value"), r"\s+").getItem(0).alias("image")))


OBJECT_XML_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("object", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("bndbox", T.StructType([T.StructField(c, T.DoubleType())
                                              for c in ("xmin", "ymin", "xmax", "ymax")]))])))])


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(filename, name, xmin, ymin, xmax, ymax) per annotated object."""
    x = spark.read.format("xml").option("rowTag", "annotation").schema(OBJECT_XML_SCHEMA).load(path)
    return x.select("filename", F.explode("object").alias("o")).select(
        "filename", "o.name", *[F.col("o.bndbox." + c).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


# ---------------------------------------------------------------- A10 / A11

def append_metrics(results: DataFrame, path: str, run_id: str) -> None:
    """A10: one line per (run, dataset, metric) added to a JSON sink, in the run's own folder ``id=<run>``.  A
    repeated run replaces its lines, so each run is there once; reading ``path`` gives ``id`` back."""
    results.write.mode("overwrite").json(f"{path}/id={run_id}")


def export_predictions(probs: DataFrame, path: str, meta: dict, row_idx: str = "row_idx",
                       class_idx: str = "class_idx", prob: str = "prob") -> None:
    """One JSON line per image (row_idx, rounded probability list) and
    the run metadata as columns; not one giant document."""
    rows = (probs.groupBy(row_idx)
                 .agg(F.array_sort(F.collect_list(F.struct(class_idx, F.round(prob, 6).alias("p")))).alias("__l"))
                 .select(row_idx, F.transform("__l", lambda s: s["p"]).alias("probs")))
    for k, v in meta.items():
        rows = rows.withColumn(k, F.lit(v))
    rows.write.mode("overwrite").json(path)


# ---------------------------------------------------------------- F6

REGISTRY_SPLIT = T.StructType([T.StructField("index_path", T.StringType()),
                               T.StructField("files_for_local_usage", T.ArrayType(T.StringType())),
                               T.StructField("num_images", T.LongType())])
REGISTRY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("name", "description", "contact", "type", "format",
                                                "root_folder", "labelmap")]
    + [T.StructField("version", T.LongType()), T.StructField("num_classes", T.LongType())]
    + [T.StructField(s, REGISTRY_SPLIT) for s in ("train", "val", "test")])


def write_registry(datasets: DataFrame, path: str) -> None:
    """F6 sink: one JSON array with a document per row of ``datasets``: name, type, num_classes, and per
    split train, val and test a struct with num_images, or null.  One row per dataset: a registry is small."""
    document = F.struct("name", "type", "num_classes", "train", "val", "test")
    datasets.agg(F.to_json(F.array_sort(F.collect_list(document))).alias("value")).write.text(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """the dataset registry as (name, type, num_classes, split,
    num_images); a missing split gives no row."""
    j = spark.read.schema(REGISTRY_SCHEMA).json(path, multiLine=True)
    long = j.select("name", "type", "num_classes",
                    F.expr("stack(3, 'train', train, 'val', val, 'test', test)").alias("split", "s"))
    return long.filter(F.col("s").isNotNull()).select("name", "type", "num_classes", "split",
                                                      F.col("s.num_images").alias("num_images"))

"""A1: an index of tar shards, and samples fetched by it.

The index is a Parquet table with one row per sample: shard, key, and the places of its members in the tar.  It is
made from the tar headers alone; payloads are skipped by seeking.  Choosing samples is then a matter of the index:
any filter (Parquet statistics apply), semi join or sample of its rows, and only the members of the rows that are left are
read.  A shard is cut into byte ranges of ``split_bytes``, so one large shard is many tasks, and runs of
neighbouring members are read at once.  What is shuffled are index rows, never payloads.

A stream over the index table is a stream of samples: Spark's file source keeps the offsets and bounds what a batch takes in.

Shards must not be compressed.  A shard that has changed since it was indexed fails the read.
"""

from __future__ import annotations

import math
import os
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import ship_package
from corpusmill.sources.shards import IMAGE_EXTS, READ_SCHEMA, _fs, expand_braces, parse_samples

# ``at`` and ``size`` span the sample with its headers; a member that a sample lacks is null
INDEX_SCHEMA = ("path string, tar_bytes long, shard string, pos long, key string, at long, size long, "
                "json_at long, json_size long, img_at long, img_size long")
_FIELDS = [f.split() for f in INDEX_SCHEMA.split(", ")]
_INDEX_ARROW = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in _FIELDS])
_SAMPLE_ARROW = pa.schema([("shard", pa.string()), ("key", pa.string()), ("img", pa.binary()), ("json", pa.string())])

SPLIT_BYTES = 128 << 20
RUN_BYTES = 4 << 20      # read at once, and size of a batch
GAP_BYTES = 16 << 10     # unwanted bytes that are read rather than skipped
INDEX_ROWS = 4_096


def _samples_of(path: str):
    """The index rows of one tar."""
    fs, p = _fs(path)
    with fs.open_input_file(p) as raw, tarfile.open(fileobj=raw, mode="r:") as tf:
        size, shard, pos, now = raw.size(), os.path.basename(path), -1, None
        for m in tf:
            tf.members = []              # a tar of any length is read in constant memory
            if not m.isfile():
                continue
            key, _, ext = os.path.basename(m.name).partition(".")
            if now is None or key != now["key"]:
                if now is not None:
                    yield _index_row(now)
                pos += 1
                now = {"path": path, "tar_bytes": size, "shard": shard, "pos": pos, "key": key, "at": m.offset, "members": {}}
            now["members"][ext.lower()] = (m.offset_data, m.size)
            now["size"] = m.offset_data + m.size - now["at"]
        if now is not None:
            yield _index_row(now)


def _index_row(sample: dict) -> tuple:
    members = sample["members"]
    image = next((members[e] for e in IMAGE_EXTS if e in members), (None, None))
    return (*(sample[c] for c in ("path", "tar_bytes", "shard", "pos", "key", "at", "size")),
            *members.get("json", (None, None)), *image)


def _scan(batches):
    for rb in batches:
        for path in rb.column(0).to_pylist():
            rows = []
            for row in _samples_of(path):
                rows.append(row)
                if len(rows) == INDEX_ROWS:
                    yield _index_batch(rows)
                    rows = []
            yield _index_batch(rows)


def _index_batch(rows):
    cols = list(zip(*rows)) or [[]] * len(_INDEX_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _INDEX_ARROW)], schema=_INDEX_ARROW)


def write_index(spark: SparkSession, pattern: str, dst: str, shards_per_file: int = 8) -> DataFrame:
    """Index the shards named by ``pattern`` into the table ``dst`` and return the table.  Shards that the table
    already has are not read again, so it follows a sink that adds shards.  One task indexes ``shards_per_file`` shards."""
    ship_package(spark)
    paths = [p for p in expand_braces(pattern) if p]
    folder = spark._jvm.org.apache.hadoop.fs.Path(dst)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = {r.path for r in read_index(spark, dst).select("path").distinct().collect()}   # one row per shard
        paths = [p for p in paths if p not in known]
    files = max(1, math.ceil(len(paths) / shards_per_file))
    todo = spark.createDataFrame([(p, i // shards_per_file) for i, p in enumerate(paths)], "path string, file int")
    rows = todo.repartitionById(files, F.col("file")).select("path").mapInArrow(_scan, INDEX_SCHEMA)
    rows.write.mode("append").parquet(dst)
    return read_index(spark, dst)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index table: one row per sample."""
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def _runs(rows, include_images: bool):
    """The samples of one tar in groups whose wanted bytes lie close together: (first byte, end, samples)."""
    first = end = None
    run: list = []
    for r in rows:
        spans = [(r["json_at"], r["json_size"])] + [(r["img_at"], r["img_size"])] * include_images
        spans = [(a, a + n) for a, n in spans if a is not None]
        lo, hi = (min(a for a, _ in spans), max(b for _, b in spans)) if spans else (end or 0, end or 0)
        if run and (lo > end + GAP_BYTES or lo < first or max(hi, end) - first > RUN_BYTES):
            yield first, end, run
            run = []
        if not run:
            first, end = lo, hi
        end = max(end, hi)
        run.append(r)
    if run:
        yield first, end, run


def _fetch(include_images: bool):
    def fn(batches):
        path, f = None, None
        try:
            for rb in batches:
                rows = rb.to_pylist()
                at = 0
                for i in range(1, len(rows) + 1):
                    if i < len(rows) and rows[i]["path"] == rows[at]["path"]:
                        continue
                    if rows[at]["path"] != path:
                        if f is not None:
                            f.close()
                        path = rows[at]["path"]
                        fs, p = _fs(path)
                        f = fs.open_input_file(p)
                        if f.size() != rows[at]["tar_bytes"]:
                            raise ValueError(f"{path} has changed since it was indexed")
                    for first, end, run in _runs(rows[at:i], include_images):
                        data = f.read_at(end - first, first)
                        part = lambda a, n: None if a is None else data[a - first:a - first + n]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["shard"] for r in run], pa.string()), pa.array([r["key"] for r in run], pa.string()),
                             pa.array([part(r["img_at"], r["img_size"]) if include_images else None for r in run], pa.binary()),
                             pa.array([None if r["json_at"] is None else part(r["json_at"], r["json_size"]).decode() for r in run], pa.string())],
                            schema=_SAMPLE_ARROW)
                    at = i
        finally:
            if f is not None:
                f.close()
    return fn


def fetch(index_rows: DataFrame, include_images: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The samples of ``index_rows`` (any choice of rows of an index), as ``read_shards`` returns them.  Without images
    their bytes are not read."""
    ship_package(index_rows.sparkSession)
    wanted = F.coalesce("json_size", F.lit(0)) + (F.coalesce("img_size", F.lit(0)) if include_images else F.lit(0))
    total = index_rows.agg(F.sum(wanted)).first()[0] or 0
    # the bytes that are wanted set the number of tasks, the ranges of a tar what is dealt to them
    tasks = max(1, math.ceil(total / split_bytes))
    dealt = (index_rows.withColumn("__range", (F.col("at") / split_bytes).cast("bigint"))
             .repartition(tasks, "path", "__range").sortWithinPartitions("path", "at").drop("__range"))
    return parse_samples(dealt.mapInArrow(_fetch(include_images), READ_SCHEMA))


def stream_samples(spark: SparkSession, index: str, files_per_batch: int = 1, include_images: bool = True) -> DataFrame:
    """A stream of the samples of an index table, ``files_per_batch`` index files at a time; shards that are indexed later follow.
    A query that stops and starts again from its checkpoint goes on where it was, every sample once."""
    ship_package(spark)
    rows = (spark.readStream.schema(INDEX_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(index))
    return parse_samples(rows.mapInArrow(_fetch(include_images), READ_SCHEMA))

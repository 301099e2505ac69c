"""A1-A3: tar shard datasets (image + JSON per sample) as a Spark data source.

Reading: one input partition per shard file, the tar streamed with the
standard library inside the task, members grouped by sample key (the file
name before the first dot), the first of ``jpg``/``png`` taken as the image.
``includeImages=false`` skips image members entirely, so caption-only jobs
never move image bytes.

Writing: ``write_shards`` numbers samples exactly (two-pass global index),
cuts them into shards of ``shard_size`` samples (``shard = idx div size``,
numbers from ``start_shard``), hash-partitions by shard so each shard is
written whole by one task, sorts within the tasks, streams the samples into
``%05d.tar`` files with ``sample%05d`` keys and publishes them on commit.
"""

from __future__ import annotations

import io
import os
import re
import tarfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

from corpusmill.functions import text as TX
from corpusmill.operators.indexing import chunk, global_index
from corpusmill.session import ship_package

# Samples per shard and the image member extensions, in preference order.
SHARD_SIZE = 10_000
IMAGE_EXTS = ("jpg", "png")

# Languages of the caption lists.
LANGUAGES = ("pt", "en", "xh", "hi")
# Per language the captions, the generated captions and the similarities of both.
# A field outside this list is kept, as text, in the map ``sample.extra``.
SAMPLE_JSON = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("image", "key", "caption")]
    + [T.StructField(f"{kind}-{lang}", T.ArrayType(item))
       for kind, item in (("captions", T.StringType()), ("generated-captions", T.StringType()),
                          ("similarities", T.DoubleType()))
       for lang in LANGUAGES])

READ_SCHEMA = "shard string, key string, img binary, json string"

_BRACE = re.compile(r"\{([^{}]*)\}")


def expand_braces(pattern: str) -> list:
    """Expand ``{00000..00266}`` numeric ranges (zero padding kept) and
    ``{a,b}`` alternatives, left to right; several patterns may be joined
    with ``::``.  Runs on the driver over path names only."""
    out = []
    for part in pattern.split("::"):
        out.extend(_expand_one(part))
    return out


def _expand_one(p: str) -> list:
    m = _BRACE.search(p)
    if not m:
        return [p]
    body = m.group(1)
    rng = re.fullmatch(r"(\d+)\.\.(\d+)", body)
    if rng:
        a, b = rng.group(1), rng.group(2)
        width = len(a) if a.startswith("0") else 0
        items = [str(i).zfill(width) for i in range(int(a), int(b) + 1)]
    else:
        items = body.split(",")
    res = []
    for it in items:
        res.extend(_expand_one(p[:m.start()] + it + p[m.end():]))
    return res


def _fs(path: str):
    """(filesystem, path) for a local path or a URI (hdfs://, s3://, gs://...)."""
    from urllib.parse import urlparse

    from pyarrow import fs as pafs
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(path).path
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class _ShardPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _ShardReader(DataSourceReader):
    def __init__(self, paths, include_images: bool):
        self.paths = paths
        self.include_images = include_images

    def partitions(self):
        return [_ShardPartition(p) for p in self.paths]

    def read(self, partition):
        shard = os.path.basename(partition.path)
        current, members = None, {}

        def emit(key, members):
            img = None
            if self.include_images:
                for ext in IMAGE_EXTS:
                    if ext in members:
                        img = members[ext]
                        break
            js = members.get("json")
            return (shard, key, img, js.decode("utf-8") if js is not None else None)

        fs, p = _fs(partition.path)
        with fs.open_input_stream(p) as raw, tarfile.open(fileobj=raw, mode="r|*") as tf:
            for m in tf:
                if not m.isfile():
                    continue
                name = os.path.basename(m.name)
                key, _, ext = name.partition(".")
                if current is not None and key != current:
                    yield emit(current, members)
                    members = {}
                current = key
                ext = ext.lower()
                if ext in IMAGE_EXTS and not self.include_images:
                    continue
                f = tf.extractfile(m)
                members[ext] = f.read() if f is not None else None
        if current is not None:
            yield emit(current, members)


class _ShardCommit(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class _ShardWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        """Rows (shard, idx, key, json, img) sorted by shard and idx, streamed
        into one tar per shard.  Files get a name of their own attempt; they
        take their place when the job commits."""
        fs, base = _fs(self.path)
        base = base.rstrip("/")
        fs.create_dir(base, recursive=True)
        files, shard, out, tf = [], None, None, None
        for r in iterator:
            if int(r["shard"]) != shard:
                if tf is not None:
                    tf.close()
                    out.close()
                shard = int(r["shard"])
                tmp = f"{base}/.{shard:05d}.{uuid.uuid4().hex}.inprogress"
                files.append((tmp, f"{base}/{shard:05d}.tar"))
                out = fs.open_output_stream(tmp)
                tf = tarfile.open(fileobj=out, mode="w")
            for ext, data in (("json", r["json"].encode("utf-8") if r["json"] is not None else None),
                              (_image_ext(r["img"]), r["img"])):
                if data is None:
                    continue
                ti = tarfile.TarInfo(f"{r['key']}.{ext}")
                ti.size = len(data)
                tf.addfile(ti, io.BytesIO(bytes(data)))
        if tf is not None:
            tf.close()
            out.close()
        return _ShardCommit(files)

    def commit(self, messages):
        fs, _ = _fs(self.path)
        for m in messages:
            for tmp, name in (m.files if m else ()):
                fs.move(tmp, name)

    def abort(self, messages):
        fs, _ = _fs(self.path)
        for m in messages:
            for tmp, _name in (m.files if m else ()):
                fs.delete_file(tmp)


def _image_ext(data) -> str:
    """The extension of an image by its first bytes."""
    return "jpg" if data is not None and bytes(data[:2]) == b"\xff\xd8" else "png"


class TarShardSource(DataSource):
    """``spark.read.format("tarshards").option("paths", pattern)``."""

    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        paths = expand_braces(self.options["paths"])
        inc = str(self.options.get("includeImages", "true")).lower() == "true"
        return _ShardReader(paths, inc)

    def writer(self, schema, overwrite):
        return _ShardWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TarShardSource)


def read_shards(spark: SparkSession, pattern: str, include_images: bool = True) -> DataFrame:
    """A1: samples of all shards named by ``pattern`` (brace ranges and
    ``::``-joined lists), JSON parsed into ``SAMPLE_JSON`` (fields outside it
    are in ``sample.extra``)."""
    register(spark)
    raw = (spark.read.format("tarshards").option("paths", pattern)
                .option("includeImages", str(include_images).lower()).load())
    return parse_samples(raw)


def parse_samples(raw: DataFrame) -> DataFrame:
    """``raw`` with its JSON parsed into ``SAMPLE_JSON``."""
    known = [f.name for f in SAMPLE_JSON.fields]
    other = F.map_filter(F.from_json("json", "map<string,string>"), lambda k, _: ~k.isin(*known))
    return raw.withColumn("sample", F.from_json("json", SAMPLE_JSON).withField("extra", other))


def number_samples(samples: DataFrame, order_by, shard_size: int = SHARD_SIZE,
                   start_shard: int = 0) -> DataFrame:
    """A2/A3: exact consecutive ``idx`` from ``start_shard * shard_size``,
    ``shard = idx div shard_size``, key ``sample%05d``."""
    e = global_index(samples, order_by, col="idx", start=start_shard * shard_size)
    return chunk(e, "idx", shard_size, "shard").withColumn("key", TX.sample_key("idx"))


def remaining(samples: DataFrame, written: DataFrame, on) -> DataFrame:
    """A3: samples not written yet (``left_anti`` on the written keys)."""
    return samples.join(written, on, "left_anti")


def write_shards(numbered: DataFrame, path: str, json_col: str = "json", img_col: str | None = None) -> None:
    """A2 sink: whole shards per task, ``%05d.tar`` in ``path``."""
    register(numbered.sparkSession)
    n_shards = numbered.select("shard").distinct().count()
    img = F.col(img_col) if img_col else F.lit(None).cast("binary")
    rows = numbered.select("shard", "idx", "key", F.col(json_col).alias("json"), img.alias("img"))
    # whole shards per task, in order, so that a task holds one sample at a time
    rows.repartition(max(1, n_shards), "shard").sortWithinPartitions("shard", "idx").write.format("tarshards").option("path", path) \
        .mode("append").save()


def write_shards_parquet(numbered: DataFrame, path: str) -> None:
    """A2 sink as Parquet: one folder per shard, rows sorted by idx."""
    (numbered.repartition("shard").sortWithinPartitions("idx")
             .write.mode("overwrite").partitionBy("shard").parquet(path))


def sample_json(df: DataFrame, cols) -> DataFrame:
    """Serialise caption columns into the sample JSON (names as in the
    reference: ``captions-pt``...)."""
    return df.withColumn("json", F.to_json(F.struct(*[F.col(c).alias(n) for c, n in cols.items()])))




def group_shards(paths: list, part_size: int, samples_per_shard: int = 100_000) -> list:
    """B9 parallel form: consecutive shard paths grouped ``ceil(part_size /
    samples_per_shard)`` at a time, one output part per group (path names
    only, on the driver)."""
    import math
    size = max(1, math.ceil(int(part_size) / samples_per_shard))
    return [paths[i:i + size] for i in range(0, len(paths), size)]

"""Exact fixed-size shards and parts without numbering the rows, and a ledger to resume by.

Row ``i`` in the order of ``order_by`` belongs to piece ``i div size``.  A plan needs the order columns only:
they are sorted and counted, and the first key of every piece is kept, one row per piece.  Which
piece a row belongs to then follows from its own key, by binary search among these bounds, so whole rows (image
bytes too) are never sorted globally, numbered or checkpointed: one shuffle brings every piece to its own task, which
sorts it and streams it out.  A sample's number is the first of its shard plus its place in the stream.

``write_planned`` keeps the plan (``_plan``) and a ledger (``_ledger``) beside the shards.  A task publishes each
shard as soon as it is complete: the tar under its name, then a ledger entry with samples, bytes and sha256.  What an
aborted run has finished stays; a run that resumes reads the plan, leaves out the rows of finished
shards before the shuffle, and writes the others as an uninterrupted run would, byte for byte.
A shard that does not get the samples that the plan gives it fails the run.

The bounds are broadcast up to ``MAX_BOUNDS`` pieces; beyond, the numbered keys are joined to the rows by a
shuffle.  ``order_by`` must be a total order of the rows (integers, strings or dates; nulls come first).
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusmill.operators.indexing import global_index
from corpusmill.session import ship_package
from corpusmill.sources.shards import SHARD_SIZE, _fs, _image_ext

MAX_BOUNDS = 1_000_000
LEDGER = "shard long, samples long, bytes long, sha256 string"


@dataclass
class Plan:
    order_by: list
    size: int
    total: int
    firsts: DataFrame   # no, and the order columns of the piece's first row

    @property
    def pieces(self) -> int:
        return -(-self.total // self.size)


def make_plan(rows: DataFrame, order_by, size: int) -> Plan:
    """The bounds of pieces of ``size`` rows; reads and sorts the order columns only."""
    if size < 1:
        raise ValueError("size must be >= 1")
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    ids = global_index(rows.select(*order_by), order_by, col="__idx")
    total = ids.agg(F.max("__idx")).first()[0]
    firsts = ids.filter(F.col("__idx") % size == 0).select((F.col("__idx") / size).cast("bigint").alias("no"), *order_by)
    return Plan(order_by, size, 0 if total is None else total + 1, firsts)


def _key(values) -> tuple:
    return tuple((v is not None, v) for v in values)


def place(rows: DataFrame, plan: Plan, col: str = "no", without=(), max_bounds: int = MAX_BOUNDS) -> DataFrame:
    """``rows`` with the number of their piece; rows of the pieces in ``without`` are left out.  Only the order
    columns are looked at."""
    ship_package(rows.sparkSession)
    skip = set(without)
    if plan.pieces > max_bounds:
        ids = global_index(rows.select(*plan.order_by), plan.order_by, col="__idx")
        ids = ids.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(plan.order_by)],
                         (F.col("__idx") / plan.size).cast("bigint").alias(col))
        if skip:
            gone = rows.sparkSession.createDataFrame([(s,) for s in sorted(skip)], f"{col} long")
            ids = ids.join(gone, col, "left_anti")
        same = [rows[c].eqNullSafe(ids[f"__k{i}"]) for i, c in enumerate(plan.order_by)]
        return rows.join(ids, same).drop(*[f"__k{i}" for i in range(len(plan.order_by))])
    bounds = [_key(r[1:]) for r in plan.firsts.orderBy("no").collect()]
    shared = rows.sparkSession.sparkContext.broadcast((bounds, skip))

    @F.arrow_udf("bigint")
    def find(keys: pa.Array) -> pa.Array:
        bounds, skip = shared.value
        at = [max(0, bisect_right(bounds, _key(k)) - 1) for k in zip(*(c.to_pylist() for c in keys.flatten()))]
        return pa.array([None if i in skip else i for i in at], pa.int64())

    placed = rows.withColumn(col, find(F.struct(*plan.order_by)))
    return placed.filter(F.col(col).isNotNull()) if skip else placed


def in_pieces(placed: DataFrame, plan: Plan, col: str = "no") -> DataFrame:
    """Every piece in a task of its own, in order: the one shuffle of whole rows."""
    return placed.repartitionById(max(1, plan.pieces), F.col(col).cast("int")).sortWithinPartitions(col, *plan.order_by)


def write_parts(rows: DataFrame, path: str, order_by, size: int, max_bounds: int = MAX_BOUNDS) -> None:
    """Parts of ``size`` rows (the last may be smaller), in order, as ``part=<n>`` folders of Parquet."""
    plan = make_plan(rows, order_by, size)
    in_pieces(place(rows, plan, "part", max_bounds=max_bounds), plan, "part").write.partitionBy("part").parquet(path)


# ---------------------------------------------------------------- shards with a ledger

class _Open:
    """A shard that is being written: a tar that counts and hashes what goes through."""

    def __init__(self, fs, base: str, shard: int):
        self.fs, self.shard, self.name = fs, shard, f"{base}/{shard:05d}.tar"
        self.tmp = f"{base}/.{shard:05d}.{uuid.uuid4().hex}.inprogress"
        self.samples = self.bytes = 0
        self.sha = hashlib.sha256()
        self.out = fs.open_output_stream(self.tmp)
        self.tar = tarfile.open(fileobj=self, mode="w|")

    def write(self, data) -> int:
        self.sha.update(data)
        self.bytes += len(data)
        self.out.write(data)
        return len(data)

    def add(self, key: str, text, img) -> None:
        for ext, data in (("json", None if text is None else text.encode()), (_image_ext(img), img)):
            if data is not None:
                info = tarfile.TarInfo(f"{key}.{ext}")
                info.size = len(data)
                self.tar.addfile(info, io.BytesIO(data))
        self.samples += 1

    def publish(self, ledger: str) -> None:
        """The tar first, its entry then: an entry stands for a whole shard.  A repeated attempt writes the same bytes."""
        self.tar.close()
        self.out.close()
        self.fs.move(self.tmp, self.name)
        entry = f"{ledger}/{self.shard:05d}.json"
        tmp = f"{ledger}/.{self.shard:05d}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(tmp) as f:
            f.write(json.dumps({"shard": self.shard, "samples": self.samples, "bytes": self.bytes, "sha256": self.sha.hexdigest()}).encode())
        self.fs.move(tmp, entry)

    def give_up(self) -> None:
        self.out.close()
        self.fs.delete_file(self.tmp)


class _LedgerWriter(DataSourceArrowWriter):
    def __init__(self, path: str, size: int, total: int, start_shard: int):
        self.path, self.size, self.total, self.start = path, size, total, start_shard

    def write(self, iterator):
        """Batches (no, json, img) in order; one shard is open at a time."""
        fs, base = _fs(self.path)
        base = base.rstrip("/")
        now = None
        try:
            for rb in iterator:
                for no, text, img in zip(*(rb.column(i).to_pylist() for i in range(3))):
                    shard = self.start + no
                    if now is None or now.shard != shard:
                        self._finish(now, base)
                        now = _Open(fs, base, shard)
                    now.add(f"sample{shard * self.size + now.samples:05d}", text, img)
            self._finish(now, base)
            now = None
        finally:
            if now is not None:
                now.give_up()
        return WriterCommitMessage()

    def _finish(self, shard, base):
        if shard is None:
            return
        want = min(self.size, self.total - (shard.shard - self.start) * self.size)
        if shard.samples != want:
            raise ValueError(f"shard {shard.shard}: {shard.samples} samples instead of the {want} of its plan")
        shard.publish(f"{base}/_ledger")


class LedgerShards(DataSource):
    @classmethod
    def name(cls):
        return "ledgershards"

    def schema(self):
        return "no bigint, json string, img binary"

    def writer(self, schema, overwrite):
        o = self.options
        return _LedgerWriter(o["path"], int(o["size"]), int(o["total"]), int(o["start"]))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(shard, samples, bytes, sha256) of every finished shard below ``path``."""
    if not _exists(spark, f"{path}/_ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(f"{path}/_ledger")


def _stored_plan(spark: SparkSession, path: str, order_by) -> Plan | None:
    if not _exists(spark, f"{path}/_plan/_SUCCESS"):
        return None
    about = spark.read.parquet(f"{path}/_plan_about").first()
    if list(about.order_by) != order_by:
        raise ValueError(f"the shards in {path} were planned by {list(about.order_by)}")
    return Plan(order_by, about.size, about.total, spark.read.parquet(f"{path}/_plan"))


def write_planned(rows: DataFrame, path: str, order_by, json_col: str = "json", img_col: str | None = None,
                  size: int = SHARD_SIZE, start_shard: int = 0, only=None) -> Plan:
    """A2, A3: ``rows`` as tar shards ``%05d.tar`` of exactly ``size`` samples ``sample%05d`` (the last may be smaller)
    from ``start_shard`` on.  Called again, it writes what the ledger does not have.  ``only``: the shard
    numbers that this run may write."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(LedgerShards)
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    plan = _stored_plan(spark, path, order_by)
    if plan is None:
        plan = make_plan(rows, order_by, size)
        spark.createDataFrame([(order_by, size, plan.total)], "order_by array<string>, size long, total long") \
            .write.mode("overwrite").parquet(f"{path}/_plan_about")
        plan.firsts.write.mode("overwrite").parquet(f"{path}/_plan")
    fs, base = _fs(path)
    fs.create_dir(f"{base.rstrip('/')}/_ledger", recursive=True)
    done = {r.shard - start_shard for r in read_ledger(spark, path).select("shard").collect()}   # one row per shard
    if only is not None:
        done |= set(range(plan.pieces)) - {s - start_shard for s in only}
    if len(done) < plan.pieces:
        img = F.col(img_col) if img_col else F.lit(None).cast("binary")
        cols = [F.col(json_col).alias("__json"), img.alias("__img")]
        slim = rows.select(*order_by, *cols)
        ready = in_pieces(place(slim, plan, "__no", done), plan, "__no")
        (ready.select(F.col("__no").alias("no"), F.col("__json").alias("json"), F.col("__img").alias("img"))
              .write.format("ledgershards").options(path=path, size=plan.size, total=plan.total, start=start_shard).mode("append").save())
    return plan


def check_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, samples, ok): whether each shard of the ledger is there with its bytes and sha256; one task reads one
    shard at a time."""
    ship_package(spark)

    def fn(batches):
        fs, base = _fs(path)
        for rb in batches:
            ok = []
            for shard, n, sha in zip(*(rb.column(i).to_pylist() for i in (0, 2, 3))):
                found, size = hashlib.sha256(), 0
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{shard:05d}.tar") as f:
                        while data := f.read(1 << 20):
                            found.update(data)
                            size += len(data)
                except FileNotFoundError:
                    size = -1
                ok.append(size == n and found.hexdigest() == sha)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(ok, pa.bool_())], ["shard", "samples", "ok"])

    ledger = read_ledger(spark, path)
    return ledger.repartition(spark.sparkContext.defaultParallelism, "shard").mapInArrow(fn, "shard long, samples long, ok boolean")

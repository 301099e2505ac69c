"""Session construction and lineage cutting.

Library code never creates its own session: every operator takes DataFrames.
``get_session`` is for tests, the bench and scripts.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _default_driver_memory() -> str:
    """About 60% of physical memory, at most 16g (local mode runs
    everything in the driver JVM)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "corpusmill") -> SparkSession:
    master = master or os.environ.get("CORPUSMILL_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # no broadcast chosen from size estimates: the library broadcasts
        # explicitly, and only tables whose size it has bounded
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSMILL_DRIVER_MEMORY", _default_driver_memory()))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Taken from the session (``SparkContext.getCheckpointDir`` or the
    ``spark.checkpoint.dir`` setting).  Only a local-mode session without one
    (tests, the bench) gets a fresh scratch folder; a cluster session without a
    configured shared folder is an error, because a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) "
                       "before running operators that cut lineage")


@contextlib.contextmanager
def scratch_folder(spark: SparkSession):
    """A new folder in the shared checkpoint folder for files that a job writes
    and reads back; deleted at the end, so what is read must be cut by then."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint into the shared checkpoint folder.

    Used where an operator reads the same data twice and both passes must see
    identical partitions (exact two-pass global index), and after expensive
    model callables that must never be recomputed.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusmill`` importable in every Python worker (local or
    cluster): the package is zipped once per SparkContext and handed to
    ``SparkContext.addPyFile``, which distributes it to the executors.
    Operators that run Python on executors call this first."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="corpusmill-pyfiles-"), "corpusmill.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)

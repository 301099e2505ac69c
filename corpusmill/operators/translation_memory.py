"""A translation memory that is kept, so that a sentence is translated once in all runs.

The memory is a Parquet table bucketed by the md5 of the sentence.  A run counts its sentences by their hash, finds those
that the memory lacks, translates them once each, appends them, and joins all rows to the memory.  The memory
is never shuffled: Spark plans both joins on its buckets, and only sentences and rows of the run move to them.

Sentences that make up a large share of the run's rows (greetings, empty captions) would fall to one bucket's task; there
are few of them by their count, and they are joined by a broadcast.

Null sentences have a null translation.  An append is one job commit: a run that fails leaves the memory as it was, and one
that is repeated finds what is there.  Two runs at once may both add a sentence; readers take the smaller of its
translations, so no row is doubled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.infer import PT_TOKEN, _model
from corpusmill.operators.partitioning import broadcast_if_small
from corpusmill.session import ship_package

MEMORY = "h binary, source string, target string, run string"
# a sentence is hot above this share of a bucket's mean number of rows
HOT_SHARE = 0.25


def _h(text: str):
    return F.unhex(F.md5(F.col(text)))


def open_memory(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """The name of the table kept in ``path``, declared in this session's catalog and created if it is not there.  ``buckets``
    (by default the session's shuffle partitions) must stay the same for one path."""
    name = "memory_" + hashlib.md5(path.encode()).hexdigest()
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({MEMORY}) USING parquet CLUSTERED BY (h) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def _entries(spark: SparkSession, name: str) -> DataFrame:
    """One row per sentence; the table's buckets serve the grouping, too."""
    first = F.min(F.struct("target", "run")).alias("e")
    return spark.table(name).groupBy("h").agg(first).select("h", "e.target", "e.run")


def _buckets(spark: SparkSession, name: str) -> int:
    detail = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Num Buckets'").first()
    return int(detail.data_type)


def _translated(factory, cache_key, token: str):
    def fn(batches):
        translator = _model(factory, cache_key)
        for pdf in batches:
            pdf["target"] = list(translator(token + " " + pdf["source"]))
            yield pdf
    return fn


def translate_kept(rows: DataFrame, translator_factory: Callable, memory: str, run: str, text: str = "original_sentence",
                   token: str = PT_TOKEN, out: str = "translated_sentence", run_col: str | None = None,
                   cache_key: str | None = None) -> DataFrame:
    """``rows`` with ``out``, the translation of ``text``, from the table ``memory`` (``open_memory``), to which the sentences that
    it lacks are added under the name ``run``.  ``run_col``: a column with the run that translated the
    sentence.  ``translator_factory()`` is made once per task (or worker, with ``cache_key``) and maps a batch of sentences,
    each behind ``token``, to their translations."""
    spark = rows.sparkSession
    ship_package(spark)
    buckets = _buckets(spark, memory)
    kept = rows.filter(F.col(text).isNotNull()).select(_h(text).alias("h"), F.col(text).alias("source"))

    # both aggregates combine before they shuffle: a hot sentence is one row per map task
    counts = kept.groupBy("h").count()
    sentences = kept.groupBy("h").agg(F.min("source").alias("source"))
    new = sentences.join(spark.table(memory).select("h"), "h", "left_anti")
    made = new.mapInPandas(_translated(translator_factory, cache_key, token), "h binary, source string, target string")
    (made.withColumn("run", F.lit(run)).repartition(buckets, "h").write.mode("append").format("parquet")
         .bucketBy(buckets, "h").saveAsTable(memory))
    return _joined(rows, counts, _entries(spark, memory), buckets, text, out, run_col)


def _joined(rows, counts, entries, buckets, text, out, run_col):
    total = counts.agg(F.sum("count")).first()[0] or 0
    # at most buckets / HOT_SHARE hashes are above it
    hot = [bytes(r.h) for r in counts.filter(F.col("count") > max(1, total * HOT_SHARE / buckets)).select("h").collect()]
    cols = [F.col("target").alias(out)] + ([F.col("run").alias(run_col)] if run_col else [])
    keyed = rows.withColumn("__h", _h(text))
    entries = entries.withColumnRenamed("h", "__h")
    if not hot:
        return keyed.join(entries, "__h", "left").select(*rows.columns, *cols)
    spark = rows.sparkSession
    flags = F.broadcast(spark.createDataFrame([(x,) for x in hot], "__h binary"))
    chosen = broadcast_if_small(entries.join(flags, "__h", "left_semi"))
    rare = keyed.join(flags, "__h", "left_anti").join(entries, "__h", "left")
    often = keyed.join(flags, "__h", "left_semi").join(chosen, "__h", "left")
    return often.unionByName(rare).select(*rows.columns, *cols)

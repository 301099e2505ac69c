"""Caption selection on a stream of scored samples.

D5-D7, D12 and D13 are per-row expressions with no state, so the same
Column expressions used in batch run under Structured Streaming: new sample
files arriving in a folder are selected and appended to a sink.  The
``availableNow`` trigger processes everything present and stops, which
makes the job restartable from its checkpoint (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import sample as SM
from corpusmill.operators import select as SEL

SCORED_SCHEMA = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("captions", T.ArrayType(T.StringType())),
    T.StructField("generated", T.ArrayType(T.StringType())),
    T.StructField("similarities", T.ArrayType(T.DoubleType())),
])


def select_captions(samples: DataFrame, strategy: str = "threshold", threshold: float = 0.2, k: int = 5,
                    seed: int = 0, epoch: int = 0) -> DataFrame:
    """Pool by strategy (``threshold`` = D7, ``ranking`` = D6), drop empty
    pools (D12) and draw one caption per sample (D13).  Works on a batch
    DataFrame and on a streaming one alike."""
    if strategy == "threshold":
        pool = SEL.above_threshold("captions", "similarities", threshold)
    elif strategy == "ranking":
        pool = SEL.top_k_by_similarity("captions", "similarities", k)
    else:
        raise ValueError(strategy)
    s = SEL.drop_empty(samples.withColumn("pool", pool), "pool")
    return s.withColumn("caption", SM.random_caption("pool", F.col("image_id").cast("string"), seed, epoch))


def run_selection_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                         **kwargs):
    """Stream Parquet files of scored samples from ``source_dir`` through
    ``select_captions`` into Parquet files in ``sink_dir``; returns the
    finished query (``availableNow``)."""
    src = spark.readStream.schema(SCORED_SCHEMA).parquet(source_dir)
    out = select_captions(src, **kwargs).select("image_id", "pool", "caption")
    q = (out.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return q

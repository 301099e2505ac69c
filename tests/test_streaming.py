"""The stateless selection runs the same on a stream as in batch."""
import os

from corpusmill.operators import similarity as S
from corpusmill.plans import views
from corpusmill.streaming import selection as ST

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmpdir_path):
    scored = S.scored_samples(views.img(spark, SF), views.caption_embeddings(spark, SF), views.ORIGINAL_CAPTIONS)
    src = os.path.join(tmpdir_path, "src")
    scored.repartition(3).write.parquet(src)
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    ST.run_selection_stream(spark, src, out, ck, strategy="threshold", threshold=0.15, seed=5)
    streamed = {(r.image_id, tuple(r.pool), r.caption) for r in spark.read.parquet(out).collect()}
    batch = {(r.image_id, tuple(r.pool), r.caption)
             for r in ST.select_captions(spark.read.parquet(src), "threshold", 0.15, seed=5).collect()}
    assert streamed == batch and len(batch) > 0
    # a second run finds nothing new: the checkpoint makes the sink exactly-once
    ST.run_selection_stream(spark, src, out, ck, strategy="threshold", threshold=0.15, seed=5)
    assert spark.read.parquet(out).count() == len(batch)

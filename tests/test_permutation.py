"""The keyed permutation: exact for every n, undone by its inverse, batches read on their own."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import permutation as PM


def test_exact_for_every_size():
    for n in [*range(1, 140), 999, 1000, 1024, 10_007]:
        p = PM.permuted(np.arange(n), n, 1, n % 5)
        assert sorted(p) == list(range(n))
        assert (PM.permuted(p, n, 1, n % 5, back=True) == np.arange(n)).all()


def test_large_numbers():
    for n in (10**10 + 7, PM.MAX_SAMPLES):
        x = np.random.default_rng(0).integers(0, n, 5000)
        p = PM.permuted(x, n, 9, 4)
        assert p.min() >= 0 and p.max() < n and len(set(p)) == len(set(x))
        assert (PM.permuted(p, n, 9, 4, back=True) == x).all()


def test_mixes_well_and_differs_by_epoch_and_seed():
    n = 20_000
    runs = [PM.permuted(np.arange(n), n, s, e) for s, e in ((0, 0), (0, 1), (1, 0))]
    for p in runs:
        assert abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.05          # no trace of the old order
        assert abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.05            # neighbours are parted
        filled = np.bincount(p[:n // 10] // 1000, minlength=20)        # a tenth of the samples spreads over all places
        assert filled.min() > 60 and filled.max() < 140
    assert (runs[0] == runs[1]).mean() < 0.01 and (runs[0] == runs[2]).mean() < 0.01


def test_batches(spark, tmp_path):
    n, size = 1003, 64
    spark.range(n).select(F.col("id").alias("idx"), F.format_string("s%d", "id").alias("name")).repartitionByRange(6, "idx") \
        .sortWithinPartitions("idx").write.parquet(str(tmp_path / "s"))
    samples = spark.read.parquet(str(tmp_path / "s"))
    every = PM.epoch_batches(samples, n, size, seed=2, epoch=7)
    assert "Exchange" not in every._jdf.queryExecution().executedPlan().toString()
    rows = every.collect()
    assert sorted((r.batch_id, r.slot) for r in rows) == [(i // size, i % size) for i in range(n)]
    for b in (0, 3, n // size, n // size + 1):
        one = PM.read_batch(samples, n, size, b, seed=2, epoch=7)
        assert [(r.name, r.slot) for r in one.collect()] == sorted(((r.name, r.slot) for r in rows if r.batch_id == b), key=lambda x: x[1])
        if b == 3:
            assert "PushedFilters: [In(idx" in one._jdf.queryExecution().toString()


def test_columns_and_cases(spark):
    df = spark.createDataFrame([(0,), (None,), (4,)], "idx long")
    got = df.select("idx", PM.places("idx", 5, 1, 2).alias("p")).withColumn("i", PM.numbers_at("p", 5, 1, 2)).collect()
    assert all(r.i == r.idx for r in got) and [r.p is None for r in got] == [False, True, False]
    assert PM.permuted(np.array([0]), 1, 0, 0).tolist() == [0] and PM.permuted(np.array([], np.int64), 3, 0, 0).tolist() == []
    for bad in (-1, 5):
        with pytest.raises(ValueError, match="outside"):
            PM.permuted(np.array([bad]), 5, 0, 0)
    with pytest.raises(ValueError):
        PM.permuted(np.array([0]), 0, 0, 0)

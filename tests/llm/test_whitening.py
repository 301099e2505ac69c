"""Whitening: against numpy on the distinct vectors."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import joins
from corpusmill.llm import whitening as W
from corpusmill.llm.queries import op11_embedding_whitening

EMB = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("label", T.IntegerType())])


def restated(vectors, weights="one", k=16):
    """{x: (n, deviation, whitened)}, explained."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    cells = sorted(set(x))
    w = [1 if weights == "one" else x.count(c) for c in cells]
    n, s = sum(w), [sum(a * b for a, b in zip(w, col)) for col in zip(*cells)]
    y = np.array([[(n * a - b) / n for a, b in zip(c, s)] for c in cells])
    v = (y * np.array(w)[:, None]).T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    dev = [sum((n * a - b) ** 2 for a, b in zip(c, s)) for c in cells]
    return {c: (n, d, z) for c, d, z in zip(cells, dev, y @ q / np.sqrt(e))}, e / np.trace(v), x


def same_but_for_sign(got, want):
    got, want = np.array(got), np.array(want)
    sign = np.sign((got * want).sum(axis=0))
    return np.allclose(got * sign, want, atol=1e-6)


@pytest.mark.parametrize("hot_share", [2, 512, 10 ** 9])
def test_embeddings(spark, sf, monkeypatch, hot_share):
    monkeypatch.setattr(joins, "HOT_SHARE", hot_share)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, explained, x = restated([r.embedding for r in rows])
    of = dict(zip([r.vec_id for r in rows], x))
    got = op11_embedding_whitening(spark, sf).collect()
    assert len(got) == 16 * len(rows) and len({(r.vec_id, r.component) for r in got}) == len(got)
    by = {}
    for r in got:
        assert (r.n, r.deviation) == want[of[r.vec_id]][:2] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        by.setdefault(r.vec_id, {})[r.component] = r.whitened
    ids = sorted(by)
    assert same_but_for_sign([[by[i][c] for c in range(1, 17)] for i in ids], [want[of[i]][2] for i in ids])


@pytest.mark.parametrize("weights", ["one", "count"])
def test_hot_vector_and_bad_rows(spark, weights):
    rnd = np.random.default_rng(4)
    # each vector lies inside a cell of width 1/64, far from its edge
    cells = np.unique(rnd.integers(-300, 300, (60, 5)), axis=0)
    rows = [(i, [float(v) for v in (c + 0.5) / 64], None) for i, c in enumerate(cells)]
    rows += [(1000 + i, rows[7][1], 3) for i in range(200)] + [(None, rows[8][1], 1)] * 3
    bad = [(1, None, 1), (2, [1.0, None, 0.0, 0.0, 0.0], 1), (3, [float("nan")] + [0.0] * 4, 1),
           (4, [float("-inf")] + [0.0] * 4, None)]
    df = spark.createDataFrame(rows + bad, EMB).withColumns({"x": F.lit(1), "n": F.lit(2), "whitened": F.lit("z")})
    got = W.whiten(df.repartition(7), weights=weights, components=4).collect()
    want, explained, x = restated([r[1] for r in rows], weights, 4)
    assert len(got) == len(rows) and got[0].n == (len(cells) if weights == "one" else len(rows))
    assert np.allclose(got[0].explained, explained)
    assert got[0].identity_error < 1e-9
    of = {r[0]: c for r, c in zip(rows, x)}
    assert sorted(r.deviation for r in got) == sorted(want[c][1] for c in x)
    assert same_but_for_sign([r.whitened for r in got], [want[of[r.vec_id]][2] for r in got])


def test_cases(spark):
    make = lambda rows: spark.createDataFrame([(i, v, None) for i, v in rows], EMB)
    assert W.whiten(make([])).count() == 0 and W.whiten(make([(1, None)])).count() == 0
    one = W.whiten(make([(1, [0.5, 1.0]), (1, [0.5, 1.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None] * 2, [0.0] * 2, None)] * 2
    # the second dimension never varies
    flat = W.whiten(make([(i, [float(i), 2.0]) for i in range(5)])).collect()
    assert all(r.whitened[1] is None and r.whitened[0] is not None and r.identity_error < 1e-9 for r in flat)
    assert flat[0].explained == [1.0, 0.0]
    assert [r.whitened for r in W.whiten(make([(1, [])])).collect()] == [[]]
    with pytest.raises(Exception, match="different lengths"):
        W.whiten(make([(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="beyond|overflow"):
        W.whiten(make([(1, [1e30]), (2, [1.0])]))
    # exact where products leave the range of long, null beyond it
    far = W.whiten(make([(1, [3e8]), (2, [0.0])])).collect()
    assert [r.deviation for r in far] == [None if d >= 2 ** 63 else d for d in [(64 * 300000000) ** 2] * 2]


def test_integers_beyond_long():
    x = np.array([[2 ** 51, 5], [-2 ** 51, 7]])
    assert W._centred(x, 10 ** 6, [3, 10 ** 20]).tolist() == [[a * 10 ** 6 - s for a, s in zip(r, [3, 10 ** 20])] for r in x.tolist()]

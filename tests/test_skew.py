"""Hot keys: one image / caption / class holding a third or more of all rows
gives the same answer as brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus as CP
from corpusmill.operators import diversity as DV
from corpusmill.operators import metrics as M
from corpusmill.operators import zeroshot as Z
from corpusmill.operators.indexing import global_index

WORDS = ["cat", "dog", "sofa", "red", "blue", "house", "tree", "car", "sun", "moon", "sea", "hill"]


def test_tfidf_hot_image(spark):
    rng = np.random.default_rng(7)
    rows = []
    for img, n in [(0, 600)] + [(i, int(rng.integers(1, 6))) for i in range(1, 200)]:
        for p in range(n):
            rows.append((img, p, " ".join(rng.choice(WORDS, size=int(rng.integers(1, 5))))))
    df = spark.createDataFrame(rows, "image long, pos long, text string")
    hot = [r for r in rows if r[0] == 0]
    assert len(hot) * 3 >= len(rows)
    w = {(r.pos, r.token): r.w for r in DV.tfidf(df).filter("image = 0").collect()}
    caps = [t for _, _, t in hot]
    toks = [t.split() for t in caps]
    vocab = sorted({t for ts in toks for t in ts})
    tf = np.array([[ts.count(v) for v in vocab] for ts in toks], dtype=float)
    idf = np.log((1 + len(caps)) / (1 + (tf > 0).sum(0))) + 1
    W = tf * idf
    W /= np.linalg.norm(W, axis=1, keepdims=True)
    for p in range(0, 600, 37):
        for j, v in enumerate(vocab):
            if tf[p, j] > 0:
                assert w[(p, v)] == pytest.approx(W[p, j])


def test_dedup_hot_caption(spark):
    rows = [(i, "same" if i % 3 == 0 else f"c{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "idx long, cap string")
    kept = {r.idx for r in CP.dedup_keep_first(df, "cap", "idx").collect()}
    assert 0 in kept and 3 not in kept and len(kept) == 2000 + 1


def test_prototypes_hot_class(spark):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(900, 6))
    cls = np.where(np.arange(900) < 400, 0, np.arange(900) % 7 + 1)
    df = spark.createDataFrame([(int(c), [float(v) for v in x]) for c, x in zip(cls, X)], "class_idx long, vec array<double>")
    got = {r.class_idx: r.vec for r in Z.class_prototypes(df, "c").collect()}
    m = X[cls == 0].mean(0)
    assert np.allclose(got[0], m / np.linalg.norm(m))


def test_auc_many_ties_and_hot_score(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 3000)
    s = np.where(np.arange(3000) < 1200, 0.5, rng.integers(0, 50, 3000) / 10)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = M.roc_auc(df).first().auc
    pos, neg = s[y == 1], s[y == 0]
    ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(ref)


def test_global_index_with_duplicate_leading_key(spark):
    df = spark.range(0, 3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")))
    idx = global_index(df, ["k", "id"], col="idx").select("k", "id", "idx").collect()
    order = sorted(idx, key=lambda r: (r.k, r.id))
    assert [r.idx for r in order] == list(range(3000))

"""Blocked exact top-k scoring against brute force, and the metrics."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics as M
from corpusmill.operators import similarity as S
from corpusmill.operators import zeroshot as Z


def _frame(spark, ids, X, name):
    return spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, X)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("block", [3, 7, 1024])
def test_topk_matches_bruteforce(spark, block):
    rng = np.random.default_rng(1)
    Q, C = rng.normal(size=(23, 5)), rng.normal(size=(41, 5))
    C[5] = C[6]                                       # an exact tie: smaller id first
    q = _frame(spark, range(23), Q, "query_id")
    c = _frame(spark, range(100, 141), C, "cand_id")
    got = S.topk_scores(q, c, 4, block_size=block).collect()
    S_ = Q @ C.T
    for r in got:
        order = np.lexsort((np.arange(41), -np.round(S_[r.query_id], 9)))
        assert r.cand_id == 100 + order[r.rank - 1]
    assert len(got) == 23 * 4


def test_topk_groups_never_cross(spark):
    rng = np.random.default_rng(2)
    rows_q = [(g, i, [float(x) for x in rng.normal(size=3)]) for g in ("a", "b") for i in range(5)]
    rows_c = [(g, 10 * (g == "b") + j, [float(x) for x in rng.normal(size=3)]) for g in ("a", "b") for j in range(4)]
    q = spark.createDataFrame(rows_q, "g string, query_id long, vec array<double>")
    c = spark.createDataFrame(rows_c, "g string, cand_id long, vec array<double>")
    got = S.topk_scores(q, c, 2, group_cols=["g"], block_size=2).collect()
    for r in got:
        assert (r.cand_id >= 10) == (r.g == "b")
    assert len(got) == 2 * 5 * 2


def test_recall_monotone_in_k(spark):
    rng = np.random.default_rng(3)
    im = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(20)], "image_id long, vec array<double>")
    tx = spark.createDataFrame([(100 + j, j % 20, [float(x) for x in rng.normal(size=8)]) for j in range(60)],
                               "text_id long, image_id long, vec array<double>")
    rep = {(r.direction, r.k): r.recall for r in Z.retrieval_report(im, tx, ks=(1, 5, 10, 20)).collect()}
    for d in ("image_retrieval", "text_retrieval"):
        vals = [rep[(d, k)] for k in (1, 5, 10, 20)]
        assert vals == sorted(vals)
    assert rep[("image_retrieval", 20)] == 1.0


def test_roc_auc_ties_count_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert M.roc_auc(df).first().auc == pytest.approx((1 + 1 + 1 + 0.5) / 4)
    bad = spark.createDataFrame([(2, 0.5)], "label int, score double")
    with pytest.raises(ValueError):
        M.roc_auc(bad)


def test_map_11_point_matches_numpy(spark):
    rng = np.random.default_rng(4)
    n, k = 40, 4
    P = rng.random((n, k))
    y = rng.integers(0, k, n)
    scores = spark.createDataFrame([(i, c, float(P[i, c])) for i in range(n) for c in range(k)],
                                   "image_id long, class_idx long, prob double")
    labels = spark.createDataFrame([(i, c, int(y[i] == c)) for i in range(n) for c in range(k)],
                                   "image_id long, class_idx long, present int")
    got = M.map_11_point(scores, labels).first().map
    aps = []
    for c in range(k):
        o = np.lexsort((np.arange(n), -P[:, c]))
        t = (y[o] == c).astype(float)
        if t.sum() == 0:
            continue
        tp = np.cumsum(t)
        rec, prec = tp / t.sum(), tp / np.arange(1, n + 1)
        aps.append(np.mean([prec[rec >= th - 1e-12].max() if (rec >= th - 1e-12).any() else 0
                            for th in np.linspace(0, 1, 11)]))
    assert got == pytest.approx(np.mean(aps))


def test_prototype_variant_b_skips_single_prompt(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])], "class_idx long, vec array<double>")
    got = {r.class_idx: r.vec for r in Z.class_prototypes(df, "b").collect()}
    assert got[0] == [3.0, 4.0]
    assert got[1] == pytest.approx([2 ** -0.5, 2 ** -0.5])
    a = {r.class_idx: r.vec for r in Z.class_prototypes(df, "a").collect()}
    assert a[0] == pytest.approx([0.6, 0.8])


def test_in_batch_loss_matches_numpy(spark):
    rng = np.random.default_rng(5)
    I, T = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    rows = [(0, i, [float(x) for x in I[i]], [float(x) for x in T[i]]) for i in range(6)]
    df = spark.createDataFrame(rows, "batch_id long, pair_id long, img_vec array<double>, txt_vec array<double>")
    got = M.in_batch_metrics(df, 20.0).first()
    L = 20 * I @ T.T

    def ce(M_):
        m = M_.max(1, keepdims=True)
        return np.mean(np.log(np.exp(M_ - m).sum(1)) + m[:, 0] - np.diag(M_))
    assert got.loss == pytest.approx((ce(L) + ce(L.T)) / 2)


def test_zero_vector_normalises_to_null(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, vec array<double>")
    r = {x.id: x for x in S.l2_normalize(df).collect()}
    assert r[0].vec is None and r[0].vec_is_zero
    assert r[1].vec == pytest.approx([0.6, 0.8])


def test_retrieve_by_free_text(spark):
    from corpusmill.operators import infer as INF
    texts = spark.createDataFrame([(0, "red cat"), (1, "blue sea")], "query_id long, text string")
    docs = spark.createDataFrame([(10, "a red cat"), (11, "the blue sea"), (12, "green hill")], "image_id long, text string")
    cands = INF.embed(docs, "text", lambda: INF.hashed_bow_encoder(16)).select("image_id", "vec")
    got = {(r.query_id, r.rank): r.image_id
           for r in Z.retrieve_by_text(texts, lambda: INF.hashed_bow_encoder(16), cands, 1).collect()}
    assert got == {(0, 1): 10, (1, 1): 11}


def test_zero_vectors_and_empty_sides(spark):
    """A zero vector is no candidate and finds nothing, but counts as a query; empty sides give recall 0 or null."""
    from corpusmill.operators import zeroshot as Z
    im = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 1.0])], "image_id bigint, vec array<double>")
    tx = spark.createDataFrame([(10, 0, [1.0, 0.1]), (11, 2, [0.0, 0.0]), (12, 2, [0.1, 1.0])],
                               "text_id bigint, image_id bigint, vec array<double>")
    got = {(r.direction, r.k): r.recall for r in Z.retrieval_report(im, tx).collect()}
    assert got[("image_retrieval", 1)] == 2 / 3 and got[("text_retrieval", 10)] == 2 / 3
    empty = {(r.direction, r.k): r.recall for r in Z.retrieval_report(im, tx.limit(0)).collect()}
    assert empty[("image_retrieval", 1)] is None and empty[("text_retrieval", 1)] == 0.0


def test_missing_scores_and_results_fail(spark):
    import pytest
    from corpusmill.operators import metrics as M
    scores = spark.createDataFrame([(0, 0, 2.0, True), (0, 1, 1.0, False), (1, 0, 1.0, False)],
                                   "image_id bigint, class_idx bigint, logit double, is_pos boolean")
    targets = spark.createDataFrame([(0, 0), (1, 5)], "image_id bigint, target bigint")
    with pytest.raises(Exception, match="no score for the class of image 1"):
        M.classification_loss(scores, targets).collect()
    assert M.classification_loss(scores, targets.limit(1)).first().accuracy == 1.0
    results = spark.createDataFrame([("d1", "accuracy", 0.5)], "dataset string, metric string, value double")
    meta = lambda *rows: spark.createDataFrame(rows, "dataset string, metric string")
    assert M.dispatch(results, meta(("d1", "accuracy"))).first().result == 50.0
    with pytest.raises(Exception, match="no result for dataset d2"):
        M.dispatch(results, meta(("d2", "accuracy"))).collect()
    with pytest.raises(Exception, match="unknown metric"):
        M.dispatch(results, meta(("d1", "speed"))).collect()


def test_scored_samples_keep_both_sides(spark):
    from corpusmill.operators import similarity as S
    im = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "image_id bigint, vec array<double>")
    cap = spark.createDataFrame([(0, 0, "a", [1.0, 0.0]), (7, 0, "lost", [1.0, 0.0])],
                                "image_id bigint, pos bigint, text string, vec array<double>")
    got = {r.image_id: (r.captions, r.similarities) for r in S.scored_samples(im, cap, 1).collect()}
    assert got == {0: (["a"], [1.0]), 1: ([], []), 7: (["lost"], [None])}


def test_broadcast_and_grid_sides_agree(spark):
    """The shuffle side meets every pair of blocks once: the same rows as the broadcast side."""
    from corpusmill.operators import similarity as S
    rng = np.random.default_rng(11)
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(90)], "query_id bigint, vec array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(70)], "cand_id bigint, vec array<double>")
    rows = lambda b: sorted((r.query_id, r["rank"], r.cand_id) for r in
                            S.topk_scores(q, c, 5, block_size=16, broadcast_bytes=b).collect())
    assert rows(0) == rows(1 << 20) and len(rows(0)) == 450


def test_blocks_are_scored_without_python_objects():
    """One batch of 40 pairs of blocks: what Python holds at once is that of one pair, and the result is exact."""
    import tracemalloc

    import pyarrow as pa
    from corpusmill.operators import similarity as S
    rng = np.random.default_rng(12)
    n, d, pairs = 256, 32, 40

    def blocks():
        X = rng.normal(size=(pairs * n, d))
        rows = pa.StructArray.from_arrays(
            [pa.array(rng.permutation(pairs * n)), pa.array([None if i % 9 == 0 else i for i in range(pairs * n)], pa.int64()),
             pa.nulls(pairs * n, pa.float64()), pa.FixedSizeListArray.from_arrays(pa.array(X.ravel()), d).cast(pa.list_(pa.float64()))],
            ["id", "key", "x", "v"])
        return X.reshape(pairs, n, d), pa.ListArray.from_arrays(pa.array(np.arange(pairs + 1) * n, pa.int32()), rows)

    (Q, q), (C, c) = blocks(), blocks()
    batch = pa.RecordBatch.from_arrays([q, c], ["q_rows", "c_rows"])
    out, most = [], 0
    tracemalloc.start()
    for part in S._block_topk_fn(3, 1.0)(iter([batch])):
        out.append(part.select(["q", "c", "score", "rank", "q_key"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == pairs and most < 8e6
    for r in (0, 7, 39):
        scores = Q[r] @ C[r].T
        ids = q[r].values.field("id").to_numpy()
        cids = c[r].values.field("id").to_numpy()
        best = np.argsort(-scores, axis=1)[:, :3]
        assert out[r]["q"].to_numpy().tolist() == np.repeat(ids, 3).tolist()
        assert out[r]["c"].to_numpy().tolist() == cids[best].ravel().tolist()
        assert out[r]["q_key"].to_pylist() == np.repeat(np.array(q[r].values.field("key").to_pylist(), dtype=object), 3).tolist()

"""Caption selection quirks (D5-D7, D10) and the greedy loop against a
restatement of the rule."""
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import diversity as DV
from corpusmill.operators import select as SEL


def _one(spark, caps, sims):
    return spark.createDataFrame([(caps, sims)], "c array<string>, s array<double>")


def test_rank_filter_ties_take_larger_index_ascending(spark):
    df = _one(spark, ["a", "b", "c", "d"], [0.5, 0.1, 0.5, 0.3])
    got = df.select(SEL.top_k_by_similarity("c", "s", 2).alias("x")).first().x
    assert got == ["a", "c"]          # equal sims: larger index last, output ascending
    got = df.select(SEL.top_k_by_similarity("c", "s", 3).alias("x")).first().x
    assert got == ["d", "a", "c"]


def test_rank_filter_k_larger_than_list_and_empty(spark):
    df = _one(spark, ["a", "b"], [0.2, 0.1])
    assert df.select(SEL.top_k_by_similarity("c", "s", 5).alias("x")).first().x == ["b", "a"]
    e = _one(spark, [], [])
    assert e.select(SEL.top_k_by_similarity("c", "s", 5).alias("x")).first().x == []
    with pytest.raises(ValueError):
        SEL.top_k_by_similarity_pos("c", "s", 0)


def test_threshold_filter_zip_stops_at_shorter(spark):
    df = _one(spark, ["a", "b", "c"], [0.3, 0.1])
    assert df.select(SEL.above_threshold("c", "s", 0.2).alias("x")).first().x == ["a"]
    df = _one(spark, ["a", "b"], [0.2, 0.19999, 0.9])
    assert df.select(SEL.above_threshold("c", "s", 0.2).alias("x")).first().x == ["a"]


def test_caption_pool_strategies(spark):
    df = spark.createDataFrame([(["p1", "p2", "p3"], ["g1", "g2", "g3"])], "c array<string>, g array<string>")
    r = df.select(SEL.caption_pool("c", "g", "pt", None).alias("a"), SEL.caption_pool("c", "g", "pt", "all").alias("b"),
                  SEL.caption_pool("c", "g", "en", 2).alias("c2")).first()
    assert r.a == ["p1", "p2"] and r.b == ["p1", "p2", "g1", "g2", "g3"] and r.c2 == ["p1", "g1", "g2"]


def _tfidf_dense(caps):
    """sklearn-default TF-IDF + cosine, in numpy."""
    import regex
    pat = regex.compile(r"[\p{L}\p{N}_]{2,}")
    toks = [pat.findall(c.lower()) for c in caps]
    vocab = sorted({t for ts in toks for t in ts})
    n = len(caps)
    tf = np.array([[ts.count(v) for v in vocab] for ts in toks], dtype=float).reshape(n, len(vocab))
    df = (tf > 0).sum(0)
    idf = np.log((1 + n) / (1 + df)) + 1
    w = tf * idf
    nrm = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.divide(w, nrm, out=np.zeros_like(w), where=nrm > 0)
    return w @ w.T, nrm[:, 0] > 0


def _pruned(caps, k_min=3, limit=0.3, drop_isolated=False):
    """The rule in words: as long as two live captions are more alike than
    ``limit`` and more than ``k_min`` are live, the live caption with the
    largest summed similarity to the others goes (the first of equals).
    A caption without tokens counts -1 for itself.  With ``drop_isolated``,
    captions whose sum is zero at the end go as well."""
    if len(caps) < k_min:
        return list(range(len(caps)))
    dense, has = _tfidf_dense(caps)
    if not has.any():
        return list(range(len(caps)))
    alike = {frozenset((i, j)): dense[i, j] for i in range(len(caps)) for j in range(i)}
    live = set(range(len(caps)))

    def summed(i):
        own = 0.0 if has[i] else -1.0
        return own + sum(alike[frozenset((i, j))] for j in live if j != i)

    while len(live) > k_min and any(alike[frozenset((i, j))] > limit for i in live for j in live if j < i):
        live.remove(min(live, key=lambda i: (-round(summed(i), 9), i)))
    return [i for i in sorted(live) if not drop_isolated or summed(i) != 0]


WORDS = ["cat", "dog", "sofa", "red", "blue", "house", "tree", "car", "sun", "moon"]


@pytest.mark.parametrize("seed", range(6))
def test_greedy_prune_matches_dense_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    expected = set()
    for img in range(8):
        n = int(rng.integers(1, 9))
        caps = [" ".join(rng.choice(WORDS, size=int(rng.integers(0, 4)))) for _ in range(n)]
        for p, c in enumerate(caps):
            rows.append((img, p, c))
        expected |= {(img, p) for p in _pruned(caps)}
    df = spark.createDataFrame(rows, "image long, pos long, text string")
    got = {(r.image, r.pos) for r in DV.prune_similar(df, 3, 0.3).collect()}
    assert got == expected


@pytest.mark.parametrize("drop_isolated", [False, True])
def test_sum_vector_loop_matches_dense_loop(drop_isolated):
    """The loop alone, on more and longer captions, with repeated ones and captions without tokens."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        caps = [" ".join(rng.choice(WORDS, size=int(rng.integers(0, 6)))) for _ in range(int(rng.integers(1, 40)))]
        dense, has = _tfidf_dense(caps)
        lines = [sorted(set(re.findall(r"\b\w\w+\b", c))) for c in caps]
        n, df = len(caps), {t: sum(t in x for x in lines) for x in lines for t in x}
        rows = []
        for i, c in enumerate(caps):
            raw = {t: c.split().count(t) * (np.log((1 + n) / (1 + df[t])) + 1) for t in lines[i]}
            norm = np.sqrt(sum(v * v for v in raw.values()))
            rows += [(i, sorted(df).index(t), v / norm) for t, v in raw.items()]
        caption, token, w = (np.array([r[k] for r in rows], dtype=kind) for k, kind in enumerate((int, int, float)))
        keep = DV.greedy_prune(n, caption, token, w, 3, 0.3, drop_isolated)
        assert np.flatnonzero(keep).tolist() == _pruned(caps, drop_isolated=drop_isolated)


def test_hot_image_in_linear_memory():
    """100,000 captions that share a word, some of them alike: all pairs would be 5 x 10^9."""
    n = 100_000
    group = np.arange(n) // 2 * (np.arange(n) < 40)               # the first 40 are 20 pairs of equal captions
    own = np.where(np.arange(n) < 40, group, np.arange(n)) + 1
    caption, token = np.repeat(np.arange(n), 2), np.stack([np.zeros(n, np.int64), own], 1).ravel()
    w = np.tile([0.1, np.sqrt(0.99)], n)
    tracemalloc.start()
    keep = DV.greedy_prune(n, caption, token, w)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert np.flatnonzero(~keep).tolist() == list(range(0, 40, 2))


def test_similar_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(img, p, " ".join(rng.choice(WORDS + ["the"] * 20, size=int(rng.integers(0, 7))))) for img in range(6) for p in range(30)]
    w = DV.tfidf(spark.createDataFrame(rows, "image long, pos long, text string"))
    for thr in (0.1, 0.3, 0.7):
        got = {(r.image, r.pos_a, r.pos_b): round(r.sim, 9) for r in DV.similar_pairs(w, thr).collect()}
        assert got == {(r.image, r.pos_a, r.pos_b): round(r.sim, 9) for r in DV.pair_similarity(w).filter(f"sim > {thr}").collect()}
    many = DV.prefixes(w, 0.7).groupBy("image", "token").count().filter("token = 'the'").agg({"count": "max"}).first()[0] or 0
    assert many < 30


def test_drop_isolated_reproduces_reference_final_step(spark):
    caps = ["red cat on sofa", "red cat on a sofa", "blue house", "green tree"]
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(caps)], "image long, pos long, text string")
    kept_default = sorted(r.pos for r in DV.prune_similar(df, 3, 0.3).collect())
    kept_ref = sorted(r.pos for r in DV.prune_similar(df, 3, 0.3, drop_isolated=True).collect())
    assert kept_default == [1, 2, 3]
    assert kept_ref == []                          # the n=4 case of the survey ends empty


def test_fewer_than_k_min_kept_whole(spark):
    df = spark.createDataFrame([(0, 0, "red cat"), (0, 1, "red cat")], "image long, pos long, text string")
    assert DV.prune_similar(df, 3, 0.3).count() == 2


def test_pool_after_pruning_at_least_min(spark):
    caps = ["a cat", "a cat sits", "the cat sits", "cat sits here", "cat"]
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(caps)], "image long, pos long, text string")
    assert DV.prune_similar(df, 3, 0.3).count() >= 3


@pytest.mark.parametrize("seed", range(3))
def test_drop_isolated_matches_dense_loop(spark, seed):
    rng = np.random.default_rng(100 + seed)
    rows, expected = [], set()
    for img in range(8):
        n = int(rng.integers(2, 9))
        caps = [" ".join(rng.choice(WORDS, size=int(rng.integers(0, 4)))) for _ in range(n)]
        rows += [(img, p, c) for p, c in enumerate(caps)]
        expected |= {(img, p) for p in _pruned(caps, drop_isolated=True)}
    df = spark.createDataFrame(rows, "image long, pos long, text string")
    got = {(r.image, r.pos) for r in DV.prune_similar(df, 3, 0.3, drop_isolated=True).collect()}
    assert got == expected


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def _some_captions(spark, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(img, p, " ".join(rng.choice(WORDS, size=int(rng.integers(0, 7)))))
                                  for img in range(9) for p in range(12)], "image long, pos long, text string")


def test_tfidf_shuffles_captions_once_and_no_tokens(spark):
    df = _some_captions(spark, 21)
    w = DV.tfidf(df)
    assert _shuffles(w) == 1
    assert _shuffles(DV.tfidf(df.withColumn("n", F.lit(12)), n_col="n")) == 1
    mine = [r for r in w.collect() if r.image == 4]
    caps = [r.text for r in df.filter("image = 4").orderBy("pos").collect()]
    dense, has = _tfidf_dense(caps)
    got = np.zeros((len(caps), len(WORDS)))
    for r in mine:
        got[r.pos, WORDS.index(r.token)] = r.w
    assert np.allclose(got @ got.T, dense) and {r.pos for r in mine} == set(np.flatnonzero(has))


def test_pair_similarity_shuffles_nothing_more(spark):
    df = _some_captions(spark, 22)
    pairs = DV.pair_similarity(DV.tfidf(df))
    assert _shuffles(pairs) == 1
    caps = [r.text for r in df.filter("image = 4").orderBy("pos").collect()]
    dense, _ = _tfidf_dense(caps)
    got = {(r.pos_a, r.pos_b): r.sim for r in pairs.collect() if r.image == 4}
    assert got.keys() == {(i, j) for i in range(12) for j in range(i + 1, 12) if dense[i, j] > 0}
    assert all(abs(v - dense[k]) < 1e-9 for k, v in got.items())


def test_similar_pairs_shuffles_and_writes_nothing_more(spark):
    assert _shuffles(DV.similar_pairs(DV.tfidf(_some_captions(spark, 23)))) == 1


def _entries(rng, n, most):
    """Random unit weights of ``n`` captions: arrays caption, token, w; and as a matrix."""
    dense = np.zeros((n, len(WORDS)))
    for i in range(n):
        t = rng.choice(len(WORDS), size=int(rng.integers(0, most)), replace=False)
        dense[i, t] = rng.random(len(t)) + 0.01
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=dense, where=norm > 0)
    caption, token = np.nonzero(dense)
    return caption, token, dense[caption, token], dense


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_near_pairs_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(DV, "PIECE", piece)
    rng = np.random.default_rng(24)
    for n in (1, 2, 17, 40):
        caption, token, w, dense = _entries(rng, n, 6)
        if not len(token):
            continue
        got = {(a, b): s for x in DV._Captions(n, caption, token, w, 0.3).near(0.3) for a, b, s in zip(*x)}
        sim = dense @ dense.T
        assert got.keys() == {(i, j) for i in range(n) for j in range(i + 1, n) if sim[i, j] > 0.3}
        assert all(abs(s - sim[k]) < 1e-12 for k, s in got.items())


def test_near_pairs_of_hot_image_in_linear_memory():
    """50,000 captions that share a word: its 1.25 x 10^9 pairs are not met."""
    n = 50_000
    own = np.arange(n) - (np.arange(n) < 40) * (np.arange(n) % 2) + 1     # the first 40 are 20 pairs of equal captions
    caption, token = np.repeat(np.arange(n), 2), np.stack([np.zeros(n, np.int64), own], 1).ravel()
    w = np.tile([0.1, np.sqrt(0.99)], n)
    tracemalloc.start()
    got = [(int(a), int(b)) for x in DV._Captions(n, caption, token, w, 0.3).near(0.3) for a, b in zip(x[0], x[1])]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert got == [(i, i + 1) for i in range(0, 40, 2)]


def test_prune_cuts_no_weights_and_shuffles_no_tokens(spark):
    kept = DV.prune_similar(_some_captions(spark, 25)).select("image", "pos")
    assert _shuffles(kept) == 3      # the texts by image, then only the positions of captions for the last join


@pytest.mark.parametrize("seed", range(3))
def test_matrix_and_sum_vector_loops_agree(monkeypatch, seed):
    rng = np.random.default_rng(200 + seed)
    for n in (3, 9, 40):
        caption, token, w, _ = _entries(rng, n, 5)
        a = DV.greedy_prune(n, caption, token, w)
        with monkeypatch.context() as m:
            m.setattr(DV, "PIECE", 0)
            assert np.array_equal(a, DV.greedy_prune(n, caption, token, w))

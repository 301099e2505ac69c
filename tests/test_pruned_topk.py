"""Pruned top-k: equal to all scores for every k, and most block pairs of clustered vectors are skipped."""
import numpy as np
import pytest

from corpusmill.operators import pruned_topk as P
from corpusmill.operators import similarity as S
from corpusmill.operators import zeroshot as Z


def frame(spark, vectors, name, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} bigint, vec array<double>")


def clustered(rnd, n, centres, noise):
    return centres[rnd.integers(0, len(centres), n)] + rnd.normal(scale=noise, size=(n, centres.shape[1]))


@pytest.mark.parametrize("k", [1, 7, 500])
@pytest.mark.parametrize("kind", ["clustered", "spread", "equal"])
def test_equals_all_scores(spark, kind, k):
    rnd = np.random.default_rng(k)
    centres = rnd.normal(size=(12, 8)) * 5
    if kind == "clustered":
        c, q = clustered(rnd, 300, centres, 0.1), clustered(rnd, 60, centres, 0.1)
    elif kind == "spread":
        c, q = rnd.normal(size=(200, 8)), rnd.normal(size=(50, 8))
    else:
        c, q = np.repeat(centres[:3], 60, axis=0), centres[:3]      # ties go to the smaller id
    cand, quer = frame(spark, [*c, None], "cand_id"), frame(spark, [*q, None], "query_id", 1000)
    got = P.topk_scores(quer, cand, k, scale=10.0, block_size=20).collect()
    want = S.topk_scores(quer, cand, k, scale=10.0, block_size=64).collect()
    key = lambda r: (r.query_id, r["rank"], r.cand_id, round(r.score, 6))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == len(q) * min(k, len(c))


def test_share_of_pairs_skipped(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(30, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    c, q = clustered(rnd, 3000, centres, 0.01), clustered(rnd, 600, centres, 0.01)
    counts = {}
    P.topk_scores(frame(spark, q, "query_id"), frame(spark, c, "cand_id"), 5, block_size=100, counts=counts).collect()
    assert counts["met"] < 0.35 * counts["pairs"], counts


def test_empty_sides(spark):
    some, none = frame(spark, np.eye(3), "cand_id"), frame(spark, [], "cand_id")
    q = frame(spark, np.eye(3), "query_id")
    assert P.topk_scores(q, none, 2).count() == 0 and P.topk_scores(q.limit(0), some, 2).count() == 0
    with pytest.raises(ValueError):
        P.topk_scores(q, some, 0)


def lists_by_definition(queries, candidates, k):
    """{query: [(rank, candidate)]}: cosine of every pair, ties to the smaller id."""
    unit = lambda rows: {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    q, c = unit(queries), unit(candidates)
    return {i: [(n + 1, j) for n, j in enumerate(sorted(c, key=lambda j: (-round(float(q[i] @ c[j]), 10), j))[:k])] for i in q}


def pruned_lists(queries, candidates, q_id, c_id):
    out = {}
    for r in Z.retrieval_list(queries, candidates, 3, q_id, c_id, prune=True).collect():
        out.setdefault(r[q_id], []).append((r["rank"], r[c_id]))
    return {i: sorted(x) for i, x in out.items()}


def test_texts_to_images(spark):
    """The pruned list of every text, blocks read as they leave the join."""
    rnd = np.random.default_rng(3)
    texts, images = list(enumerate(rnd.normal(size=(9, 4)).tolist(), 50)), list(enumerate(rnd.normal(size=(14, 4)).tolist()))
    got = pruned_lists(spark.createDataFrame(texts, "text_id bigint, vec array<double>"),
                       spark.createDataFrame(images, "image_id bigint, vec array<double>"), "text_id", "image_id")
    assert got == lists_by_definition(texts, images, 3)


def test_images_to_texts(spark):
    """The other direction, several texts alike for one image: ties go to the smaller id."""
    rnd = np.random.default_rng(4)
    images = list(enumerate(rnd.normal(size=(11, 4)).tolist()))
    texts = [(100 + 2 * i + j, v) for i, v in images for j in (0, 1)]
    got = pruned_lists(spark.createDataFrame(images, "image_id bigint, vec array<double>"),
                       spark.createDataFrame(texts, "text_id bigint, vec array<double>"), "image_id", "text_id")
    assert got == lists_by_definition(images, texts, 3)

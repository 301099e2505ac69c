"""Vector codes: against Lloyd rounds over all distances, on the dual trees alone and through Spark."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import joins
from corpusmill.llm import vector_codes as V
from corpusmill.llm.queries import op13_vector_codes

EMB = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("label", T.IntegerType())])


def nearest(points, book):
    d = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def restated(v, first, parts=4, rounds=4):
    """(codes, errors, codebooks) with every distance computed."""
    dim = v.shape[1] // parts
    codes, errors, books = [], 0, []
    for i in range(parts):
        p, book = v[:, i * dim:(i + 1) * dim], first[:, i * dim:(i + 1) * dim].copy()
        for _ in range(rounds):
            c, _ = nearest(p, book)
            for e in set(c.tolist()):
                own = p[c == e]
                book[e] = [int(s) // len(own) for s in own.sum(axis=0)]
        c, d = nearest(p, book)
        codes.append(c)
        errors = errors + d
        books.append(book)
    return np.stack(codes, 1), errors, np.stack(books)


@pytest.mark.parametrize("hot_share", [2, 10 ** 9])
def test_embeddings(spark, sf, monkeypatch, hot_share):
    monkeypatch.setattr(joins, "HOT_SHARE", hot_share)
    monkeypatch.setattr(V, "BLOCK", 150)
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    v = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    codes, errors, books = restated(v, v[:256])
    of_label = {}
    for r, e in zip(rows, errors.tolist()):
        of_label[r.label] = of_label.get(r.label, 0) + e
    text = ",".join(str(x) for part in books.tolist() for entry in part for x in entry)
    want = {(r.vec_id, bytes(c).hex(), e, of_label[r.label], hashlib.sha256(text.encode()).hexdigest())
            for r, c, e in zip(rows, codes.astype(np.uint8).tolist(), errors.tolist())}
    got = op13_vector_codes(spark, sf).collect()
    assert set(map(tuple, got)) == want and len(got) == len(rows)


@pytest.mark.parametrize("kind", ["clustered", "ties", "few entries", "large", "one point"])
def test_dual_tree(kind):
    """Sums, codes and errors of the descent, ties to the lower index included."""
    rnd = np.random.default_rng(len(kind))
    for seed in range(6):
        if kind == "clustered":
            points = rnd.integers(-900, 900, (12, 6))[rnd.integers(0, 12, 700)] + rnd.integers(-20, 20, (700, 6))
            book = points[rnd.choice(700, 50, False)]
        elif kind == "ties":
            points, book = rnd.integers(-2, 3, (300, 3)), rnd.integers(-2, 3, (40, 3))
        elif kind == "few entries":
            points, book = rnd.integers(-50, 50, (90, 4)), rnd.integers(-50, 50, (1 + seed, 4))
        elif kind == "large":
            points, book = rnd.integers(-2 ** 27, 2 ** 27, (200, 4)), rnd.integers(-2 ** 27, 2 ** 27, (30, 4))
        else:
            points, book = np.full((65, 3), 7), np.array([[9, 7, 7], [5, 7, 7], [9, 7, 7]])
        tree = V.Tree(points, 8)
        tree = V.Tree.unpack(tree.pack(), len(points), points.shape[1], 8)
        found = V.Assignment(tree, V._entry_tree(book))
        code, dist = nearest(points, book)
        got = found.codes()
        assert (got[0] == code).all() and (got[1] == dist).all()
        sums, counts = found.totals()
        assert (counts == np.bincount(code, minlength=len(book))).all()
        assert all((sums[e] == points[code == e].sum(axis=0)).all() for e in range(len(book)))


def test_pruning():
    """Tight clusters: nearly all nodes go whole, and few of all node pairs are met."""
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-9000, 9000, (64, 8))
    points = centres[rnd.integers(0, 64, 4096)] + rnd.integers(-9, 9, (4096, 8))
    found = V.Assignment(V.Tree(points, 16), V._entry_tree(centres))
    whole = sum(int(np.diff(found.parts.bounds[level])[nodes].sum()) for level, nodes, _ in found.nodes)
    assert whole > 0.5 * len(points) and found.pairs < 0.2 * len(points) * len(centres)
    for _, _, entry, _ in found.leaves():
        assert len(entry)


def test_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, EMB)
    coded, books = V.compress(make([(1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 0.0], 2)]))
    assert coded.count() == 0 and books.size == 0 and V.compress(make([]))[0].count() == 0
    rnd = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rnd.normal(size=4)], None if i % 3 else 5) for i in rnd.permutation(40)]
    rows += [(None, rows[3][1], 2), (None, rows[3][1], 2), (rows[0][0], rows[0][1], rows[0][2])]
    df = make(rows).withColumns({"id": F.lit("x"), "v": F.lit(1), "code": F.lit(2), "n": F.lit(3)})
    coded, books = V.compress(df.repartition(5), parts=2, entries=9, rounds=3)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    v = np.floor(1024 * np.array([r[1] for r in ordered], np.float32).astype(np.float64)).astype(np.int64)
    codes, errors, want = restated(v, v[:9], 2, 3)
    assert (books == want).all()
    sums = {}
    for r, e in zip(ordered, errors.tolist()):
        sums[r[2]] = sums.get(r[2], 0) + e
    assert sorted(map(str, coded.collect())) == sorted(
        str(T.Row(vec_id=r[0], label=r[2], code=c, error=e, label_error=sums[r[2]]))
        for r, c, e in zip(ordered, codes.tolist(), errors.tolist()))
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 3, 1)], [(1, [], 1)], [(1, [1e7] * 4, 1)]):
        with pytest.raises(ValueError):
            V.compress(make(bad))

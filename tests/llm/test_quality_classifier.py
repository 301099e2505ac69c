"""Quality classifier: held-out agreement, a restatement of every step, defined cases."""
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import joins
from corpusmill.llm import quality_classifier as C
from corpusmill.llm.queries import op7_quality_classifier


def test_agrees_with_held_out_labels(spark, sf):
    """Learn from two thirds of the labels, judge the rest."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = {r.doc_id: r for r in C.classify(docs, labels.filter(~third)).collect()}
    held = labels.filter(third).collect()
    assert len(held) > 20
    assert sum(got[r.doc_id].kept == bool(r.quality) for r in held) >= 0.9 * len(held)
    full = {r.doc_id: r for r in op7_quality_classifier(spark, sf).collect()}
    every = labels.collect()
    assert sum(full[r.doc_id].kept == bool(r.quality) for r in every) >= 0.95 * len(every)


def words_of(text):
    return [w for w in "".join(c if c not in "\x20\x09\n\x0b\x0c\r" else " " for c in text).split(" ") if w]


def shares_of(text):
    w, part = words_of(text), lambda a, b: a / b if b else None
    letters = [c for c in text if c.isalpha()]
    return {"symbols": part(sum(c in "#*$%&|<>!" for c in text), len(text)), "capitals": part(sum(c.isupper() for c in text), len(letters)),
            "digits": part(sum(c in "0123456789" for c in text), len(text)), "stops": part(sum(c in ".!?" for c in text), len(w)),
            "distinct": part(len(set(w)), len(w)), "length": float(len(w)), "word": part(len(text), len(w))}


def strength(groups):
    """Method of moments, from [(n, sum, sum of p (1 - p), prior)]."""
    dev = sum(n * (s / n - p) ** 2 for n, s, u, p in groups)
    chance = sum(max(0, p * (1 - p) - u / n) for n, _, u, p in groups)
    room = sum((n - 1) * p * (1 - p) for n, _, _, p in groups)
    r = (dev - chance) / room if room else 0.0
    r = max(1 / (C.MAX_STRENGTH + 1), min(0.999, r))
    return (1 - r) / r


def restated(docs, labels, fold):
    """{doc_id: (doc_prob, host_post, path_post, score)} by plain loops."""
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    bag = {i: {xxhash.xxh3_64_intdigest("".join(c.lower() if c.isascii() else c for c in w).encode()) % C.BUCKETS
               for w in words_of(t)} for i, t, _, _ in docs}
    ratio = []
    for f in range(C.FOLDS):
        n = [defaultdict(float), defaultdict(float)]
        for i, y in labels.items():
            if fold[i] != f:
                for b in bag[i]:
                    n[y][b] += 1
        tot = [sum(x.values()) + C.SMOOTHING * C.BUCKETS for x in n]
        ratio.append(lambda b, n=n, tot=tot: math.log((n[1][b] + C.SMOOTHING) / tot[1] / ((n[0][b] + C.SMOOTHING) / tot[0])))
    feats = {}
    for i, t, _, _ in docs:
        use = [ratio[fold[i]]] if i in labels else ratio
        m = [np.mean([r(b) for r in use]) for b in bag[i]]
        x = {"words": np.mean(m) if m else None, **shares_of(t)}
        feats[i] = {k: -1 if v is None else sum(v > e for e in C.EDGES[k]) for k, v in x.items()}
    good, bad = sum(labels.values()), len(labels) - sum(labels.values())
    rate = good / (good + bad)

    def weight(k, b):
        own = [labels[i] for i in labels if feats[i][k] == b]
        if not own:
            return 0.0
        return math.log((sum(own) + 1) / (good + 1) / ((len(own) - sum(own) + 1) / (bad + 1)))

    cache = {}
    ev = {i: sum(cache.setdefault((k, b), weight(k, b)) for k, b in f.items()) for i, f in feats.items()}
    prob = {i: 1 / (1 + math.exp(-(e + logit(rate)))) for i, e in ev.items()}
    soft = {i: labels.get(i, p) for i, p in prob.items()}

    def groups(key):
        out = defaultdict(lambda: [0, 0.0, 0.0])
        for d in docs:
            g, p = out[key(d)], soft[d[0]]
            g[0], g[1], g[2] = g[0] + 1, g[1] + p, g[2] + p * (1 - p)
        return out

    corpus = sum(soft.values()) / len(soft)
    post = lambda gs, prior: {k: (s + strength([(*g, prior(j)) for j, g in gs.items()]) * prior(k))
                              / (n + strength([(*g, prior(j)) for j, g in gs.items()])) for k, (n, s, _) in gs.items()}
    hosts = post(groups(lambda d: d[2]), lambda k: corpus)
    paths = post(groups(lambda d: (d[2], d[3])), lambda k: hosts[k[0]])
    out = {}
    for i, _, h, p in docs:
        z = ev[i] + logit(rate) + logit(paths[h, p]) - logit(corpus)
        out[i] = (prob[i], hosts[h], paths[h, p], 1 / (1 + math.exp(-z)))
    return out


@pytest.mark.parametrize("hot_share", [2, 10 ** 9])
def test_every_step_restated(spark, sf, monkeypatch, hot_share):
    monkeypatch.setattr(joins, "HOT_SHARE", hot_share)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.source, r.lang) for r in docs.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(C.FOLDS)).alias("f")).collect()}
    want = restated(rows, labels, fold)
    got = op7_quality_classifier(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_prob, r.host_post, r.path_post, r.score) == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-12)


def test_shares_of_texts():
    for t in ["", " \n", "Ab C. d!", "É ñ ß 12 ## é", "ab " * 5000, "日本 x"]:
        assert C.shares(t.encode()) == list(shares_of(t).values())


def test_posterior_formula(spark):
    rows = [("a", 100.0, 90.0, 1.0, 0.5), ("b", 50.0, 5.0, 0.5, 0.5), ("c", 2.0, 2.0, 0.0, 0.5), ("d", 1.0, 0.0, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "host string, n double, s double, u double, p double")
    k = strength([r[1:] for r in rows])
    got = {r.host: r.post for r in C._posterior(df, "p", "post").collect()}
    for h, n, s, _, p in rows:
        assert got[h] == pytest.approx((s + k * p) / (n + k))
    assert abs(got["c"] - 0.5) < abs(got["a"] - 0.5) + 0.1 and got["a"] > 0.8 and got["b"] < 0.2


def test_site_moves_the_verdict(spark, make_docs):
    """The same doubtful text is judged by the site it comes from."""
    good = [(i, f"Plain words make a calm line number {i}. It ends here.") for i in range(60)]
    bad = [(100 + i, f"BUY ### NOW $$$ {i} !!! *** &&&") for i in range(60)]
    docs = make_docs(good, source="fine").union(make_docs(bad, source="poor"))
    docs = docs.union(make_docs([(500, "odd")], source="fine")).union(make_docs([(501, "odd")], source="poor"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in C.classify(docs, labels).collect()}
    assert got[500].doc_prob == pytest.approx(got[501].doc_prob) and got[500].score > got[501].score
    assert got[1].kept and not got[101].kept and got[1].host_post > 0.9 > 0.1 > got[101].host_post


def test_defined_cases(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x")], lang=None, source=None).selectExpr("*", "1 as label", "2 as rate", "3 as words", "4 as buckets", "5 as n")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = C.classify(docs, none).collect()
    assert len(got) == 5 and all(r.score == pytest.approx(0.5) and r.kept for r in got)
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (1, 1)], "doc_id bigint, quality int")
    assert len(C.classify(docs, one).collect()) == 5
    # a score that equals the threshold, and a text of 200,000 words
    assert all(r.kept for r in C.classify(docs, none, threshold=got[0].score).collect())
    assert C.classify(make_docs([(1, "word " * 200000)]), none).count() == 1
    assert C.classify(make_docs([]), one).count() == 0

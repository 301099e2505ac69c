"""Near-duplicates against the definition: every pair, sets of word tuples."""
import random

import pytest

from corpusmill.llm import near_dedup as N
from corpusmill.llm.graph import connected_components


def shingle_set(text):
    w = text.encode().lower().split() if text else []
    if len(w) < 5:
        return frozenset({tuple(w)} if w else ())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def by_definition(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("percent", [85])
def test_test_table(spark, sf, documents, percent):
    df = N.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), percent=percent)
    assert got(df) == by_definition(documents, percent)


def near_copies(n, words, edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"x{rnd.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_long_lists_and_blocks(make_docs, monkeypatch):
    """A group of near copies around the threshold, a passage shared by many, with lists
    and blocks small enough that every round is used."""
    monkeypatch.setattr(N, "SHORT_LIST", 4)
    monkeypatch.setattr(N, "BLOCK", 8)
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(40, 120, 5, 1) + near_copies(20, 40, 2, 2)
    texts += [passage + " " + " ".join(f"q{rnd.randrange(10 ** 6)}" for _ in range(rnd.randrange(5, 60))) for _ in range(40)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    want = by_definition(rows, 85)
    assert len({c for _, c, _ in want.values()}) < len(rows)
    assert got(N.near_duplicates(make_docs(rows), percent=85)) == want


def test_defined_cases(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Two words"), (5, "two  WORDS\n"), (6, "one"), (7, long), (8, long + " more"),
            (9, "a b c d e f"), (9, "a b c d e f"), (10, "É b c d e"), (11, "é b c d e"), (None, "two words")]
    r = N.near_duplicates(make_docs(rows), percent=85).collect()
    assert len(r) == len(rows)
    by = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in r}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[5] == (1, 4, False) and by[4] == (1, 4, True)
    assert by[8] == (29997, 7, False) and by[9] == (2, 9, True)
    assert by[10] == (1, 10, True) and by[11] == (1, 11, True)  # only A-Z is lower-cased
    assert by[None] == (1, None, True)
    assert N.near_duplicates(make_docs([])).count() == 0


def test_dedup_keeps_columns_and_smallest(make_docs):
    docs = make_docs([(5, "a b c d e f g"), (3, "A b c d e f g"), (8, "other text")]).selectExpr("*", "1 as _gone", "2 as node")
    out = N.dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {3, 8}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    c = {r.node: r.component for r in connected_components(df).collect()}
    assert c == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(df.limit(0)).count() == 0


def test_share_follows_from_percent():
    """The chance that a pair's sketches share fewer values, by simulation-free binomials."""
    import math
    import pytest
    for percent in (95, 85, 80, 60, 50):
        c = round(64 * N.share_of(percent, 64))
        tail = lambda c: sum(math.comb(64, i) * (percent / 100) ** i * (1 - percent / 100) ** (64 - i) for i in range(c))
        assert tail(c) <= N.LOSS < tail(c + 1)
    assert N.share_of(85, 64) == 0.5625
    with pytest.raises(ValueError):
        N.share_of(10, 64)


def windows(n, seed):
    """``[(id, text)]`` in mixed order: every text is like the next few of a long chain only."""
    rnd = random.Random(seed)
    words, ids = [f"w{rnd.randrange(10 ** 6)}" for _ in range(200 + 6 * n)], rnd.sample(range(10 * n), n)
    return [(ids[i], " ".join(words[6 * i:6 * i + 200])) for i in range(n)]


def estimate_bits(df):
    """Binary digits of Spark's size estimate of a frame."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimate_of_components(spark):
    """Rounds of joins on what was cut before do not multiply up the size estimate in the driver."""
    ids = random.Random(5).sample(range(1000), 100)
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    comp = connected_components(df)
    assert estimate_bits(comp) < 100
    assert {(r.node, r.component) for r in comp.collect()} == {(i, min(ids)) for i in ids}


def test_estimate_of_result(spark, make_docs):
    """The same for the whole of op 6, where three such loops follow each other."""
    docs = windows(50, 4)
    df = N.near_duplicates(make_docs(docs), percent=85)
    assert estimate_bits(df) < 2000
    assert {r.component_id for r in df.collect()} == {min(i for i, _ in docs)}

"""Base rules and score against a plain restatement."""
import math
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def buckets(text, n=Q.BUCKETS):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
           for a, b in zip(h, h[1:])]
    return [signed(x) % n for x in h + two]


def scores(rows, good):
    raw, tgt = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in good:
            tgt.update(buckets(t))
    share = sum(tgt.values()) / max(1, sum(raw.values()))
    c = max(Q.LEAST_PRIOR, sum(tgt.values()) * Q.PRIOR_SHARE / Q.BUCKETS)
    w = {b: math.log((tgt[b] + c) / (n * share + c)) if tgt else 0.0 for b, n in raw.items()}
    return {i: sum(w[b] for b in buckets(t)) / max(1, len(buckets(t))) for i, t in rows}


def check(df, rows, good):
    want = scores(rows, good)
    out = {r.doc_id: r for r in df.collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        r, b = out[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == b, i
        assert r.score == pytest.approx(want[i], abs=1e-9)
        assert r.kept == (not b[5] and r.score >= Q.THRESHOLD)


def test_test_table(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    check(Q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), labels), documents, {r[0] for r in labels.collect()})


def test_large_corpora_have_a_proportional_prior(spark, make_docs):
    """Ten times the same corpus gives the same weights once the share is above the least mass."""
    rows = [(i, " ".join(f"w{j % (i + 3)}" for j in range(60))) for i in range(30)]
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id bigint")
    once, often = (Q.bucket_weights(make_docs(r), trusted, least_prior=0.0).first().weights for r in (rows, rows * 10))
    assert once == pytest.approx(often, abs=1e-12) and max(once) > 0.1


def test_result_can_be_filtered_joined_and_grouped(spark, sf, documents):
    """Spark must not copy the rules into later conditions; each of these once ran for minutes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.quality_rules(docs, labels.filter("quality = 1").select("doc_id"))
    rows = rules.collect()
    began = time.time()
    assert rules.filter("kept").count() == sum(r.kept for r in rows)
    assert rules.filter("not base_failed and n_words > 30 and score > -0.05").count() == sum(
        not r.base_failed and r.n_words > 30 and r.score > -0.05 for r in rows)
    joined = rules.filter("not base_failed").join(docs.filter("length(text) > 10"), "doc_id").filter("score < 0.5")
    assert joined.count() == sum(not r.base_failed and r.score < 0.5 for r in rows)
    groups = {r.kept: r.n for r in rules.groupBy("kept").agg(F.count("*").alias("n"), F.max("score")).filter("n > 0").collect()}
    assert groups == Counter(r.kept for r in rows)
    assert rules.orderBy("score").filter("kept").select("doc_id").count() == sum(r.kept for r in rows)
    assert time.time() - began < 90


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_defined_cases(spark, make_docs, monkeypatch, few):
    monkeypatch.setattr(Q, "BROADCAST_IDS", few)  # the trusted ids by shuffle and by broadcast
    eight = "a b c d e f g h"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, eight), (6, f"{eight} {eight}"), (7, f"{eight} z {eight} {eight}"),
            (8, "l\n\nl\n l\nl \nl"), (9, "# * $ % & | < > é ü"), (10, " ".join(f"w{i}" for i in range(20000))),
            (11, "a " * 500), (12, " \x1c word\x0b\x0cx")]
    trusted = spark.createDataFrame([(5,), (10,), (None,), (5,)], "doc_id bigint")
    check(Q.quality_rules(make_docs(rows), trusted), rows, {5, 10})
    check(Q.quality_rules(make_docs(rows), trusted.limit(0)), rows, set())
    assert Q.quality_rules(make_docs([]), trusted).count() == 0


def test_keep_good_keeps_columns(spark, make_docs):
    docs = make_docs([(1, " ".join(f"w{i}" for i in range(40))), (2, "short"), (None, " ".join(f"v{i}" for i in range(40)))])
    docs = docs.selectExpr("*", "1 as words", "2 as h", "3 as w", "4 as row")
    out = Q.keep_good(docs, spark.createDataFrame([(1,)], "doc_id bigint"))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {1, None}


def test_lines_of_white_space_are_tested_without_rewriting_them(spark):
    """Whether a line has a word needs a look at its first word, not a copy of the line without its white space."""
    from corpusmill.llm.quality_rules import quality_rules
    text = "a b\n \t\n\n \t\na b\n\x0b\x0c\r\n\u00a0\n\u00a0\nc"       # a no-break space is part of a word
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    out = quality_rules(docs, spark.createDataFrame([(1,)], "doc_id long"))
    assert {r.doc_id: r.n_dup_lines for r in out.collect()} == {1: 2, 2: 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1          # the count of symbols

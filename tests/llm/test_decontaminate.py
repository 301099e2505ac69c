"""Containment search against every document and item, by the definition."""
import random

from corpusmill.llm import decontaminate as D

from test_near_dedup import shingle_set


def by_definition(docs, items, percent=80):
    out = set()
    for d, text in docs:
        s = shingle_set(text)
        for i, item in items:
            t = shingle_set(item)
            if t and 100 * len(s & t) >= percent * len(t):
                out.add((d, i, len(t), len(s & t)))
    return out


def got(df):
    return {(r.doc_id, r.item_id, r.n_item, r.n_found) for r in df.collect()}


def test_test_table(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = by_definition(documents, [(r.item_id, r.text) for r in items.collect()])
    assert want
    assert got(D.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), items)) == want


def test_planted_passages(spark, make_docs):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((5, 6, 9, 14, 20, 21, 40, 80, 300))]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rnd.randrange(1, 900))]
        for _ in range(rnd.randrange(3)):
            w = items[rnd.randrange(len(items))][1].split()
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = "edit"
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w
        docs.append((d, " ".join(text).upper()))
    items += [(100, None), (101, ""), (102, "two words"), (103, items[3][1])]
    docs += [(500, None), (501, ""), (502, "Two words"), (503, "with two words inside"), (504, items[5][1]),
             (504, items[5][1]), (None, items[5][1]), (505, "pad " * 30000 + items[6][1])]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = got(D.contaminated(make_docs(docs), frame))
    assert found == by_definition(docs, items)
    assert {505, 502, None} <= {f[0] for f in found} and 503 not in {f[0] for f in found}


def test_more_items_than_the_filter_tells_apart(spark, make_docs):
    """A bitmap so small that nearly every hash passes it changes nothing."""
    rnd = random.Random(4)
    items = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(30))) for i in range(60)]
    docs = [(d, " ".join([f"w{rnd.randrange(500)}" for _ in range(50)] + items[d][1].split())) for d in range(60)]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    assert got(D.contaminated(make_docs(docs), frame, bits=1 << 10)) == by_definition(docs, items)


def test_empty_tables_and_columns(spark, make_docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert D.contaminated(make_docs([]), items).count() == 0
    assert D.contaminated(make_docs([(1, "a b c d e f")]), items.limit(0)).count() == 0
    docs = make_docs([(1, "x a b c d e f"), (2, "clean"), (None, "clean too"), (None, "a b c d e f")]).selectExpr("*", "1 as _bad_id", "2 as row")
    out = D.decontaminate(docs, items)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(2, "clean"), (None, "clean too")}

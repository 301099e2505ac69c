"""The pipeline, stage by stage, against restatements of every stage, and the entry."""
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from corpusmill.llm import secret_scan as S
from corpusmill.llm.queries import REGISTRY, tokenizer_path

from test_decontaminate import by_definition as contained
from test_near_dedup import by_definition as duplicates
from test_near_dedup import estimate_bits, windows
from test_quality_rules import base, scores
from corpusmill.llm.quality_rules import THRESHOLD

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, documents, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    score = scores(documents, good)
    rows = [(i, t) for i, t in documents if not base(t)[5] and score[i] >= THRESHOLD]
    want = [rows]
    comp = duplicates(rows, 80)
    want.append([(i, t) for i, t in rows if comp[i][2]])
    bad = {x[0] for x in contained(want[-1], items)}
    want.append([(i, t) for i, t in want[-1] if i not in bad])
    want.append([(i, S.redacted(t)) for i, t in want[-1]])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == COLUMNS
            got = docs.collect()
            assert sorted((r.doc_id, r.text) for r in got) == sorted(want[k]), name
            assert all(r.n_chars == len(r.text) for r in got)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    pieces = Counter()
    for i, t in want[-1]:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            pieces[(i, p, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes()))] += 1
    got = docs.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= 1.03 * -(-sum(used.values()) // 4096) + 1


def test_near_dedup_estimate(spark, sf, make_docs, monkeypatch):
    """A chain of near copies takes several rounds; the size estimates in the driver stay short numbers."""
    cut, bits, docs = P.near_dedup.cut, [], windows(50, 4)

    def noted(df):
        out = cut(df)
        bits.append(estimate_bits(out))
        return out

    monkeypatch.setattr(P.near_dedup, "cut", noted)
    left = P.drop_near_duplicates(spark, make_docs(docs), sf)
    assert max(bits) < 2000
    assert [r.doc_id for r in left.collect()] == [min(i for i, _ in docs)]


def test_run(spark, sf):
    """The result, and only the folder of the last stage left."""
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(base))
    assert P.run(spark, sf).count() > 0
    (new,) = [x for x in os.listdir(base) if x.startswith("pipeline-") and x not in before]
    assert os.listdir(os.path.join(base, new)) == [f"{len(P.STAGES) - 1}_{P.STAGES[-1][0]}"]


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_on_empty_and_odd_rows(spark, sf, make_docs, stage):
    name, f = P.STAGES[stage]
    assert f(spark, make_docs([]), sf).count() == 0
    clean = " ".join(f"the w{i}" for i in range(30))
    docs = make_docs([(None, clean), (1, None), (2, ""), (3, clean + " x y z")])
    out = f(spark, docs, sf)
    assert out.count() == (2 if stage == 0 else 4)
    if stage < 4:
        assert out.columns == COLUMNS


def test_every_operator_is_registered():
    names = set(E.queries())
    assert set(REGISTRY) | {"pipeline"} <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in REGISTRY) == list(range(1, 14))


def test_op5_and_op8_and_op10_digests(spark, sf, documents):
    import hashlib
    from test_secret_scan import base as spans
    order = {k: i for i, k in enumerate(S.BASE)}
    got = {r.doc_id: r for r in REGISTRY["op5_secret_scan"](spark, sf).collect()}
    for i, t in documents:
        own = sorted(spans(t), key=lambda x: (x[1], order[x[0]]))
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in own) for k in S.BASE)
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    pages = REGISTRY["op10_html_extraction"](spark, sf).collect()
    assert all(r.n_chars == len(r.text) for r in pages)
    assert {r.law for r in REGISTRY["op8_sharding"](spark, sf).collect()} == {"key"}

"""Language: held-out accuracy, Viterbi against every labelling, defined cases."""
import itertools

import numpy as np

from corpusmill.llm import language_id as L
from corpusmill.llm.queries import op4_language_id


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in op4_language_id(spark, sf).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in docs if got[i].held_out]
    import zlib
    assert held == [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2] and len(got) == len(docs)
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.95 * len(held)


def test_viterbi_is_the_best_labelling():
    rnd = np.random.default_rng(1)
    scores = [rnd.normal(0, 4, (n, 3)).astype(np.float32) for n in (1, 6, 3, 5, 6, 2)]
    value = lambda s, path: sum(s[i, x] for i, x in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
    for s, labels in zip(scores, L._viterbi(scores, 2.5)):
        best = max(value(s, p) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(value(s, labels.tolist()) - best) < 1e-4


def test_mixed_text_and_cases(spark, make_docs):
    en, ru, de = "the cat and the dog were in the house", "кот и собака были в доме", "der hund und die katze sind nicht im haus"
    train = make_docs([(i, t) for i, t in enumerate([en] * 5)], "en").union(make_docs([(9, ru)] * 5, "ru")).union(
        make_docs([(8, de)] * 5, "de")).union(make_docs([(None, None)], None))
    model = L.learn(train)
    assert model["langs"] == ["de", "en", "ru"]
    mixed = f"{en} {en} {ru} {ru} 1234 {de} {de}"
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, ru), (5, mixed), (None, de), (6, "日本"), (7, (en + " ") * 3000), (7, en)]
    out = L.predict(make_docs(rows), model).collect()
    by = [(r.lang_pred, round(r.score, 2)) for r in out]
    assert by[:4] == [("und", 0.0), ("und", 0.0), ("und", 0.0), ("ru", 1.0)]
    assert [x.lang for x in out[4].spans] == ["en", "ru", "de"]
    s = out[4].spans
    assert mixed[s[0].start:s[0].end] == f"{en} {en}" and mixed[s[2].start:s[2].end].endswith(de)
    assert by[5][0] == "de" and by[6][0] in ("de", "en", "ru") and by[7] == ("en", 1.0) and by[8] == ("en", 1.0)
    assert L.predict(make_docs([]), model).count() == 0
    nothing = L.learn(make_docs([]))
    assert [r.lang_pred for r in L.predict(make_docs([(1, en)]), nothing).collect()] == ["und"]


def test_scripts():
    names = [L.SCRIPTS[L._script(w.encode())] for w in ("abcé", "кот", "ελ", "日本", "かな", "한국", "שלום", "ไทย", "xкот")]
    assert names == ["latin", "cyrillic", "greek", "han", "kana", "hangul", "hebrew", "thai", "cyrillic"]
    assert L._script("12!".encode()) == L.NO_LETTER


def test_numerals_are_no_letters(make_docs, spark):
    """Digits, superscripts, fractions and circled numbers: no language, wherever they stand."""
    model = L.learn(make_docs([(1, "the cat"), (2, "a dog")], "en"))
    docs = make_docs(list(enumerate(["½ 12", "² 3", "① ②", "Ⅷ 8", "12 ½ cat", "_ - .", "١٢"])))
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in L.predict(docs, model).collect()}
    assert {i for i, x in got.items() if x == ("und", False)} == {i for i in got if i != 4}
    assert got[4] == ("en", True)


def test_counts_do_not_depend_on_the_chunk(make_docs, monkeypatch):
    rows = [(i, f"word{i} some text {'x' * i}") for i in range(40)]
    whole = L.learn(make_docs(rows, "en"))
    monkeypatch.setattr(L, "CHUNK_BYTES", 10)
    assert (L.learn(make_docs(rows, "en"))["logp"] == whole["logp"]).all()

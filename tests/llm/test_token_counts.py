"""Token counts: against the library itself and a one-by-one merge loop."""
import random

import pytest

from corpusmill.llm import token_counts as T

sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")
ALPHABETS = ["abcdefgh  \n", "aab ", "▁ ab", "abcXYZ0189+/=", "привет мир", "日本語梦é \t\r\n\x00😀", " ", "=-*# ", "<s>unk0x41/ "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def one_by_one(pieces, text):
    """Merge the lowest rank, then the leftmost place, until no pair is a piece."""
    s = list(text)
    while True:
        pairs = [(pieces[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in pieces]
        if not pairs:
            return s
        _, i = min(pairs)
        s[i:i + 2] = [s[i] + s[i + 1]]


def test_documents(spark, sf, documents, library):
    got = T.token_counts(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect()
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in documents}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(documents)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)


def test_random_texts(library):
    rnd = random.Random(3)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    texts = ["".join(rnd.choice(a) for _ in range(rnd.choice([1, 4, 30, 300]))) for a in ALPHABETS * 60]
    texts += ["".join(rnd.choice(vocabulary) for _ in range(rnd.choice([2, 5]))) for _ in range(2000)]
    assert T.count_tokens(texts, PATH) == [len(library.encode(t)) for t in texts]


def test_long_runs(library):
    texts = [" " * 30001, "a" * 30001, "=-" * 9000 + " " * 500, "日本" * 9000, "ab\n" * 9000, "x" * 17 + " " * 47]
    assert T.count_tokens(texts, PATH) == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize("few", [0, 8])
def test_other_vocabularies(monkeypatch, few):
    """Random ranks: most merges make pairs that rank higher, and some tie."""
    monkeypatch.setattr(T, "FEW", few)
    rnd = random.Random(5)
    for _ in range(60):
        pieces = {c: 10 ** 6 + i for i, c in enumerate("abc")}
        for _ in range(25):
            a, b = rnd.choice(list(pieces)), rnd.choice(list(pieces))
            if len(a + b) <= 6:
                pieces.setdefault(a + b, rnd.randrange(30))
        words = ["".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 5, 40]))) for _ in range(20)]
        known = {k: v for k, v in pieces.items() if len(k) > 1}
        assert T.Merges(pieces).count(words).tolist() == [len(one_by_one(known, w)) for w in words]


def test_cases(spark, make_docs, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_CHARS", 10)
    monkeypatch.setattr(T, "CACHE_WORDS", 1)
    docs = make_docs([(1, None), (2, ""), (3, " "), (3, " "), (None, "a b"), (5, "<s>a</s>")])
    docs = docs.selectExpr("*", "7 as n_tokens", "8 as t")
    got = sorted(map(tuple, T.token_counts(docs, PATH, limit=2).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 1, 1, False), (3, 1, 1, False), (None, 3, 2, False),
                          (5, 8, 7, True)], key=str)
    assert T.token_counts(make_docs([]), PATH).count() == 0
    with pytest.raises(ValueError):
        T.Merges({"a": 0, "a▁b": 1})

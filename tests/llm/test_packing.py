"""Packing: the plan deals every rank once, and the pieces rebuild the documents."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusmill.llm import packing as K
from corpusmill.llm.queries import tokenizer_path

END = K.END_ID


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def check_plan(counts, capacity=4096, **kw):
    rows = K.plan(dict(counts), capacity, **kw)
    ranks, seqs = defaultdict(list), defaultdict(list)
    for length, rank0, mult, n, seq0, offset in rows:
        ranks[length].append((rank0, rank0 + mult * n))
        for j in range(n):
            seqs[seq0 + j].append((offset, length * mult))
    for length, n in counts.items():
        at = 0
        for a, b in sorted(ranks[length]):
            assert a == at
            at = b
        assert at == n
    for parts in seqs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(seqs), -(-sum(x * n for x, n in counts.items()) // capacity)


def test_plan_deals_every_rank_once():
    rnd = random.Random(1)
    for _ in range(60):
        lengths = [rnd.choice([rnd.randint(1, 4096), rnd.randint(1, 40), 4096, rnd.randint(500, 1400)])
                   for _ in range(rnd.randint(1, 300))]
        check_plan(Counter(lengths))
    assert K.plan({}) == []


def test_plan_is_close_to_the_bound():
    rnd = random.Random(2)
    counts = Counter(min(4096, int(rnd.lognormvariate(6, 1.1)) + 1) for _ in range(20000))
    used, bound = check_plan(counts)
    assert used <= 1.01 * bound
    # equal halves, thirds, and a hot length
    assert check_plan({2048: 10}) == (5, 5)
    assert check_plan({1365: 9, 1: 3}) == (3, 3)
    assert check_plan({4096: 1000, 1: 4096}) == (1001, 1001)
    assert check_plan({2: 3_000_000}) == (1465, 1465)


def test_encoder_equals_the_tokenizer(tokenizer, documents):
    encode = K._encoder(tokenizer_path())
    odd = ["İstanbul ΣΑΣ don't ''s x'll <|endoftext|> naïve é a b \x1c\x1dz_w", "日本語 12345 éÉ x", "'S'T 'Ve a'b\tc",
           "", " \n", "x" * 5000, "!!!@@@###"]
    for text in odd + [t for _, t in documents[:80]]:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_strings_of_added_tokens_as_in_the_plain_call(make_docs):
    """Against a tokenizer as it is loaded: an added token's string is one id."""
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "a<|endoftext|>b é<|startoftext|>日 <|ENDOFTEXT|> <|endoftext|><|startoftext|>", "<|endoftext|>",
             "end<|endoftext |> of text"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [320, 49407, 321]
    got = {r.doc_id: r for r in K.tokenized_pieces(make_docs(list(enumerate(texts))), tokenizer_path(), with_ids=True).collect()}
    for i, ids in enumerate(want):
        assert got[i].ids == [*ids, END] and got[i].length == len(ids) + 1
        assert got[i].ids_crc32 == zlib.crc32(np.array([*ids, END], "<u4").tobytes())


def test_round_trip(spark, make_docs, tokenizer):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "naïve", "x1", "!"]) for _ in range(rnd.randrange(120)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " "), (7, rows[7][1]), (None, "no id"), (203, "long text " * 300)]
    docs = make_docs(rows).selectExpr("*", "1 as piece", "2 as rank")
    cap = 64
    pieces = K.tokenized_pieces(docs, tokenizer_path(), capacity=cap, with_ids=True)
    got = K.pack(pieces, capacity=cap, small=16).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [END]
    want = Counter()
    for i, t in rows:
        all_ids = ids(t)
        for k, at in enumerate(range(0, len(all_ids), cap)):
            part = all_ids[at:at + cap]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert sum(len(r.ids) for r in K.sequences(docs, tokenizer_path(), capacity=cap).collect()) == sum(r.length for r in got)
    assert K.pack(K.tokenized_pieces(make_docs([]), tokenizer_path())).count() == 0

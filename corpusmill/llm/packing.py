"""Best-fit packing of token sequences by linear grouping.

Documents are tokenised, an end id is appended, and only those longer than the
capacity are cut.  What matters for the packing is how many pieces there are of
each length, a table of at most ``capacity`` rows however many documents there are,
so the plan is made on that table, and the pieces are then dealt to it:

1. *Grouping.*  Lengths above ``small`` are sorted and dealt into ``groups`` groups of
   equal cardinality; in each, lengths are rounded up to the group's largest.
2. *Configurations.*  On these few sizes, sequences are formed from the fullest
   combination that starts with the largest size left, each used as often as
   the numbers allow.
3. *Substitution.*  The actual lengths of a group take the places of its size, the
   longest first, which leaves the rounding as free room.
4. *Best fit.*  The small lengths, longest first, go to the sequence with the least
   room that holds them; new sequences are opened only when none does.

A plan row says: pieces ``rank0 ...`` of one length go, ``mult`` to a sequence, to
sequences ``seq0 ...`` at ``offset``.  The rank of a piece among those of its length is
found in two passes (``local_rank``), so a length that most pieces share is spread
over all tasks, and the rows never pass through the driver.

Cases: a null text counts as empty, so it is one piece of the end id.  Repeated rows
are packed each.  Ties between equal lengths follow id, piece and checksum.  An
empty table gives no sequences.  Null ids are passed through.  Other columns are
not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, local_rank, ready

CAPACITY = 4096
END_ID = 1
SMALL = 512
GROUPS = 16
#: Words whose ids a worker remembers (about 200 bytes each).
CACHE_WORDS = 1 << 19

# Printable ASCII and the letters of Latin-1: lower-casing and normalising them is plain.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PRETOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_loaded: dict = {}


def _encoder(path: str, as_text: bool = True):
    """``encode(text bytes) -> little-endian uint32 ids`` with the tokenizer at ``path``.

    Its pre-tokeniser never joins what white space parts, so a text's ids are those
    of its words, one after the other; each worker remembers the words it has seen.
    Words of printable ASCII and Latin-1 letters are split as the pre-tokeniser
    splits them and go straight to the model; all others go through the whole
    tokenizer, and so do words that hold the string of an added token.  ``as_text``:
    these strings are ordinary text; else they are single ids, as in the tokenizer's plain
    call, which the operator uses.
    """
    if (path, as_text) in _loaded:
        return _loaded[path, as_text]
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = as_text
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    if not as_text and any(len(x.split()) != 1 or x != x.strip() for x in added):
        raise ValueError("an added token with white space is not in a single word")
    special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
    model, pieces, words = tok.model, {}, {}

    pack_ids = [struct.Struct(f"<{n}I").pack for n in range(33)]

    def piece(p: str) -> bytes:
        got = pieces.get(p)
        if got is None:
            ids = [t.id for t in model.tokenize(p if p.isascii() else as_bytes(p)[0][0])]
            got = pieces[p] = pack_ids[len(ids)](*ids) if len(ids) < len(pack_ids) else np.array(ids, "<u4").tobytes()
        return got

    def word(w: bytes) -> bytes:
        text = w.decode()
        if _PLAIN.fullmatch(text) and (as_text or not special.search(text)):
            text = text.lower()
            return piece(text) if text.isalpha() else b"".join(map(piece, _PRETOKEN.findall(text)))
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: bytes) -> bytes:
        parts = text.split()
        if len(words) > CACHE_WORDS:
            words.clear()
        if len(pieces) > CACHE_WORDS:
            pieces.clear()
        for w in set(parts).difference(words):
            words[w] = word(w)
        return b"".join(map(words.__getitem__, parts))

    _loaded[path, as_text] = encode
    return encode


def _cut_pieces(batches, path, capacity, end_id, with_ids):
    encode = _encoder(path, as_text=False)
    end = int(end_id).to_bytes(4, "little")
    for rb in batches:
        rows, no, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(rb.column(1).to_pylist()):
            data = (encode(text) if text else b"") + end
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at:at + 4 * capacity]
                rows.append(i)
                no.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        cols = [rb.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names)


def tokenized_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: the pieces of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = ready(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return src.mapInArrow(lambda it: _cut_pieces(it, tokenizer, capacity, end_id, with_ids),
                          f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
                          + ", ids array<int>" * with_ids)


def _fullest(sizes, left, room):
    """The multiset of ``sizes`` (descending; ``left`` of each) that fills ``room`` best,
    as {index: times}; among equals the one with the larger sizes."""
    reach = np.full(room + 1, -1, np.int32)  # size last used to reach a sum, -1: not reached
    reach[0] = len(sizes)
    for i, s in enumerate(sizes):
        for _ in range(min(left[i], room // s)):  # one more of this size to every sum reached so far
            new = (reach[:-s] >= 0) & (reach[s:] < 0)
            if not new.any():
                break
            reach[s:][new] = i
    total = int(np.flatnonzero(reach >= 0)[-1])
    used: dict[int, int] = {}
    while total:
        i = int(reach[total])
        used[i] = used.get(i, 0) + 1
        total -= sizes[i]
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple]:
    """Rows ``(length, rank0, mult, seqs, seq0, offset)`` for ``counts`` pieces of each
    length; every rank of every length is in exactly one row."""
    taken = dict.fromkeys(counts, 0)

    def take(length, n):
        taken[length] += n
        return taken[length] - n

    # linear grouping: queues of (length, count), longest first
    large = sorted((x for x in counts if x > small), reverse=True)
    per = max(1, -(-sum(counts[x] for x in large) // groups))
    queues, free = [], 0
    for x in large:
        n = counts[x]
        while n:
            if not free:
                queues.append([])
                free = per
            m = min(n, free)
            queues[-1].append([x, m])
            n, free = n - m, free - m
    sizes = [q[0][0] for q in queues]
    left = [sum(n for _, n in q) for q in queues]

    classes = []  # [slots, sequences, room]; a slot is (length, rank0, mult)
    for g in range(len(queues)):
        while left[g]:
            left[g] -= 1
            used = _fullest(sizes, left, capacity - sizes[g])
            left[g] += 1
            used[g] = used.get(g, 0) + 1
            times = min(left[i] // k for i, k in used.items())
            for i, k in used.items():
                left[i] -= k * times
            # substitution: cut the run where one of its lengths changes
            while times:
                heads, n = [], times
                for i, k in used.items():
                    x, m = queues[i][0]
                    if m >= k:
                        heads.append((i, [(x, k)]))
                        n = min(n, m // k)
                    else:  # the length runs out within one sequence
                        mix, need = [], k
                        for y, c in queues[i]:
                            c = min(c, need)
                            mix.append((y, c))
                            need -= c
                            if not need:
                                break
                        heads.append((i, mix))
                        n = 1
                slots, room = [], capacity
                for i, mix in heads:
                    for y, c in mix:
                        slots.append((y, take(y, c * n), c))
                        room -= y * c
                        queues[i][0][1] -= c * n
                        if not queues[i][0][1]:
                            queues[i].pop(0)
                classes.append([slots, n, room])
                times -= n

    # best fit of the small lengths
    by_room: dict[int, list] = {}
    for c in classes:
        by_room.setdefault(c[2], []).append(c)
    rooms = sorted(by_room)

    def put(c):
        if c[2] not in by_room:
            bisect.insort(rooms, c[2])
        by_room.setdefault(c[2], []).append(c)

    for x in sorted((x for x in counts if x <= small), reverse=True):
        n = counts[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                q = capacity // x
                c = [[], max(1, n // q), capacity]
            else:
                c = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    del by_room[rooms.pop(at)]
            q = min(c[2] // x, n)
            m = min(c[1], n // q)
            if m < c[1]:  # the other sequences of this class stay as they are
                put([[(y, r + m * k, k) for y, r, k in c[0]], c[1] - m, c[2]])
            put([c[0] + [(x, take(x, m * q), q)], m, c[2] - q * x])
            n -= m * q

    out, seq = [], 0
    for room in rooms:
        for slots, n, _ in by_room[room]:
            at = 0
            for x, rank0, k in slots:
                out.append((x, rank0, k, n, seq, at))
                at += x * k
            seq += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (``doc_id, piece, length, ids_crc32`` and any others) with their
    ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    rows = cut(pieces)
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    deal = spark.createDataFrame(
        plan(counts, capacity, small, groups),
        "p_length bigint, rank0 bigint, mult bigint, seqs bigint, seq0 bigint, offset0 bigint")
    ranked = local_rank(rows, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    k = F.col("rank") - F.col("rank0")
    # the plan has a fixed bound: rows for each length and class of sequences, not for pieces
    return (ranked.join(F.broadcast(deal), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank0"))
                        & (F.col("rank") < F.col("rank0") + F.col("mult") * F.col("seqs")))
            .withColumn("sequence_id", F.col("seq0") + F.expr("(rank - rank0) div mult"))
            .withColumn("offset", F.col("offset0") + F.pmod(k, F.col("mult")) * F.col("length"))
            .drop("rank", "p_length", "rank0", "mult", "seqs", "seq0", "offset0"))


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``sequence_id, ids``: the packed token sequences (at most ``capacity`` ids each)."""
    packed = pack(tokenized_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids=True), capacity)
    return (packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids")))

"""Token counts of a byte-fallback BPE by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens: a run of blanks with the word behind it, or a line
break.  No piece of the vocabulary crosses such a cut, so the tokens of a text are
those of its pre-tokens, and each distinct pre-token of a batch is merged once.

*Ragged arrays.*  All pre-tokens that a worker has not met yet lie behind one another
in one flat array of symbols, first their characters.  A sequence is cut wherever two
adjacent characters are adjacent in no piece: no merge can ever cross there, which
keeps even long texts without blanks in short sequences.

*One step.*  The rank of every adjacent pair is looked up, a segmented minimum gives
the lowest rank of each sequence, and every sequence applies that pair at all its
places at once, the left one first where places overlap.  Symbols that were merged
away leave the array, and so do sequences without any pair left; what survives
is counted.

*Exactness.*  Applying all places at once equals the one-by-one order (lowest rank,
then leftmost) unless the new symbol forms a pair whose rank is no higher.  For the
ranks where the vocabulary has such a pair, a sequence applies the leftmost place only,
or, with more than ``FEW`` places, is swept in that order with a heap of the places of
this rank and of the new pairs that do not rank higher.

A character without a piece never merges and counts its UTF-8 bytes.  Strings of
control pieces inside a text are ordinary text, as the library has it by default.

Memory of a task: the texts of a chunk (``CHUNK_CHARS`` characters, or one longer
text), their pre-tokens, and ``CACHE_WORDS`` remembered counts.

Cases: a null text counts as empty; an empty text has 0 tokens.  Repeated rows are
counted each; null ids are passed through.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ready

LIMIT = 4096
CHUNK_CHARS = 4_000_000
#: Words of up to CACHE_CHARS characters whose counts a worker remembers.
CACHE_WORDS = 1 << 19
CACHE_CHARS = 64
#: Up to this number of places, a rank that needs the one-by-one order takes a step for each.
FEW = 8
SPACE = "▁"

_NONE = np.int32(2 ** 31 - 1)
_CODES = 0x110000
_PRETOKEN = re.compile(r"\n| *+[^ \n]+| +")


class Merges:
    """The merge table of a vocabulary: ``pieces`` maps a piece to its rank (equal ranks
    are taken from the left); single characters are pieces that need no merge."""

    def __init__(self, pieces: dict[str, int]):
        chars = {c for p in pieces for c in p}
        if "\n" in chars or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a pre-token: it holds a line break, or a blank behind a character")
        names = sorted(chars | set(pieces))
        number = {p: i for i, p in enumerate(names)}
        self.size = len(names)
        self.symbol = np.full(_CODES, -1, np.int32)
        for c in chars:
            self.symbol[ord(c)] = number[c]
        rows = [(number[p[:i]], number[p[i:]], r, number[p]) for p, r in pieces.items() if len(p) > 1
                for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        left, right, rank, made = np.array(rows, np.int64).reshape(-1, 4).T
        order = np.argsort(left * self.size + right)
        self.keys = (left * self.size + right)[order]
        self.rank, self.made = rank[order].astype(np.int32), made[order].astype(np.int32)
        self.table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        # ranks whose symbol forms a pair that does not rank higher
        of = np.full(self.size, -1, np.int64)
        of[made] = rank
        early = np.concatenate([of[left][rank <= of[left]], of[right][rank <= of[right]]])
        self.swept = np.unique(early).astype(np.int32)
        near = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.near = np.unique(np.array([number[a] * self.size + number[b] for a, b in near], np.int64))

    def _find(self, sorted_keys, keys):
        at = np.searchsorted(sorted_keys, keys)
        at[at == len(sorted_keys)] = 0
        return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)

    def pair(self, left, right):
        """(rank, merged symbol) of each pair; rank _NONE if it is none."""
        at, found = self._find(self.keys, left.astype(np.int64) * self.size + right)
        if not len(self.keys):
            return np.full(len(left), _NONE), np.zeros(len(left), np.int32)
        return np.where(found, self.rank[at], _NONE), self.made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (each with at least one character)."""
        joined = "".join(words)
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.symbol[code]
        plain = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        total = np.bincount(word, np.where(sym < 0, plain, 0), len(words)).astype(np.int64)
        known = sym >= 0
        # a cut before each first character, and wherever no piece has both neighbours
        cut = np.ones(len(sym), bool)
        inner = np.flatnonzero(known[1:] & known[:-1] & (word[1:] == word[:-1])) + 1
        cut[inner] = ~self._find(self.near, sym[inner - 1].astype(np.int64) * self.size + sym[inner])[1]
        sym, seq, word = sym[known], (np.cumsum(cut) - 1)[known], word[known]
        return total + np.bincount(word[self.merged(sym, seq)], minlength=len(words))

    def merged(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Places of the symbols that survive; ``seq``: ascending number of the sequence of each symbol."""
        survived, place = [], np.arange(len(sym))
        rank = np.full(len(sym), _NONE)
        made = np.zeros(len(sym), np.int32)

        def look(at):
            """Refresh the pairs that begin at ``at``."""
            rank[at], made[at] = _NONE, 0
            at = at[at + 1 < len(sym)]
            at = at[seq[at] == seq[at + 1]]
            rank[at], made[at] = self.pair(sym[at], sym[at + 1])

        look(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            if (low == _NONE).any():
                over = np.repeat(low == _NONE, sizes)
                survived.append(place[over])
                sym, seq, place, rank, made = (x[~over] for x in (sym, seq, place, rank, made))
                starts, sizes, low = None, sizes[low != _NONE], low[low != _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, sizes)
            keep = np.ones(len(sym), bool)
            if starts is None:
                starts = np.cumsum(sizes) - sizes
            careful = np.flatnonzero(np.isin(low, self.swept))
            if len(careful):
                places = np.add.reduceat(hit, starts, dtype=np.int64)[careful]
                for s in careful[places > FEW]:
                    self._sweep(sym, rank, made, keep, hit, int(starts[s]), int(starts[s] + sizes[s]), low[s])
                # the leftmost only; the next step sees the pairs that it makes
                one = np.zeros(len(low), bool)
                one[careful[(places > 1) & (places <= FEW)]] = True
                at = np.flatnonzero(hit & np.repeat(one, sizes))
                hit[at[1:][seq[at[1:]] == seq[at[:-1]]]] = False
            # of overlapping places every other one, from the left
            at = np.flatnonzero(hit)
            if len(at):
                run = np.r_[True, np.diff(at) != 1]
                offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[offset % 2 == 0]
                sym[at] = made[at]
                keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            changed = moved[np.flatnonzero(~keep)]  # the symbol that took up its right neighbour
            sym, seq, place, rank, made = (x[keep] for x in (sym, seq, place, rank, made))
            again = np.zeros(len(sym), bool)
            again[changed] = again[changed[changed > 0] - 1] = True
            look(np.flatnonzero(again))
        return np.sort(np.concatenate(survived)) if survived else np.empty(0, np.int64)

    def _sweep(self, sym, rank, made, keep, hit, first, end, low):
        """Merge one by one, in symbols ``first:end``, the places of rank ``low`` and every pair
        of no higher rank that this makes; mark what is taken up in ``keep``."""
        after, before = list(range(1, end - first + 1)), list(range(-1, end - first - 1))
        s = sym[first:end].tolist()
        at = np.flatnonzero(hit[first:end])
        heap = [(int(low), i, s[i], s[i + 1], int(made[first + i])) for i in at.tolist()]
        hit[first:end] = False
        alive = [True] * len(s)
        while heap:
            r, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j == len(s) or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], after[i] = new, False, after[j]
            if after[j] < len(s):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(s):
                    found = self.table.get(s[x] * self.size + s[y])
                    if found and found[0] <= low:
                        heapq.heappush(heap, (found[0], x, s[x], s[y], found[1]))
        sym[first:end] = s
        keep[first:end] = alive


_loaded: dict = {}


def load(path: str) -> Merges:
    """The merge table of the SentencePiece BPE model at ``path``; a worker loads it once."""
    if path not in _loaded:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        n = model.get_piece_size()
        if sum(map(model.is_byte, range(n))) != 256 or any(map(model.is_unused, range(n))):
            raise ValueError("the model has no byte fallback, or unused pieces")
        if model.normalize(" A  ﬁ ") != SPACE * 2 + "A " + SPACE + "ﬁ" + SPACE:
            raise ValueError("the model changes texts by more than a leading blank")
        score = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not special(i)}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        _loaded[path] = Merges({p: rank[s] for p, s in score.items()}), {}
    return _loaded[path]


def _chunks(texts):
    """Slices of ``texts`` with about CHUNK_CHARS characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield texts[first:i + 1]
            first, size = i + 1, 0
    yield texts[first:]


def count_tokens(texts: list, path: str) -> list[int]:
    """Tokens of each text."""
    merges, known = load(path)
    counts = []
    for chunk in _chunks(texts):
        parts = [_PRETOKEN.findall(" " + t.replace(SPACE, " ")) if t else [] for t in chunk]
        new = set().union(*parts).difference(known)
        if new:
            new = list(new)
            known.update(zip(new, merges.count([w.replace(" ", SPACE) for w in new]).tolist()))
        counts.extend(sum(map(known.__getitem__, p)) for p in parts)
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        if len(known) > CACHE_WORDS:
            known.clear()
    return counts


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``; ``path``: the model's file on every worker."""
    rows = ready(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def counted(batches):
        for rb in batches:
            n = pa.array(count_tokens(rb.column(1).to_pylist(), path), pa.int64())
            size = pa.compute.cast(pa.compute.binary_length(rb.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column(0), size, n, pa.compute.greater(n, limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401 - pa.compute
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")

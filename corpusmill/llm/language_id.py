"""Language of texts and of spans within mixed texts.

*Learning.*  Every labelled text is cut into words, and the byte trigrams of its
lower-cased words (with their borders) are counted per language in ``BUCKETS`` hash
buckets; so are its words per script.  Each partition adds up its own counts, the
sums are merged by a grouped aggregation, and the model that reaches the driver has
at most ``BUCKETS`` numbers for each language, however many texts there are.

*Prediction.*  The script of a word (from its code point ranges) narrows the languages
it can belong to: those that use the script in at least ``MIN_SHARE`` of their words.
A word's score for each of them is the sum of its trigrams' log probabilities.  The
best labelling of all words, with a penalty for each switch of language, is found by
Viterbi, for many texts at a time.  Runs of one label are the spans.  The text's
language is the one whose spans have the most letters; the score is their share.

Cases: a null text, and one without a letter, is ``und`` with score 0 and no spans.
Words without letters carry no evidence, and neither do words in a script that no
language uses.  Ties go to the language first in alphabetical order.  Without any
labelled text all is ``und``.  Rows with a null id or label are not learned from.  Whole
texts are read, in chunks of words, so long ones need no more memory than their
words.  Repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ready

BUCKETS = 1 << 16
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
MIN_SHARE = 0.01
UNKNOWN = "und"
CHUNK_BYTES = 1 << 20
#: Words outside plain ASCII letters whose script a worker remembers.
CACHE_WORDS = 1 << 18

# First code points of Unicode script ranges.  A range ends where the next begins.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
]
_STARTS = [x for x, _ in SCRIPT_RANGES]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
NO_LETTER = len(SCRIPTS)
_LATIN = SCRIPTS.index("latin")
_HASH = np.uint32(0x9E3779B1)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_scripts_of: dict[bytes, int] = {}


def _script(word: bytes) -> int:
    """The script of a word: that of its first letter beyond Latin, if any."""
    got = _scripts_of.get(word)
    if got is None:
        if len(_scripts_of) >= CACHE_WORDS:
            _scripts_of.clear()
        got = NO_LETTER
        for c in word.decode():
            if c.isalpha():
                got = SCRIPTS.index(SCRIPT_RANGES[bisect_right(_STARTS, ord(c)) - 1][1])
                if got != _LATIN:
                    break
        _scripts_of[word] = got
    return got


def _words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _scripts(words: list[bytes]) -> np.ndarray:
    return np.fromiter((_LATIN if w.isalpha() else _script(w) for w in words), np.int8, len(words))


def _chunks(words: list[bytes]):
    """Runs of words of about CHUNK_BYTES."""
    at = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= CHUNK_BYTES:
            yield words[at:i + 1]
            at, size = i + 1, 0
    if at < len(words):
        yield words[at:]


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each byte (BUCKETS for the gaps between
    words), and where each word starts."""
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    bucket = ((code * _HASH) >> np.uint32(16)).astype(np.int32)
    bucket[a[1:-1] == 32] = BUCKETS
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    return bucket, starts


def _counted(batches):
    """Rows ``lang, bucket, n``: trigram counts, and word counts per script in the
    buckets after BUCKETS."""
    counts: dict[str, np.ndarray] = {}
    waiting: dict[str, tuple[list[bytes], int]] = {}  # words of short texts, and their texts' characters

    def add(lang, words):
        own = counts.setdefault(lang, np.zeros(BUCKETS + 1 + len(SCRIPTS) + 1, np.int64))
        for part in _chunks(words):
            own[:BUCKETS + 1] += np.bincount(_trigrams(part)[0], minlength=BUCKETS + 1)
            own[BUCKETS + 1:] += np.bincount(_scripts(part), minlength=len(SCRIPTS) + 1)

    for rb in batches:
        for text, lang in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            words, size = waiting.get(lang, ([], 0))
            words.extend(_words(text))
            if size + len(text) > CHUNK_BYTES:
                add(lang, words)
                words, text = [], ""
                size = 0
            waiting[lang] = words, size + len(text)
    for lang, (words, _) in waiting.items():
        add(lang, words)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())],
            ["lang", "bucket", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """A model from the labelled rows of ``docs``: ``langs``, ``logp`` (bucket x language;
    the last row, for gaps, is 0) and ``allowed`` (script x language)."""
    src = (ready(docs).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
           .filter("text is not null and lang is not null"))
    sums = (src.mapInArrow(_counted, "lang string, bucket int, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = sums.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((BUCKETS + 1 + len(SCRIPTS) + 1, len(langs)))
    counts[sums.column("bucket").to_numpy(), np.searchsorted(np.array(langs, dtype=object), names) if names else []] = \
        sums.column("n").to_numpy()
    grams = counts[:BUCKETS] + SMOOTHING
    logp = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    logp[:BUCKETS] = np.log(grams / grams.sum(0))
    words = counts[BUCKETS + 1:-1]
    allowed = words >= MIN_SHARE * np.maximum(words.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return {"langs": langs, "logp": logp, "allowed": allowed}


def _word_scores(words: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word for each language, and its letters' bytes."""
    parts = []
    for part in _chunks(words):
        bucket, starts = _trigrams(part)
        parts.append(np.add.reduceat(model["logp"][bucket], starts, axis=0))
    score = np.concatenate(parts)
    script = _scripts(words)
    known = script < NO_LETTER
    score -= score.max(1, keepdims=True)
    score[~known] = 0
    ok = model["allowed"][np.where(known, script, _LATIN)]
    score[known[:, None] & ~ok] = -1e4
    return score, np.where(known, [len(w) for w in words], 0)


def _viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best labels of each text's words; all texts advance together, one word a
    step, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    back = np.empty(flat.shape, np.int16)
    value = flat[first].astype(np.float64)
    states = np.arange(flat.shape[1], dtype=np.int16)[None, :]
    for t in range(1, int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, "left"))  # texts with more than t words
        v = value[:n]
        top = v.argmax(1)
        leap = v[np.arange(n), top] - penalty
        switch = leap[:, None] > v
        back[first[:n] + t] = np.where(switch, top[:, None].astype(np.int16), states)
        value[:n] = np.where(switch, leap[:, None], v) + flat[first[:n] + t]
    labels = np.empty(len(flat), np.int16)
    cur = value.argmax(1).astype(np.int16)
    labels[first + lengths - 1] = cur
    for t in range(int(lengths[0]) - 1, 0, -1):
        n = int(np.searchsorted(-lengths, -t, "left"))
        at = first[:n] + t
        labels[at - 1] = back[at, labels[at]]
    out: list = [None] * len(scores)
    for k, i in enumerate(order):
        out[i] = labels[first[k]:first[k] + lengths[k]]
    return out


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[tuple[str, int, int]]:
    """Runs of one label, in code points from the first to the last word."""
    cuts = np.flatnonzero(np.diff(labels)) + 1
    places = [m.span() for m in _WORD.finditer(text)]
    ends = [*cuts.tolist(), len(labels)]
    return [(langs[labels[a]], places[a][0], places[b - 1][1]) for a, b in zip([0, *ends], ends)]


def _labelled(texts: list, model: dict, penalty: float) -> list[tuple]:
    """``lang, score, spans`` of each text."""
    out: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
    langs = model["langs"]
    if not langs:
        return out
    live, scores, letters = [], [], []
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            s, n = _word_scores(_words(text), model)
            live.append(i)
            scores.append(s)
            letters.append(n)
    if not live:
        return out
    for i, labels, n in zip(live, _viterbi(scores, penalty), letters):
        share = np.bincount(labels, weights=n, minlength=len(langs))
        best = int(share.argmax())
        out[i] = (langs[best], float(share[best] / max(share.sum(), 1)), _spans(texts[i], labels, langs))
    return out


def _predicted(batches, shared, penalty):
    model = shared.value
    for rb in batches:
        rows = _labelled(rb.column(1).to_pylist(), model, penalty)
        flat = [x for _, _, spans in rows for x in spans]
        ends = np.cumsum([0] + [len(spans) for _, _, spans in rows])
        struct = pa.StructArray.from_arrays(
            [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()),
             pa.array([x[2] for x in flat], pa.int64())], ["lang", "start", "end"])
        yield pa.RecordBatch.from_arrays(
            [rb.column(0), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.float64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], ["doc_id", "lang_pred", "score", "spans"])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
            penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, spans array<struct<lang, start, end>>`` per row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language
    src = ready(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(
        lambda it: _predicted(it, shared, penalty),
        f"doc_id {id_type}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")

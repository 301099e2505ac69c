"""License notices in texts, by winnowed fingerprints and banded alignment.

1. The word runs of every template are hashed and winnowed: of each ``window``
   neighbours the smallest hash is kept, so every run of ``gram + window - 1`` words of
   the template has a fingerprint in the inverted index.  Both are chosen per template,
   three-word runs and a window of two at most: if ``m`` words must match at
   ``min_percent``, ``e`` edits (those that leave ``m`` words, one at least) leave a run
   of ``m / (e + 1)`` words, rounded up, and no more than that is asked for.
2. All runs of a document are looked up in the index, so a notice with up to ``e`` words
   changed, left out or put in has a hit.  A hit names a template and a diagonal (place
   in the document less place in the template); hits on near diagonals form one
   candidate.  A candidate around which too few of the template's words occur is dropped.
3. Each candidate is aligned word by word, locally, in a band around its diagonals: a match gains
   ``GAIN``, every other word of the document inside the alignment costs 1, and words of the
   template that are left out cost nothing but their match, so a run of words put in or
   left out is bridged when more than one in GAIN of its length match on either side.  Of equal
   scores the one with more matches stays.  The band is as wide as the edits that the template
   allows, ``BAND`` at least, on either side.  The alignment gives the matched words,
   the coverage (their share of the template) and the span in the document.
4. Of overlapping spans the one with the most matched words is reported (then the
   highest coverage, the earliest start, the first name), if its coverage reaches
   ``min_percent``.

Words are compared in lower case without punctuation at their ends.  The templates are a
parameter and go to every task; ``MAX_TEMPLATE_WORDS`` bounds them.  Documents are read
whole, in one pass, and nothing is shuffled.

Cases: a null or blank text, and a template without words, match nothing.  Equal
templates are told apart by name only; the first is reported.  A notice that occurs
several times is reported each time.  Null ids are passed through, repeated rows are
scanned alike, other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import gram_hashes, ready, word_hashes

GRAM = 3
WINDOW = 2
BAND = 8
GAIN = 8
MIN_PERCENT = 80
MAX_TEMPLATE_WORDS = 1_000_000
MAX_WORDS = 100_000

# The usual wording of public license notices and of short license texts.
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
          "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
          "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
          "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
          "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
          "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
          "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd": "Released under the BSD License.",
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "bsd-2-clause-text": _BSD + _AS_IS,
    "bsd-3-clause-text": _BSD + (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. ") + _AS_IS,
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "gpl-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."),
    "lgpl-3": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_EDGE = b"\"'`.,;:!?()[]{}<>*#$%&|~^_/\\-+="
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text: bytes) -> tuple[list[bytes], list[int]]:
    """The compared words of a text and their places among its words."""
    words = [w.strip(_EDGE) for w in text.lower().split()]
    at = [i for i, w in enumerate(words) if w]
    return [words[i] for i in at], at


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the smallest of every ``window`` neighbouring hashes."""
    if len(hashes) <= window:
        return [int(hashes.argmin())] if len(hashes) else []
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return sorted({int(i + j) for i, j in enumerate(view.argmin(1))})


def needed(n: int, min_percent: int) -> int:
    """Words that must match of a template of ``n`` words."""
    return -(-min_percent * n // 100)


def gram_and_window(n: int, min_percent: int) -> tuple[int, int]:
    """Longest runs and window that leave a fingerprint in a template of ``n`` words of
    which as many are edited as ``min_percent`` allows, or one if it allows none."""
    match = max(1, needed(n, min_percent))
    run = -(-match // (max(1, n - match) + 1))
    gram = min(GRAM, run)
    return gram, min(WINDOW, run - gram + 1)


def build_index(templates: dict[str, str], min_percent: int = MIN_PERCENT) -> dict:
    """Words of every template, and the inverted index (sorted hash -> template, place)."""
    names, words, posts = sorted(templates), [], []
    for t, name in enumerate(names):
        w = _words(templates[name].encode())[0]
        words.append(w)
        if w:
            n, window = gram_and_window(len(w), min_percent)
            h = gram_hashes(word_hashes(w), n)
            posts += [(int(h[p]), t, p, n) for p in winnow(h, window)]
    if sum(map(len, words)) > MAX_TEMPLATE_WORDS or max(map(len, words), default=0) > MAX_WORDS:
        raise ValueError("the templates exceed MAX_TEMPLATE_WORDS, or one exceeds MAX_WORDS")
    posts.sort()
    return {"names": names, "words": words, "posts": posts, "counts": [Counter(w) for w in words],
            "hashes": {n: np.array(sorted({p[0] for p in posts if p[3] == n}), np.uint64) for n in range(1, GRAM + 1)}}


# An alignment is one number that compares as (score, matched words, earlier start).
_SCORE, _MATCH = 1 << 42, 1 << 21
_NOTHING = -(1 << 61)


def _align(doc: list[bytes], template: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment within the diagonals ``low ... high`` (doc place less
    template place): matched words, first and last word in ``doc``."""
    number = {w: i for i, w in enumerate(dict.fromkeys(template))}
    width = high - low + 1
    # the words of the band; -1 stands for any word outside of the template or the text
    own = np.full(width + len(template), -1, np.int64)
    inside = range(max(0, low), min(len(doc), low + len(own)))
    own[inside.start - low:inside.stop - low] = [number.get(w, -1) for w in doc[inside.start:inside.stop]]
    step = np.arange(width, dtype=np.int64) * _SCORE
    fresh = GAIN * _SCORE + 2 * _MATCH - 1 - np.arange(len(own), dtype=np.int64)  # starts at each place
    prev, best, last = np.full(width + 1, _NOTHING), _NOTHING, 0
    for j, word in enumerate(template):
        hit = own[j:j + width] == number[word]
        cell = np.where(hit, np.maximum(prev[:-1] + (GAIN * _SCORE + _MATCH), fresh[j:j + width]), prev[:-1] - _SCORE)
        cell = np.maximum(cell, prev[1:])  # the template word is left out
        top = int(np.where(hit, cell, _NOTHING).argmax())
        if hit[top] and cell[top] > best:
            best, last = int(cell[top]), j + top
        cell = np.maximum.accumulate(cell + step) - step  # words of the document are left out
        prev[:-1] = np.where(cell < _SCORE, _NOTHING, cell)
    if best == _NOTHING:
        return 0, 0, 0
    matched, start = divmod(best % _SCORE, _MATCH)
    return matched, low + _MATCH - 1 - start, low + last


def find_notices(text: bytes | None, index: dict, min_percent: int = MIN_PERCENT) -> list[tuple]:
    """``name, matched, template words, start, end`` (code points) of the notices in a text."""
    if not text:
        return []
    words, at = _words(text)
    if not words:
        return []
    hashes = word_hashes(words)
    hits: dict[int, set[tuple[int, int]]] = {}  # template -> (diagonal, place in the text)
    for n, known in index["hashes"].items():
        grams = gram_hashes(hashes, n)
        if not len(known) or not len(grams):
            continue
        place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        for i in np.flatnonzero(known[place] == grams).tolist():
            h = int(grams[i])
            k = bisect_left(index["posts"], (h,))
            while k < len(index["posts"]) and index["posts"][k][0] == h:
                _, t, p, size = index["posts"][k]
                if size == n:
                    hits.setdefault(t, set()).add((i - p, i))
                k += 1
    if not hits:
        return []
    found = []
    for t, places in hits.items():
        template, count, run = index["words"][t], index["counts"][t], []
        need = needed(len(template), min_percent)
        band = max(BAND, len(template) - need)
        for hit in [*sorted(places), None]:
            if run and (hit is None or hit[0] - run[-1][0] > band or hit[0] - run[0][0] > len(template)):
                free = words
                while run:  # once more for the hits outside of what was found
                    near = free[max(0, run[0][0] - band):max(0, run[-1][0] + band + len(template))]
                    if sum(min(count[w], k) for w, k in Counter(filter(count.__contains__, near)).items()) < need:
                        break
                    m, a, b = _align(free, template, run[0][0] - band, run[-1][0] + band)
                    if not m or m < need:
                        break
                    found.append((-m, -m / len(template), a, index["names"][t], b, len(template)))
                    free = [*free[:a], *[b""] * (b - a + 1), *free[b + 1:]]
                    run = [x for x in run if not a <= x[1] <= b]
                run = []
            run.append(hit)
    if not found:
        return []
    places = [m.span() for m in _WORD.finditer(text.decode())]
    out, taken = [], []
    for m, _, a, name, b, size in sorted(found):
        if all(b < x or a > y for x, y in taken):
            taken.append((a, b))
            out.append((name, -m, size, places[at[a]][0], places[at[b]][1]))
    return sorted(out, key=lambda x: (x[3], x[0]))


def _scanned(batches, index, min_percent):
    for rb in batches:
        rows = [(i, *x) for i, text in enumerate(rb.column(1).to_pylist()) for x in find_notices(text, index, min_percent)]
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [rb.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
             *[pa.array(c, pa.int64()) for c in cols[2:]]],
            ["doc_id", "license", "matched", "template_words", "start", "end"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         min_percent: int = MIN_PERCENT) -> DataFrame:
    """``doc_id, license, matched, template_words, start, end, coverage`` per notice found."""
    index = build_index(TEMPLATES if templates is None else templates, min_percent)
    id_type = docs.schema[id_col].dataType.simpleString()
    src = ready(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = src.mapInArrow(lambda it: _scanned(it, index, min_percent),
                           f"doc_id {id_type}, license string, matched bigint, template_words bigint, start bigint, end bigint")
    return found.withColumn("coverage", F.col("matched") / F.col("template_words"))

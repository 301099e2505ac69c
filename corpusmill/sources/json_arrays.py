"""The elements of a top-level array of a JSON document, which is read in splits of any size.

``{"info": {...}, "annotations": [{...}, {...}], ...}`` may be one line of many gigabytes.  Spark's text
source deals it to splits at commas, so no character and no escape is ever cut, and a reader that starts
in the middle must learn whether it stands in a string, how deep, and in which array:

1. One pass per split gives, for either state at its start (outside or inside of a string), the state at its end
   and the change of depth.  Composed in file order, one row per split, this gives every split its true
   state and depth.
2. With these, a second pass tells per split how many elements of the array start in it and whether the array
   is open at its end, again as a function of what holds at its start.  Composed, this numbers the elements.
3. A third pass cuts the elements out.  Only the one or two per split that cross its bounds are shuffled, by
   number, and joined.

An element's text is parsed once, by ``from_json``.  Memory is one Arrow batch and one element.  The driver
holds a row per split.

Cases: a missing, null or empty array, a field that is no array, and an empty file give no rows; the same
name below the top level is another field; a field that occurs twice gives the elements of both, counted on;
an element may be of any kind, ``null`` included.  The documents must be whole and valid JSON, one per file.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import reliable_checkpoint, ship_package
from corpusmill.sources.records import _lines, _splits

# the rest of a string up to its closing quote
_REST = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
# a string, closed or not
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"?', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("?)|[][{},]', re.S)
_EMPTY = re.compile(r"\s*\]")


def passed(text: str, inside: bool) -> tuple[bool, int]:
    """(inside of a string, change of depth) behind ``text``."""
    at = 0
    if inside:
        m = _REST.match(text)
        if not m:
            return True, 0
        at = m.end()
    bare = _STRING.sub(lambda m: '""' if m[0].endswith('"') and len(m[0]) > 1 else '"', text[at:])
    depth = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    return bare.count('"') % 2 == 1, depth


class Scanner:
    """Walks over the text of a document in pieces and tells where elements of the array start and end."""

    def __init__(self, field: str, inside: bool, depth: int, is_open: bool):
        self.field, self.inside, self.depth, self.is_open, self.key = field, inside, depth, is_open, None

    def events(self, text: str):
        """``(kind, at)``: ``open`` with the place of the first element, ``next`` and ``close`` with the place of the
        comma or bracket behind an element."""
        at = 0
        if self.inside:
            m = _REST.match(text)
            if not m:
                return
            self.inside, at, self.key = False, m.end(), None
        for m in _TOKEN.finditer(text, at):
            c = text[m.start()]
            if c == '"':
                if not m[1]:
                    self.inside = True
                elif self.depth == 1:
                    self.key = m[0]
            elif c == ",":
                if self.depth == 2 and self.is_open:
                    yield "next", m.start()
            elif c in "{[":
                self.depth += 1
                if (self.depth == 2 and c == "[" and self.key is not None and json.loads(self.key, strict=False) == self.field
                        and not _EMPTY.match(text, m.end())):
                    self.is_open = True
                    yield "open", m.end()
            else:
                self.depth -= 1
                if self.depth == 1 and self.is_open:
                    self.is_open = False
                    yield "close", m.start()


def _runs(batches):
    """((file, start), text) of each run of comma pieces of one split; every piece is followed by a comma.
    The one behind a file's last piece is outside of its document and tells nothing."""
    for rb in batches:
        for file, start, pieces in _splits([rb]):
            yield (file, start), ",".join(pieces) + ","


def _keyed(found: dict, names) -> pa.RecordBatch:
    cols = list(zip(*found.values())) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                                       *[pa.array(c, pa.int64()) for c in cols]], ["file", "start", *names])


_STATE = ("out0", "d0", "out1", "d1")
_COUNT = ("first", "closed", "n", "is_open")


def _states(batches):
    found: dict = {}
    for key, text in _runs(batches):
        state = found.setdefault(key, [0, 0, 1, 0])
        for k in (0, 2):
            inside, depth = passed(text, bool(state[k]))
            state[k:k + 2] = int(inside), state[k + 1] + depth
    yield _keyed(found, _STATE)


def _counts(field: str, known):
    """Per split, if the array is open at its start: elements that start before it closes, and whether it does; and in any
    case the elements that start in arrays opened by the split, and whether one is open at its end."""
    def fn(batches):
        found: dict = {}
        now = scan = None
        for key, text in _runs(batches):
            if key != now:
                inside, depth = known.value[key]
                now, scan, inherited = key, Scanner(field, inside, depth, depth >= 2), depth >= 2
            count = found.setdefault(key, [0, 0, 0, 0])
            for kind, _ in scan.events(text):
                if inherited:
                    count[0] += kind == "next"
                    if kind == "close":
                        count[1], inherited = 1, False
                else:
                    count[2] += kind != "close"
            count[3] = int(scan.is_open and not inherited)
        yield _keyed(found, _COUNT)
    return fn


def _cut(field: str, known):
    """(file, pos, part, text): whole elements with part -1, and pieces of those that cross splits, ``part`` in file order."""
    def fn(batches):
        now = scan = held = None
        pos, whole, order = 0, False, 0
        for key, text in _runs(batches):
            out = []
            if key != now:
                if held is not None:
                    out.append((now[0], pos, order, "".join(held)))
                inside, depth, is_open, base, order = known.value[key]
                now, scan = key, Scanner(field, inside, depth, is_open)
                held, pos, whole = ([], base - 1, False) if is_open else (None, base - 1, True)
            at = 0
            for kind, place in scan.events(text):
                if kind != "open":
                    held.append(text[at:place])
                    out.append((key[0], pos, -1 if whole else order, "".join(held)))
                    held = None
                if kind != "close":
                    held, pos, whole, at = [], pos + 1, True, place + (kind == "next")
            if held is not None:
                held.append(text[at:])
            yield _piece_batch(out)
        if held is not None:
            yield _piece_batch([(now[0], pos, order, "".join(held))])
    return fn


def _piece_batch(rows):
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                      ["file", "pos", "part", "text"])


def _in_file_order(df: DataFrame):
    """Rows of a table with one row per split, each with whether it starts its file."""
    last = None
    for r in sorted(df.collect(), key=lambda r: (r.file, r.start)):
        yield r, r.file != last
        last = r.file


def read_array_texts(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, pos, text): the JSON text of every element of the top-level array ``field`` of the document(s), numbered
    within its document.  The elements are checkpointed; the documents are not read again."""
    ship_package(spark)
    pieces = _lines(spark, path, ",")
    numbers = lambda names: "file string, start long, " + ", ".join(f"{n} long" for n in names)
    share = spark.sparkContext.broadcast
    state, inside, depth = {}, 0, 0
    for r, is_first in _in_file_order(pieces.mapInArrow(_states, numbers(_STATE))):
        if is_first:
            inside, depth = 0, 0
        state[r.file, r.start] = bool(inside), depth
        inside, depth = (r.out1, depth + r.d1) if inside else (r.out0, depth + r.d0)
    known, is_open, base = {}, False, 0
    counted = pieces.mapInArrow(_counts(field, share(state)), numbers(_COUNT))
    for order, (r, is_first) in enumerate(_in_file_order(counted)):
        if is_first:
            is_open, base = False, 0
        known[r.file, r.start] = (*state[r.file, r.start], is_open, base, order)
        base += r.n + (r.first if is_open else 0)
        is_open = bool(r.is_open) or is_open and not r.closed
    cut = reliable_checkpoint(pieces.mapInArrow(_cut(field, share(known)), "file string, pos long, part long, text string"))
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))     # the pieces of one element
    joined = (cut.filter("part >= 0").groupBy("file", "pos")
              .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")))
    return cut.filter("part < 0").select("file", "pos", "text").unionByName(joined)


def read_array(spark: SparkSession, path: str, field: str, schema) -> DataFrame:
    """(file, pos, e): every element of the top-level array ``field``, parsed into ``schema``."""
    return read_array_texts(spark, path, field).select("file", "pos", F.from_json("text", schema).alias("e"))


def write_arrays(rows: DataFrame, path: str, field: str, element: str = "element", head: dict | None = None) -> None:
    """``rows`` as documents ``{head..., field: [...]}`` below ``path``: one per partition, streamed, elements in the
    partition's order and ``element`` their JSON text.  A partition without rows is a document with an empty list."""
    start = json.dumps(head or {})[:-1] + (", " if head else "") + json.dumps(field) + ": ["

    def lines(batches):
        is_first = True
        for rb in batches:
            texts = rb.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([(start if is_first and not i else ", ") + t
                                                            for i, t in enumerate(texts)], pa.string())], ["value"])
                is_first = False
        yield pa.RecordBatch.from_arrays([pa.array([(start if is_first else "") + "]}"], pa.string())], ["value"])

    ship_package(rows.sparkSession)
    rows.select(F.col(element).cast("string")).mapInArrow(lines, "value string").write.text(path)

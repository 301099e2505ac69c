"""A4, A5: the records of quoted delimited files, split at any line whatever the quotes.

A quoted field may hold line breaks, so a reader that starts in the middle of a file does not know
whether it stands inside a record.  What a run of lines does to that question is a function of two
states, outside and inside of a quoted field, and such functions compose:

1. Spark's text source deals the lines of each file to splits.  One pass per split gives, for either state at
   its start, the state at its end and the number of records that start in it.
2. Composed in file order, one row per split, this gives every split its true state and the number
   of its first record.
3. A second pass cuts each split into records.  At most two pieces per split belong to records that cross
   splits; only these are shuffled, by record number, and joined.

The text of a record is then parsed once, by ``from_csv``.  A quote opens a quoted field only at the start of
a field; inside, a doubled quote is a quote.  Records end with a line feed, with or without a carriage
return; empty lines are no records.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import reliable_checkpoint, ship_package

USUAL_FIELDS = 20_000
MOST_FIELDS = 2_000_000

# up to the quote that closes a field
_CLOSE = re.compile(r'(?:[^"]++|"")*+"')


def after_line(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open behind ``line``."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _CLOSE.match(line, at if inside else at + 1)
            if not closed:
                return True
            inside, at = False, closed.end()
        at = line.find(sep, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    rows = spark.read.text(path, lineSep=end)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _splits(batches):
    """(file, start, lines) of each run of lines of one split, in order; a batch boundary may cut a run."""
    for rb in batches:
        files, starts, lines = rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist()
        at = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or starts[i] != starts[at] or files[i] != files[at]:
                yield files[at], starts[at], lines[at:i]
                at = i


def _is_record(line: str) -> bool:
    return line not in ("", "\r")


def _summaries(sep: str):
    """Per split and state at its start (0 outside, 1 inside): the state at its end and the records that start in it."""
    def fn(batches):
        found: dict = {}
        for file, start, lines in _splits(batches):
            state = found.setdefault((file, start), [0, 1, 0, 0])
            for line in lines:
                for k in (0, 1):
                    state[2 + k] += not state[k] and _is_record(line)
                    state[k] = int(after_line(line, bool(state[k]), sep))
        keys = list(found)
        cols = list(zip(*found.values())) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                                          *[pa.array(c, pa.int64()) for c in cols]],
                                         ["file", "start", "out0", "out1", "n0", "n1"])
    return fn


def _cut(sep: str, known):
    """(rec, part, text): whole records with part -1, and the pieces of records that cross splits, ``part`` in file order."""
    def fn(batches):
        now, inside, rec, text, started = None, False, 0, None, False
        for file, start, lines in _splits(batches):
            out = []
            if (file, start) != now:
                if text is not None:          # open at the end of its split
                    out.append((rec, known.value[now][2], text))
                now, text = (file, start), None
                inside, base, order = known.value[now]
                rec, started = base - 1, False
            for line in lines:
                if not inside and not _is_record(line):
                    continue
                if not inside:
                    rec, text, started = rec + 1, line, True
                else:
                    text = line if text is None else f"{text}\n{line}"
                inside = after_line(line, inside, sep)
                if not inside:
                    out.append((rec, -1 if started else known.value[now][2], text))
                    text = None
            yield _piece_batch(out)
        if text is not None:
            yield _piece_batch([(rec, known.value[now][2], text)])
    return fn


def _piece_batch(rows):
    cols = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                      ["rec", "part", "text"])


def read_record_texts(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(rec, text): the raw text of every record of the file(s), numbered in file order."""
    ship_package(spark)
    lines = _lines(spark, path)
    rows = lines.mapInArrow(_summaries(sep), "file string, start long, out0 long, out1 long, n0 long, n1 long")
    # one row per split; a split whose rows came in several runs is one run of one task all the same
    known, state, base, last = {}, 0, 0, None
    for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r.file, r.start))):
        if r.file != last:
            state, last = 0, r.file            # a quote left open ends with its file
        known[r.file, r.start] = (bool(state), base, i)
        base, state = base + r[f"n{state}"], r[f"out{state}"]
    pieces = reliable_checkpoint(lines.mapInArrow(_cut(sep, spark.sparkContext.broadcast(known)), "rec long, part long, text string"))
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))     # the pieces of one record
    joined = (pieces.filter("part >= 0").groupBy("rec")
              .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")))
    both = pieces.filter("part < 0").select("rec", "text").unionByName(joined)
    return both.withColumn("text", F.regexp_replace("text", "\r$", ""))


def fields_of(records: DataFrame, schema: str, sep: str = ",", keep_empty: bool = False) -> DataFrame:
    """``records`` with their texts parsed into the struct ``f`` of ``schema``; empty fields are null, or stay
    empty with ``keep_empty``.  The parser allocates for the most fields it may meet, so the wide one is only made by a
    task that meets a record of more than ``USUAL_FIELDS`` separators."""
    options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    if keep_empty:
        options["nullValue"] = "\0"
    parsed = lambda most: F.from_csv("text", schema, {**options, "maxColumns": str(most)})
    many = F.length("text") - F.length(F.replace("text", F.lit(sep), F.lit(""))) >= USUAL_FIELDS * len(sep)
    return records.withColumn("f", F.when(many, parsed(MOST_FIELDS)).otherwise(parsed(USUAL_FIELDS)))

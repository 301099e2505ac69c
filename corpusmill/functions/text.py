"""Text expressions shared by the corpus and selection operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes for the
# ASCII range (space, tab, newline, carriage return, vertical tab, form feed).
STRIP_CHARS = " \t\n\r\x0b\x0c"

# Fixed value: tokens of the TF-IDF vectoriser default (``\b\w\w+\b``, Unicode),
# written so that Java regex and RE2 agree: two or more letters/digits/underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# The same tokens as maximal runs between separators (faster than extracting).
TOKEN_SEPARATOR = r"[^\p{L}\p{N}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()`` on the ASCII whitespace set."""
    return F.trim(_col(c), F.lit(STRIP_CHARS))


def tokens(c) -> Column:
    """Lower-cased word tokens, in text order (duplicates kept): the maximal
    runs of letters/digits/underscore of length >= 2, i.e. the matches of
    ``TOKEN_PATTERN``, found by splitting on separator runs (2.5x faster
    than ``regexp_extract_all`` on the same input, identical output)."""
    return F.filter(F.split(F.lower(_col(c)), TOKEN_SEPARATOR), lambda x: F.length(x) >= 2)


def lines(c) -> Column:
    """Split a text into its lines (``\\n``)."""
    return F.split(_col(c), "\n")


def nonblank_lines(c) -> Column:
    return F.filter(lines(c), lambda x: x != "")


def shard_row_key(key) -> Column:
    """``int(key[:5]) * 10000 + int(key[5:])`` of a ``SSSSSNNNN`` key."""
    k = _col(key)
    return F.substring(k, 1, 5).cast("bigint") * 10000 + k.substr(F.lit(6), F.length(k)).cast("bigint")


def sample_key(idx) -> Column:
    """A2: ``"sample%05d" % idx`` (wider numbers keep all digits)."""
    return F.format_string("sample%05d", _col(idx))


def image_file_name(image_id) -> Column:
    """COCO file name: ``zfill(12) + '.jpg'`` of the numeric image id."""
    return F.concat(F.lpad(_col(image_id).cast("string"), 12, "0"), F.lit(".jpg"))

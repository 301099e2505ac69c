"""Secret scan with linking of credentials that come in several parts.

Base kinds stand for themselves: ``assign`` (a keyword with a value), ``access``
(access identifiers with a fixed prefix) and ``hex`` (long hexadecimal runs).
Three weak kinds are only candidates: ``identifier`` (upper-case key ids and
assigned user or client ids), ``secret`` (long mixed tokens) and ``endpoint``
(URLs with a scheme, IPv4 addresses).  A weak candidate is reported only if a
complementary part lies within the scope, ``scope`` code points on either side:

    identifier  needs a secret part: assign, hex or secret
    secret      needs an identifier part or an endpoint: access, identifier, endpoint
    endpoint    needs a secret part: assign, hex or secret

This is an interval join of candidates and complements, which must not overlap: a token in the path of
an URL is no second part beside it.  Parts of an URL are candidates of their own: its user (an
identifier), its password and the values of its query (secrets), and the rest up to the query.  A scope
never leaves its document, so the join runs inside the row by binary search over the sorted parts,
in n log n for n parts, and nothing is shuffled.

All candidates are linked first.  Overlaps are resolved among the linked ones only, so that no part
hides another: base spans of different kinds may overlap and all stay; then secrets, identifiers and
endpoints, in this order and from the left, report what no earlier one has covered, if at least
``LEAST_PIECE`` letters or digits of it are left.

Cases: a null or empty text has no spans.  Spans count code points, end exclusive.  Repeated rows
are scanned alike, null ids are passed through, other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ready

SCOPE = 200
BASE = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
PRIORITY = ("secret", "identifier", "endpoint")
LEAST_PIECE = 3
ORDER = {kind: i for i, kind in enumerate(BASE + WEAK)}
NEEDS = {"identifier": ("assign", "hex", "secret"), "secret": ("access", "identifier", "endpoint"),
         "endpoint": ("assign", "hex", "secret")}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,64}(?![A-Za-z0-9])")
_USER = re.compile(r"""(?:user(?:name)?|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
                   re.IGNORECASE | re.ASCII)
# A token may start right after "=", as in NAME=VALUE; at its end "=" is padding.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
# scheme, user, password, and the rest up to the query
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://(?:([^\s"'<>/?#@:]*)(?::([^\s"'<>/?#@]*))?@)?([^\s"'<>?#]+)""")
_QUERY = re.compile(r"""[?&][A-Za-z0-9_.~-]+=([A-Za-z0-9+/_.~%=-]{20,})""")
_IPV4 = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\d.])")


def _mixed(token: str) -> bool:
    return (any(c.isdigit() for c in token) and any("a" <= c <= "z" for c in token)
            and any("A" <= c <= "Z" for c in token))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _candidates(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "identifier") for rx in (_KEY_ID, _USER) for m in rx.finditer(text)]
    out += [(m.start(), m.end(), "secret") for m in _TOKEN.finditer(text) if _mixed(m[0])]
    if "://" in text:
        for m in _URL.finditer(text):
            if m[1]:
                out.append((*m.span(1), "identifier"))
            if m[2]:
                out.append((*m.span(2), "secret"))
            out.append((m.start() if m[1] is None else m.start(3), m.end(), "endpoint"))
        out += [(*m.span(1), "secret") for m in _QUERY.finditer(text) if _mixed(m[1])]
    return out + [(m.start(), m.end(), "endpoint") for m in _IPV4.finditer(text)]


def _near(spans, others, scope):
    """For each span, whether one of ``others`` lies beside it, at most ``scope`` away."""
    if not others:
        return [False] * len(spans)
    starts, ends = (np.sort([x[i] for x in others]) for i in (0, 1))
    s, e = (np.array([x[i] for x in spans]) for i in (0, 1))
    behind = np.searchsorted(starts, e + scope, "right") > np.searchsorted(starts, e, "left")
    before = np.searchsorted(ends, s, "right") > np.searchsorted(ends, s - scope, "left")
    return list(behind | before)


def _merged(spans) -> list[list[int]]:
    """The union of spans, as ascending disjoint intervals."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _uncovered(spans, covered):
    """What ``covered`` (disjoint, ascending) and spans further left leave of each span, in order."""
    ends, done = [e for _, e in covered], 0
    for s, e in sorted(spans):
        s, done = max(s, done), max(done, e)
        i = bisect_right(ends, s)
        while s < e:
            upto = min(e, covered[i][0]) if i < len(covered) else e
            if upto > s:
                yield s, upto
            s = covered[i][1] if i < len(covered) else e
            i += 1


def linked_spans(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """All spans of one text, by start and kind."""
    if not text:
        return []
    out = base_spans(text)
    weak = sorted(set(_candidates(text)))
    parts = out + weak
    covered = [(s, e) for s, e, _ in out]
    for kind in PRIORITY:
        mine = [c for c in weak if c[2] == kind]
        if mine:
            ok = _near(mine, [p for p in parts if p[2] in NEEDS[kind]], scope)
            linked = [c[:2] for c, near in zip(mine, ok) if near]
            pieces = [(s, e) for s, e in _uncovered(linked, _merged(covered))
                      if sum(map(str.isalnum, text[s:e])) >= LEAST_PIECE]
            out += [(s, e, kind) for s, e in pieces]
            covered += linked
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def _scanned(batches, scope):
    for rb in batches:
        flat, ends = [], [0]
        for text in rb.column(1).to_pylist():
            flat += linked_spans(text, scope)
            ends.append(len(flat))
        struct = pa.StructArray.from_arrays(
            [pa.array([x[2] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int64()),
             pa.array([x[1] for x in flat], pa.int64())], ["kind", "start", "end"])
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)],
                                         ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` per row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = ready(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _scanned(it, scope),
                          f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str | None, scope: int = SCOPE) -> str | None:
    """The text with each run of overlapping spans replaced by ``[kind]``."""
    spans = linked_spans(text, scope)
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, scope: int = SCOPE) -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced; ``length_col``, if
    given, is set to the code points of the new text."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, scope), na_action="ignore")

    out = ready(docs).withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast("bigint")) if length_col else out

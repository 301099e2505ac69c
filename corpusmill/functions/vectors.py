"""Vector math as native array expressions (no UDF, stays in codegen).

Spark 4.1 has no built-in dot product on arrays, so the expressions here use
``zip_with`` / ``aggregate`` / ``transform``.  Everything is computed in
DOUBLE, whatever the stored element type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks are taken on scores rounded to this many decimals, so that a different
# summation order (numpy block matmul vs. array aggregate) cannot flip a rank.
RANK_DECIMALS = 9
# Scores and probabilities are rounded to this many decimals on output only.
OUT_DECIMALS = 6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product of two arrays (zip stops at the shorter one is not used:
    ``zip_with`` pads with null, so mismatched lengths give null)."""
    prod = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(as_double_array(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2_norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def l2_normalize(v) -> Column:
    """Divide by the row norm; a zero vector gives null (flag it with
    ``is_zero_vector``) instead of NaN or a division error."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(as_double_array(v), lambda x: x / n))


def is_zero_vector(v) -> Column:
    return sq_norm(v) == 0


def cosine(a, b) -> Column:
    """Cosine of two arrays; null when either has norm 0."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)


def scale(v, s) -> Column:
    return F.transform(as_double_array(v), lambda x: x * s)


def rank_score(c) -> Column:
    return F.round(_col(c), RANK_DECIMALS)


def out(c) -> Column:
    return F.round(_col(c), OUT_DECIMALS)

"""Seeded, repeatable pseudo-random numbers as native expressions.

The reference draws captions and shuffles with unseeded generators; ours are
pure functions of ``(key, seed, epoch)`` so reruns and recomputed tasks
(after an executor loss) give the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_u32(*parts) -> Column:
    """Unsigned 32-bit number from the first 8 hex digits of
    ``md5(concat_ws('|', parts))``; DuckDB computes the same value."""
    s = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def draw_index(n, key, seed, epoch) -> Column:
    """0-based index in ``[0, n)`` for one (key, seed, epoch): a 32-bit
    hash modulo n (uniform up to a bias below n / 2^32)."""
    return F.pmod(md5_u32(key, F.lit(seed), F.lit(epoch)), _col(n))


def shuffle_hash(key, seed, epoch) -> Column:
    """64-bit sort key of the seeded shuffle."""
    return F.xxhash64(_col(key), F.lit(seed), F.lit(epoch))

"""A keyed permutation of sample numbers in place of a sort.

For samples numbered 0 to n - 1 (shards give every sample its number) ``places`` computes where each one stands in the
shuffled order of an epoch, from its number alone, and ``numbers_at`` which sample stands at a place.  So a new
epoch needs no sort and no shuffle, and one batch of any epoch is read without the others.

A number is written as ``l + a r`` with ``a`` the root of n, rounded up.  ``ROUNDS`` Feistel rounds in turn
add a keyed hash of one half to the other, modulo its range; each can be undone, so they permute the
numbers below ``a b``, where ``b`` is n / a rounded up.  Less than ``a`` of these are not below n: who lands there takes
the rounds again until below n (cycle walking), which keeps the permutation exact for every n.

Cases: a null number has no place; a number outside of 0 to n - 1 is an error; one sample stays where it is.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.indexing import chunk

ROUNDS = 8
# A prime and two multipliers of the round hash; halves stay below the prime.
PRIME = 2_147_483_647
MULTIPLIERS = (48_271, 69_621)
MAX_SAMPLES = 1 << 60


def _keys(seed: int, epoch: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}|{epoch}|{i}".encode()).hexdigest()[:8], 16) % PRIME for i in range(ROUNDS)]


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    z = (half * MULTIPLIERS[0] + key) % PRIME
    return (z ^ (z >> 15)) * MULTIPLIERS[1] % PRIME


def _sides(n: int) -> tuple[int, int]:
    if not 0 < n <= MAX_SAMPLES:
        raise ValueError(f"the number of samples must be between 1 and {MAX_SAMPLES}")
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def permuted(x: np.ndarray, n: int, seed: int, epoch: int, back: bool = False) -> np.ndarray:
    """The places of the numbers ``x``; with ``back``, the numbers at the places ``x``."""
    out = np.asarray(x, np.int64).copy()
    if not len(out):
        return out
    a, b = _sides(n)
    if not 0 <= out.min() <= out.max() < n:
        raise ValueError(f"a number outside of 0 to {n - 1}")
    rounds = list(enumerate(_keys(seed, epoch)))
    sign = -1 if back else 1
    todo = np.arange(len(out))
    while len(todo):
        l, r = out[todo] % a, out[todo] // a
        for i, key in rounds[::sign]:
            if i % 2:
                r = (r + sign * _mixed(l, key)) % b
            else:
                l = (l + sign * _mixed(r, key)) % a
        out[todo] = l + a * r
        todo = todo[out[todo] >= n]
    return out


def _column(col, n: int, seed: int, epoch: int, back: bool) -> Column:
    @F.arrow_udf("bigint")
    def fn(x: pa.Array) -> pa.Array:
        known = x.is_valid()
        out = np.zeros(len(x), np.int64)
        at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
        out[at] = permuted(x.drop_null().to_numpy(), n, seed, epoch, back)
        return pa.array(out, pa.int64(), mask=~known.to_numpy(zero_copy_only=False))
    return fn(F.col(col).cast("bigint") if isinstance(col, str) else col.cast("bigint"))


def places(idx, n: int, seed: int = 0, epoch: int = 0) -> Column:
    """The place of each sample number in the epoch's order."""
    return _column(idx, n, seed, epoch, False)


def numbers_at(place, n: int, seed: int = 0, epoch: int = 0) -> Column:
    """The sample number at each place of the epoch's order."""
    return _column(place, n, seed, epoch, True)


def epoch_batches(samples: DataFrame, n: int, batch_size: int, seed: int = 0, epoch: int = 0, idx: str = "idx") -> DataFrame:
    """``samples`` (numbered 0 to n - 1 by ``idx``) with ``place``, ``batch_id`` and ``slot`` of an epoch; nothing is
    shuffled.  The last batch may be partial."""
    return chunk(samples.withColumn("place", places(idx, n, seed, epoch)), "place", batch_size, "batch_id", "slot")


def read_batch(samples: DataFrame, n: int, batch_size: int, batch: int, seed: int = 0, epoch: int = 0, idx: str = "idx") -> DataFrame:
    """One batch in order of its slots.  Its sample numbers are computed first and filter ``samples``, so a scan
    with statistics on ``idx`` skips the rest.  A batch behind the last one is empty."""
    first = batch * batch_size
    if batch_size < 1 or batch < 0:
        raise ValueError("batch_size must be >= 1 and batch >= 0")
    wanted = permuted(np.arange(first, max(first, min(n, first + batch_size))), n, seed, epoch, back=True)
    rows = samples.filter(F.col(idx).isin([int(i) for i in wanted]))
    return epoch_batches(rows, n, batch_size, seed, epoch, idx).orderBy("slot")

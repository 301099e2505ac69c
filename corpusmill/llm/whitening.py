"""Embedding whitening with a weighted multiplicity covariance.

1. *Integers.*  Every entry ``c`` of a usable vector becomes ``x = floor(scale * c) + shift``, so
   equal vectors are exactly equal and sums are exact.
2. *Multiplicity.*  Identical x vectors are grouped, with map-side partial counts.  Each distinct
   vector counts with weight one, or with its number of rows (``weights="count"``).
3. *Covariance.*  One pass gives the weight ``n`` and the sum ``S`` per dimension, as integers.  The next
   takes ``n*x - S``, exact, over ``n``, and adds up ``Y' W Y`` by one matrix product per
   batch.  Centring comes first: x is far from 0, and uncentred products would lose its spread.
   Partial matrices are summed by Spark, row by row; only ``dim x dim`` numbers get to the driver.
4. *Whitening.*  Eigenvectors of the covariance project every distinct vector once; the
   results are joined back to the rows.  A vector that many rows share is joined by a
   broadcast of the few such vectors, so its rows never meet in one task.

The covariance of the whitened vectors is then counted in the same way and compared with the
identity.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; an empty
vector is kept and has no component.  Repeated rows each get their result; ids, null ones too, are
passed through.  Components without variance (eigenvalue at most ``FLAT`` of the largest) have null
``whitened`` entries and are left out of ``identity_error``, which is null if there are
no others; ``explained`` is 0 if nothing varies.  A deviation beyond the range of bigint is null.
Vectors of different lengths, and entries beyond 2^52 after scaling, are errors.  An empty table gives
no rows.  Other columns are not read.  The driver holds dim x dim doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, ready
from corpusmill.llm.joins import join_back

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: An eigenvalue of at most this share of the largest is rounding.
FLAT = 1e-12
_MOST = 2 ** 52
_LONG = 2 ** 63 - 1


def usable(vector):
    """Whether a vector column is neither null nor holds null or non-finite entries."""
    inf = float("inf")
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column as a 2-d array; its lists have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    dim = len(flat) // n if n else 0
    if n and (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError("vectors have different lengths")
    return flat.reshape(n, dim)


def _sums(cells: DataFrame):
    """(n, S, rows): the summed weight and per dimension the weighted sum, exact, and the number of rows."""
    def partial(batches):
        n, s, rows = 0, None, 0
        for rb in batches:
            x, w = matrix(rb.column("x")), rb.column("weight").to_numpy()
            if x.size and max(-int(x.min()), int(x.max())) > _MOST:
                raise ValueError("an entry is beyond 2^52")
            if len(w):
                # halves of 26 bits: sums of a batch stay within a long
                hi, lo = x >> 26, x & (2 ** 26 - 1)
                add = [int(a) * 2 ** 26 + int(b) for a, b in zip(w @ hi, w @ lo)]
                if s is not None and len(s) != len(add):
                    raise ValueError("vectors have different lengths")
                s = add if s is None else [a + b for a, b in zip(s, add)]
                n, rows = n + int(w.sum()), rows + int(rb.column("n_rows").to_numpy().sum())
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int32()), pa.array([str(n)]), pa.array([rows], pa.int64()),
                                              pa.array([[str(v) for v in s]], pa.list_(pa.string()))], ["dim", "n", "rows", "s"])

    parts = cells.mapInArrow(partial, "dim int, n string, rows bigint, s array<string>")
    big = "decimal(38,0)"
    total = parts.groupBy("dim").agg(F.sum(F.col("n").cast(big)).alias("n"), F.sum("rows").alias("rows")).collect()
    if len(total) > 1:
        raise ValueError("vectors have different lengths")
    if not total:
        return 0, [], 0
    per = parts.select(F.posexplode("s")).groupBy("pos").agg(F.sum(F.col("col").cast(big)).alias("s")).collect()
    return int(total[0].n), [int(r.s) for r in sorted(per)], total[0].rows


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n*x - S``, exact: as longs where they fit, else as Python integers."""
    reach = max(-int(x.min()), int(x.max())) if x.size else 0
    if n * reach + max(map(abs, s), default=0) <= _LONG:
        return x * np.int64(n) - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def _gram(cells: DataFrame, rows_of, size: int) -> np.ndarray:
    """``sum of weight * y y'`` over all cells, where ``rows_of(batch)`` gives the y of a batch."""
    def partial(batches):
        total = np.zeros((size, size))
        for rb in batches:
            y = rows_of(rb)
            total += (y * rb.column("weight").to_numpy()[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["i", "v"])

    parts = cells.mapInArrow(partial, "i int, v array<double>")
    summed = (parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
              .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("v"))  # one row of the matrix
              .select("i", "v.v").toArrow())
    out = np.zeros((size, size))
    for i, v in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist()):
        out[i] = v
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           weights: str = "one", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row: ``vec_id``, ``n`` (summed weight), ``deviation`` (sum of ``(n*x - S)^2``), ``whitened``
    array<double> by falling eigenvalue, ``explained`` array<double> and ``identity_error``."""
    if weights not in ("one", "count"):
        raise ValueError("weights: one or count")
    vector = F.col(vector_col)
    rows = (ready(df).filter(usable(vector))
            .select(F.col(id_col).alias("vec_id"),
                    F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("bigint")).alias("x")))
    weight = F.lit(1).cast("bigint") if weights == "one" else F.col("n_rows")
    cells = cut(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("weight", weight))
    n, s, n_rows = _sums(cells)
    dim = len(s)
    k = min(components, dim)

    def offset(rb):
        return (_centred(matrix(rb.column("x")), n, s) / n).astype(np.float64)

    v = _gram(cells, offset, dim) / max(n, 1)
    e, q = np.linalg.eigh((v + v.T) / 2)
    e, q = np.maximum(e[::-1][:k], 0), q[:, ::-1][:, :k]
    trace = float(np.trace(v))
    live = e > FLAT * max(trace, 0)
    project = q[:, live] / np.sqrt(e[live])
    explained = [float(x) / trace if trace > 0 else 0.0 for x in e]

    def whitened(rb):
        y = offset(rb) @ project
        return np.hstack([y, np.ones((len(y), 1))])  # the last row of the products has the sums

    def results(batches):
        for rb in batches:
            x = matrix(rb.column("x"))
            c = _centred(x, n, s)
            if c.dtype == object or dim * max(-int(c.min(initial=0)), int(c.max(initial=0))) ** 2 > _LONG:
                c = c.astype(object)
            dev = [d if d <= _LONG else None for d in (c * c).sum(axis=1).tolist()]
            w = np.full((len(x), k), np.nan)
            w[:, live] = (c / n).astype(np.float64) @ project
            yield pa.RecordBatch.from_arrays(
                [rb.column("x"), rb.column("n_rows"), pa.array(dev, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))],
                ["x", "n_rows", "deviation", "whitened"])

    if live.any():
        white = _gram(cells, whitened, int(live.sum()) + 1) / n
        mean = white[-1, :-1]
        error = float(np.abs(white[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    else:
        error = None
    found = join_back(rows, cells, ["x"], "n_rows", n_rows, lambda part: part.mapInArrow(
        results, "x array<bigint>, n_rows bigint, deviation bigint, whitened array<double>"))
    return found.select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation",
                        F.transform("whitened", lambda w: F.nanvl(w, F.lit(None).cast("double"))).alias("whitened"),
                        F.lit(explained).cast("array<double>").alias("explained"),
                        F.lit(error).cast("double").alias("identity_error"))


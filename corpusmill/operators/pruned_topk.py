"""Exact top-k that skips block pairs which cannot reach a query's k-th score.

Candidates and queries are dealt to the nearest of some pivots (candidates with the smallest hash of
their id), and pivots with many vectors are split, so that a block holds about ``block_size`` vectors that
lie close together.  A candidate block is described by its mean ``c``, its radius ``r`` and its size; for any
query ``q`` and any candidate of the block the score is at most ``q.c + |q| r``.

1. Every query block meets the blocks whose means score best against its own mean, as many as hold k
   vectors.  That gives each query a k-th score which the final one cannot be below.
2. A query block meets another block only if, for some query of it, the bound reaches that k-th
   score.  All other block pairs are never multiplied.

The result is that of ``similarity.topk_scores`` for every k.  Pivots and block descriptions go to every
task; they are bounded by ``PIVOT_BYTES``, beyond which blocks become larger.  Vectors far from each other in all
directions are not pruned: then every pair is met, as without bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators import similarity as S
from corpusmill.session import reliable_checkpoint, ship_package

PIVOT_BYTES = 64 << 20
#: Room for the rounding of scores to RANK_DECIMALS.
_ROOM = 1e-8


def _stack(rows) -> np.ndarray:
    return np.stack([np.asarray(x["v"], dtype=np.float64) for x in rows])


def _dealt(df: DataFrame, id_col: str, vec: str, pivots: np.ndarray) -> DataFrame:
    """(id, v, pivot) of every row with a vector; pivot: the nearest one."""
    half = (pivots * pivots).sum(axis=1) / 2

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                pdf["pivot"] = (v @ pivots.T - half).argmax(axis=1).astype(np.int32)
                yield pdf

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), V.as_double_array(vec).alias("v")).filter("v is not null")
    return rows.mapInPandas(nearest, "id bigint, v array<double>, pivot int")


def _close_blocks(dealt: DataFrame, block_size: int) -> DataFrame:
    """(block, rows): vectors of one pivot, split by the hash of the id where it has more than a block."""
    parts = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("parts"))
    split = (dealt.join(F.broadcast(parts), "pivot")               # one row per pivot
             .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    null = F.lit(None)
    return (split.groupBy("pivot", "part")
            .agg(F.collect_list(F.struct("id", null.cast("bigint").alias("key"), null.cast("double").alias("x"), "v")).alias("rows"))
            .select(F.concat_ws("-", "pivot", "part").alias("block"), "rows"))


def _described(blocks: DataFrame) -> pd.DataFrame:
    """block, n, mean and radius of each block."""
    def describe(batches):
        for pdf in batches:
            out = []
            for b, rows in zip(pdf["block"], pdf["rows"]):
                v = _stack(rows)
                mean = v.mean(axis=0)
                out.append((b, len(v), mean, float(np.sqrt(((v - mean) ** 2).sum(axis=1)).max())))
            yield pd.DataFrame(out, columns=["block", "n", "mean", "radius"])
    return blocks.mapInPandas(describe, "block string, n long, mean array<double>, radius double").toPandas().sort_values(
        "block", ignore_index=True)


def topk_scores(queries: DataFrame, candidates: DataFrame, k: int, q_id: str = "query_id", c_id: str = "cand_id",
                vec: str = "vec", scale: float = 1.0, block_size: int = S.DEFAULT_BLOCK, counts: dict | None = None) -> DataFrame:
    """``(q_id, c_id, score, rank)`` as ``similarity.topk_scores``; ``scale`` must be positive.  ``counts``, if
    given, receives the number of block ``pairs`` and of those ``met`` (one more small job)."""
    if k < 1 or scale <= 0:
        raise ValueError("k must be >= 1 and scale positive")
    spark = queries.sparkSession
    ship_package(spark)
    size = candidates.filter(F.col(vec).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    if not size["n"]:
        return S.topk_scores(queries, candidates, k, q_id, c_id, vec, scale)
    n_pivots = max(1, min(math.ceil(size["n"] / block_size), PIVOT_BYTES // (8 * max(1, size["d"]))))
    block_size = max(block_size, math.ceil(size["n"] / n_pivots))
    first = (candidates.filter(F.col(vec).isNotNull()).select(F.xxhash64(c_id).alias("h"), F.col(c_id).alias("i"), V.as_double_array(vec).alias("v"))
             .orderBy("h", "i").limit(n_pivots).collect())          # the pivots: n_pivots vectors
    pivots = np.array([r.v for r in first])
    cb = reliable_checkpoint(_close_blocks(_dealt(candidates, c_id, vec, pivots), block_size))
    qb = reliable_checkpoint(_close_blocks(_dealt(queries, q_id, vec, pivots), block_size))
    about = _described(cb)
    names, n = about["block"].to_numpy(), about["n"].to_numpy()
    means, radius = np.stack(about["mean"].to_numpy()), about["radius"].to_numpy()
    known = spark.sparkContext.broadcast((names, n, means, radius))

    def nearest_first(rows):
        """Places of the blocks with the best means against the query block's, until they hold k vectors."""
        _, n, means, _ = known.value
        order = np.argsort(-(_stack(rows).mean(axis=0) @ means.T), kind="stable")
        return order[:np.searchsorted(np.cumsum(n[order]), min(k, n.sum())) + 1]

    def start(batches):
        for pdf in batches:
            for b, rows in zip(pdf["block"], pdf["rows"]):
                yield pd.DataFrame({"q_block": b, "c_block": known.value[0][nearest_first(rows)]})

    def further(batches):
        names, _, means, radius = known.value
        for pdf in batches:
            for b, rows, least in zip(pdf["block"], pdf["rows"], pdf["least"]):
                v, tau = _stack(rows), dict((x["id"], x["tau"]) for x in least)
                bound = scale * (v @ means.T + np.sqrt((v * v).sum(axis=1))[:, None] * radius)
                t = np.array([tau[x["id"]] for x in rows])
                reach = (bound >= t[:, None] - _ROOM - 1e-12 * np.abs(bound)).any(axis=0)
                reach[nearest_first(rows)] = False
                yield pd.DataFrame({"q_block": b, "c_block": names[reach]})

    def scored(plan):
        pairs = (plan.join(qb.select(F.col("block").alias("q_block"), F.col("rows").alias("q_rows")), "q_block")
                 .join(cb.select(F.col("block").alias("c_block"), F.col("rows").alias("c_rows")), "c_block").select("q_rows", "c_rows"))
        return pairs.mapInArrow(S._block_topk_fn(k, float(scale)),
                                "q long, c long, score double, rank long, q_key long, c_key long").select("q", "c", "score")

    pair = "q_block string, c_block string"
    plan1 = reliable_checkpoint(qb.mapInPandas(start, pair))
    found1 = reliable_checkpoint(scored(plan1))
    best = Window.partitionBy("q").orderBy(F.desc(V.rank_score("score")), F.asc("c"))
    ranked = found1.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    # with fewer than k candidates in all there is no k-th score, and nothing more to meet
    tau = ranked.groupBy("q").agg(F.min("score").alias("tau"))
    where = qb.select("block", F.explode("rows.id").alias("q"))
    least = where.join(tau, "q").groupBy("block").agg(F.collect_list(F.struct(F.col("q").alias("id"), "tau")).alias("least"))
    plan2 = reliable_checkpoint(qb.join(least, "block").mapInPandas(further, pair))
    if counts is not None:
        counts.update(pairs=qb.count() * len(names), met=plan1.count() + plan2.count())
    both = found1.unionByName(scored(plan2))
    return (both.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)
            .select(F.col("q").alias(q_id), F.col("c").alias(c_id), "score", "rank"))

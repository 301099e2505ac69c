"""Normalisation, paired and one-to-many cosine, exact top-k scoring.

Scoring never builds the score matrix as rows.  ``topk_scores`` groups both
sides into blocks of vectors (about ``block_size`` per block), pairs every
query block with every candidate block through an equi-join on the candidate
block number, multiplies each block pair with numpy inside the task and emits
only the block-local top-k of each query.  A window (planned as
``WindowGroupLimit``) then merges the per-block lists.  Exact for any input
size; the only data-sized shuffles are the two block groupings and the final
merge of ``k * n_candidate_blocks`` rows per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import vectors as V
from corpusmill.session import ship_package

DEFAULT_BLOCK = 1024
# candidate blocks are broadcast only when count x dimension x 8 bytes (the
# measured size of all candidate vectors) stays under this bound
BROADCAST_CANDIDATE_BYTES = 64 << 20


# ---------------------------------------------------------------- D1 / D2 / D3

def l2_normalize(df: DataFrame, vec: str = "vec", out: str | None = None) -> DataFrame:
    """Replace ``vec`` by its unit vector; zero vectors become null and
    are flagged in ``<out>_is_zero``."""
    out = out or vec
    return (df.withColumn(out + "_is_zero", V.is_zero_vector(vec))
              .withColumn(out, V.l2_normalize(vec)))


def paired_cosine(left: DataFrame, right: DataFrame, on, left_vec: str = "vec",
                  right_vec: str = "vec", out: str = "sim") -> DataFrame:
    """Cosine of the i-th left vector with the i-th right vector (the
    diagonal only), matched by the key ``on``; never the square matrix."""
    l = left.withColumnRenamed(left_vec, "__lv")
    r = right.withColumnRenamed(right_vec, "__rv")
    return (l.join(r, on=on, how="inner")
             .withColumn(out, V.cosine("__lv", "__rv"))
             .drop("__lv", "__rv"))


def one_to_many_cosine(images: DataFrame, captions: DataFrame, image_key: str = "image_id",
                       image_vec: str = "vec", caption_vec: str = "vec",
                       out: str = "sim") -> DataFrame:
    """D3: every caption row (any number per image) against its image's
    vector; one row per caption, keyed like the caption table.  A caption
    whose image is missing keeps its row with a null similarity."""
    i = images.select(F.col(image_key), F.col(image_vec).alias("__iv"))
    c = captions.withColumnRenamed(caption_vec, "__cv")
    return (c.join(i, on=image_key, how="left")
             .withColumn(out, V.cosine("__cv", "__iv"))
             .drop("__cv", "__iv"))


# ---------------------------------------------------------------- E4 top-k

def _blocks(df: DataFrame, id_col: str, vec: str, n_blocks: int, name: str,
            group_cols=(), key_col: str | None = None, value_col: str | None = None) -> DataFrame:
    """One row per (group, block): (group..., block, rows array<struct<id,
    key, x, v>>).  Block = hash of the id, so blocks are balanced whatever the
    id layout.  ``key`` is an optional integral match key carried along, ``x`` an
    optional double."""
    g = [F.col(c) for c in group_cols]
    key = F.col(key_col).cast("bigint") if key_col else F.lit(None).cast("bigint")
    value = F.col(value_col).cast("double") if value_col else F.lit(None).cast("double")
    return (df.select(*g, F.col(id_col).cast("bigint").alias("id"), key.alias("key"), value.alias("x"),
                      V.as_double_array(vec).alias("v"))
              .filter(F.col("v").isNotNull())   # a zero vector has no direction
              .withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
              .groupBy(*group_cols, name)
              .agg(F.collect_list(F.struct("id", "key", "x", "v")).alias(name + "_rows")))


def block_pairs(queries: DataFrame, candidates: DataFrame, q_id: str, c_id: str, vec: str = "vec",
                block_size: int = DEFAULT_BLOCK, n_candidates: int | None = None, n_queries: int | None = None,
                group_cols=(), q_key: str | None = None, c_key: str | None = None, q_value: str | None = None,
                broadcast_bytes: int = BROADCAST_CANDIDATE_BYTES):
    """(pairs, number of candidate blocks): every query block with every candidate block of its group, as
    ``(group..., q_rows, c_rows)``; pairs is None when a side is empty."""
    group_cols = list(group_cols)
    # one small job measures the candidate side: rows and longest vector
    stats = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    n_c = n_candidates if n_candidates is not None else stats["n"]
    dim = stats["d"] or 0
    n_q = n_queries if n_queries is not None else queries.count()
    if n_c == 0 or n_q == 0:
        return None, 0
    # block counts from the overall sizes: a group smaller than a block just
    # gives fewer, smaller blocks
    n_cb = max(1, math.ceil(n_c / block_size))
    n_qb = max(1, math.ceil(n_q / block_size))
    cb = _blocks(candidates, c_id, vec, n_cb, "cb", group_cols, c_key).withColumnRenamed("cb_rows", "c_rows")
    qb = (_blocks(queries, q_id, vec, n_qb, "qb", group_cols, q_key, q_value).withColumnRenamed("qb_rows", "q_rows")
          .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_cb - 1)))))
    if stats["n"] * max(dim, 1) * 8 <= broadcast_bytes:
        # proven small: every query block meets the candidate blocks where it
        # lies, the replicated query side is never shuffled
        pairs = qb.join(F.broadcast(cb), on=group_cols + ["cb"], how="inner")
    else:
        n_slab = math.isqrt(n_qb - 1) + 1
        qb = qb.withColumn("slab", F.col("qb") % n_slab)
        cb = cb.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(n_slab - 1))))
        pairs = qb.join(cb, on=group_cols + ["slab", "cb"], how="inner")
    return pairs.select(*group_cols, "q_rows", "c_rows"), n_cb


def block_of(batch: pa.RecordBatch, name: str, r: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Block ``r`` of a batch of ``block_pairs``: its ids, keys, ``x`` values (nan for null) and vectors as a
    matrix.  The arrays are views of the batch wherever they have no nulls: no vector becomes a Python object."""
    rows = batch.column(name)[r].values
    vecs = rows.field("v")
    sizes = np.unique(vecs.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths in a block: {sizes.tolist()}")
    numbers = lambda a: a.to_numpy(zero_copy_only=False)
    return (numbers(rows.field("id")), rows.field("key"), numbers(rows.field("x")).astype(np.float64),
            numbers(vecs.flatten()).astype(np.float64, copy=False).reshape(len(rows), -1))


def repeated(batch: pa.RecordBatch, names, r: int, n: int) -> dict:
    """Row ``r`` of the columns ``names``, ``n`` times."""
    return {c: batch.column(c).take(pa.array(np.full(n, r))) for c in names}


def _block_topk_fn(k: int, scale: float, group_cols=()):
    group_cols = list(group_cols)

    def fn(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                qids, qkeys, _, Q = block_of(batch, "q_rows", r)
                cids, ckeys, _, C = block_of(batch, "c_rows", r)
                if len(qids) == 0 or len(cids) == 0:
                    continue
                order = np.argsort(cids, kind="stable")
                S = (Q @ C[order].T) * scale
                R = np.round(S, V.RANK_DECIMALS)
                kk = min(k, len(cids))
                # stable sort on -score keeps ascending candidate id among ties
                top = np.argsort(-R, axis=1, kind="stable")[:, :kk]
                rows = np.repeat(np.arange(len(qids)), kk)
                cols = top.reshape(-1)
                part = repeated(batch, group_cols, r, len(rows))
                part.update(q=pa.array(qids[rows]), c=pa.array(cids[order[cols]]), score=pa.array(S[rows, cols]),
                            rank=pa.array(np.tile(np.arange(1, kk + 1, dtype=np.int64), len(qids))),
                            q_key=qkeys.take(pa.array(rows)), c_key=ckeys.take(pa.array(order[cols])))
                # one pair of blocks at a time leaves the task
                yield pa.RecordBatch.from_pydict(part)
    return fn


def topk_scores(queries: DataFrame, candidates: DataFrame, k: int,
                q_id: str = "query_id", c_id: str = "cand_id", vec: str = "vec",
                scale: float = 1.0, block_size: int = DEFAULT_BLOCK,
                n_candidates: int | None = None, n_queries: int | None = None,
                group_cols=(), q_key: str | None = None, c_key: str | None = None,
                broadcast_bytes: int = BROADCAST_CANDIDATE_BYTES) -> DataFrame:
    """E4 + E6: for each query the ``k`` candidates with the highest scaled dot
    product, ties broken by the smaller candidate id.

    With ``group_cols`` a query only meets candidates of its own group (one
    job for a whole sweep of datasets / languages / prompt sets).
    Returns ``(group..., q_id, c_id, score, rank)`` with ``rank`` 1..k (fewer
    when there are fewer candidates).  Ids must be integral.  With ``q_key``
    / ``c_key`` (integral match keys) the output also has ``is_pos`` =
    keys equal, carried through the blocks so no join is needed afterwards.
    Candidate blocks of at most ``broadcast_bytes`` in all are broadcast.  Beyond
    that both sides are dealt over a grid: the key is (query slab, candidate
    block), so a task reads one candidate block and the query blocks of one slab.
    Rows with a null vector (normalised zero vectors) are no candidates and
    have no candidates: they give no rows, and count as misses downstream.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    ship_package(queries.sparkSession)
    group_cols = list(group_cols)
    pairs, n_cb = block_pairs(queries, candidates, q_id, c_id, vec, block_size, n_candidates, n_queries,
                              group_cols, q_key, c_key, broadcast_bytes=broadcast_bytes)
    out_schema = T.StructType(
        [queries.schema[c] for c in group_cols]
        + [T.StructField(q_id, T.LongType()), T.StructField(c_id, T.LongType()),
           T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])
    spark = queries.sparkSession
    if pairs is None:
        if q_key and c_key:
            out_schema = out_schema.add("is_pos", T.BooleanType())
        return spark.createDataFrame([], out_schema)
    gschema = "".join(f"{queries.schema[c].name} {queries.schema[c].dataType.simpleString()}, "
                      for c in group_cols)
    local = pairs.mapInArrow(_block_topk_fn(k, float(scale), group_cols),
                             schema=gschema + "q long, c long, score double, rank long, q_key long, c_key long")
    g = [F.col(c) for c in group_cols]
    extra = [(F.col("q_key") == F.col("c_key")).alias("is_pos")] if (q_key and c_key) else []
    if n_cb == 1:
        # one candidate block: the block-local ranks are already global (no merge shuffle)
        return local.select(*g, F.col("q").alias(q_id), F.col("c").alias(c_id), "score", "rank", *extra)
    w = Window.partitionBy(*g, "q").orderBy(F.desc(V.rank_score("score")), F.asc("c"))
    return (local.drop("rank").withColumn("rank", F.row_number().over(w).cast("bigint"))
                 .filter(F.col("rank") <= k)
                 .select(*g, F.col("q").alias(q_id), F.col("c").alias(c_id), "score", "rank", *extra))


def all_scores(queries: DataFrame, candidates: DataFrame, q_id: str = "query_id",
               c_id: str = "cand_id", vec: str = "vec", scale: float = 1.0,
               n_candidates: int | None = None, block_size: int = DEFAULT_BLOCK,
               group_cols=(), q_key: str | None = None, c_key: str | None = None) -> DataFrame:
    """E4 long score table ``(q_id, c_id, score, rank)`` with every candidate
    of every query: the full ranking that softmax (E5) and per-class metrics
    need.  Computed blockwise like ``topk_scores`` with k = all candidates."""
    n_c = n_candidates if n_candidates is not None else candidates.count()
    return topk_scores(queries, candidates, max(1, n_c), q_id=q_id, c_id=c_id, vec=vec,
                       scale=scale, block_size=block_size, n_candidates=n_c, group_cols=group_cols,
                       q_key=q_key, c_key=c_key)


def scored_samples(images: DataFrame, captions: DataFrame, n_original: int,
                   image_key: str = "image_id") -> DataFrame:
    """D3 array form: per image the extended caption list (originals then
    generated, by ``pos``), the generated ones alone, and the aligned
    similarity list.  ``captions``: (image_id, pos, text, vec).  An image
    without captions has empty lists; captions of an image that is not in
    ``images`` keep their row, with null similarities.
    Returns (image_id, captions, generated, similarities)."""
    long = one_to_many_cosine(images, captions, image_key=image_key)
    st = F.struct(F.col("pos"), F.col("text"), F.col("sim"))
    g = (images.select(image_key).distinct()
         .join(long.groupBy(image_key).agg(F.array_sort(F.collect_list(st)).alias("__l")), image_key, "full")
         .withColumn("__l", F.coalesce("__l", F.array())))
    return g.select(image_key,
                    F.transform("__l", lambda x: x["text"]).alias("captions"),
                    F.transform(F.filter("__l", lambda x: x["pos"] >= n_original),
                                lambda x: x["text"]).alias("generated"),
                    F.transform("__l", lambda x: x["sim"]).alias("similarities"))

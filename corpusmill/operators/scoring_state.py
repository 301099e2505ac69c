"""Classification from a mergeable state per image.

An argmax, a hit among the k best or a cross-entropy needs a few numbers per image, not its score
against every class.  Each block of images meets each block of classes as in ``similarity``; what
leaves Python is one row per image and class block:

    best, best_score   the class with the highest rounded score (smaller class on ties)
    m, z               the largest logit of the block, and sum(exp(logit - m))
    above              classes that rank ahead of the image's true class

States of different blocks merge: the best of the best, the sum of ``z`` rescaled to the common
maximum, the sum of ``above``.  With one class block nothing is left to merge or shuffle.  To count
``above`` in blocks that do not hold the true class, its logit travels with the image; it comes from a
join of the images with the prototypes on the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators import similarity as S
from corpusmill.operators.partitioning import broadcast_if_small
from corpusmill.session import ship_package


def _block_state(queries, candidates, scale: float) -> dict:
    """State columns of the images of one block against one block of classes (both from ``similarity.block_of``)."""
    (qids, keys, true, Q), (cids, _, _, C) = queries, candidates
    order = np.argsort(cids, kind="stable")
    cids = cids[order]
    logits = (Q @ C[order].T) * scale
    rounded = np.round(logits, V.RANK_DECIMALS)
    best = rounded.argmax(axis=1)                     # the first of equals: the smallest class
    m = logits.max(axis=1)
    target = keys.to_numpy(zero_copy_only=False).astype(np.float64)
    own = np.round(true, V.RANK_DECIMALS)[:, None]
    ahead = (rounded > own) | ((rounded == own) & (cids < target[:, None]))
    above = (ahead & (cids != target[:, None])).sum(axis=1)
    rows = np.arange(len(qids))
    return {"q": pa.array(qids), "target": keys, "true_logit": pa.array(true), "best": pa.array(cids[best]),
            "best_score": pa.array(rounded[rows, best]), "m": pa.array(m),
            "z": pa.array(np.exp(logits - m[:, None]).sum(axis=1)), "above": pa.array(above.astype(np.int64))}


def _states_fn(scale: float, group_cols):
    def fn(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                queries, candidates = S.block_of(batch, "q_rows", r), S.block_of(batch, "c_rows", r)
                if len(queries[0]) and len(candidates[0]):
                    yield pa.RecordBatch.from_pydict({**S.repeated(batch, group_cols, r, len(queries[0])),
                                                      **_block_state(queries, candidates, scale)})
    return fn


def block_states(images: DataFrame, prototypes: DataFrame, scale: float = 100.0, image_id: str = "image_id",
                 class_idx: str = "class_idx", vec: str = "vec", target: str = "target", group_cols=(),
                 normalize_images: bool = True, block_size: int = S.DEFAULT_BLOCK,
                 broadcast_bytes: int = S.BROADCAST_CANDIDATE_BYTES):
    """(states, number of class blocks): one row per image and class block, see the module text."""
    ship_package(images.sparkSession)
    group_cols = list(group_cols)
    im = images.select(*group_cols, image_id, target, vec)
    if normalize_images:
        im = S.l2_normalize(im, vec).select(*group_cols, image_id, target, vec)
    pr = prototypes.select(*group_cols, class_idx, vec)
    truth = broadcast_if_small(pr.select(*group_cols, F.col(class_idx).alias(target), F.col(vec).alias("__tv")))
    im = im.join(truth, [*group_cols, target], "left").withColumn("__true", V.dot(vec, "__tv") * F.lit(float(scale)))
    pairs, n_cb = S.block_pairs(im.drop("__tv"), pr, image_id, class_idx, vec, block_size, group_cols=group_cols,
                                q_key=target, q_value="__true", broadcast_bytes=broadcast_bytes)
    g = "".join(f"{c} {images.schema[c].dataType.simpleString()}, " for c in group_cols)
    schema = g + ("q long, target long, true_logit double, best long, best_score double, m double, z double, above long")
    if pairs is None:
        return images.sparkSession.createDataFrame([], schema).withColumnRenamed("q", image_id), 1
    return pairs.mapInArrow(_states_fn(float(scale), group_cols), schema).withColumnRenamed("q", image_id), n_cb


def merge_states(states: DataFrame, keys) -> DataFrame:
    """One state per image from those of its class blocks: a single shuffle on the image."""
    top = F.max("m").over(Window.partitionBy(*keys))
    return (states.withColumn("__top", top).groupBy(*keys)
            .agg(F.max("target").alias("target"), F.max("true_logit").alias("true_logit"),
                 F.max_by("best", F.struct("best_score", -F.col("best"))).alias("best"),
                 F.max("best_score").alias("best_score"), F.max("m").alias("m"),
                 F.sum(F.col("z") * F.exp(F.col("m") - F.col("__top"))).alias("z"), F.sum("above").alias("above")))


def class_states(images: DataFrame, prototypes: DataFrame, image_id: str = "image_id", group_cols=(), **options) -> DataFrame:
    """One row per image with a direction: (group..., image_id, target, true_logit, best, best_score, m, z,
    above); ``true_logit`` is null when the true class has no prototype, and ``above`` then counts for nothing.
    Images without a vector have no row, as have those of a group without classes."""
    states, n_cb = block_states(images, prototypes, image_id=image_id, group_cols=group_cols, **options)
    known = F.when(~F.isnan("true_logit"), F.col("true_logit"))
    out = states if n_cb == 1 else merge_states(states.withColumn("true_logit", known), [*group_cols, image_id])
    return out.withColumn("true_logit", known)


def predictions(states: DataFrame, image_id: str = "image_id", group_cols=()) -> DataFrame:
    """E5: (group..., image_id, pred, confidence, target); the confidence is the largest softmax probability."""
    return states.select(*group_cols, image_id, F.col("best").alias("pred"), (1.0 / F.col("z")).alias("confidence"), "target")


def true_ranks(states: DataFrame, image_id: str = "image_id", group_cols=()) -> DataFrame:
    """(group..., image_id, rank, is_pos): the rank of each image's true class, in the form that
    ``zeroshot.topk_accuracy`` and ``zeroshot.subset_accuracy`` take."""
    return states.filter("true_logit is not null").select(
        *group_cols, image_id, (F.col("above") + 1).alias("rank"), F.lit(True).alias("is_pos"))


def classification_loss(states: DataFrame, targets: DataFrame, image_id: str = "image_id") -> DataFrame:
    """mean cross-entropy of the true class, and argmax accuracy, over the images of ``targets``.  An image
    without a score for its class has no loss and fails the job."""
    s = states.select(image_id, "true_logit", "m", "z", "best", F.col("target").alias("__t"))
    every = targets.select(image_id).join(s, image_id, "left")
    loss = F.when(F.col("true_logit").isNotNull(), F.col("m") + F.log("z") - F.col("true_logit")).otherwise(
        F.raise_error(F.concat(F.lit("no score for the class of image "), F.col(image_id).cast("string"))))
    hit = (F.col("best") == F.col("__t")).cast("double")
    return every.agg(F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy"))

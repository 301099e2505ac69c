"""F: evaluation metrics as aggregates.

Ranking metrics that need running counts (11-point mAP, ROC AUC) use exact
distributed prefix sums (``indexing.prefix_sum``), never a window without a
partition over data-sized input.  In-batch metrics work per batch (a group
bounded by the batch size) with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.indexing import prefix_sum
from corpusmill.operators.partitioning import broadcast_if_small
from corpusmill.session import ship_package

# Metric of each evaluation dataset (from the reference's
# dataset metadata files).
DATASET_METRIC = {
    "caltech-101": "mean-per-class",
    "cifar-10": "accuracy",
    "cifar-100": "accuracy",
    "country211": "accuracy",
    "dtd": "accuracy",
    "eurosat_clip": "accuracy",
    "fer-2013": "accuracy",
    "fgvc-aircraft-2013b-variants102": "mean-per-class",
    "oxford-flower-102": "mean-per-class",
    "food-101": "accuracy",
    "gtsrb": "accuracy",
    "hateful-memes": "roc_auc",
    "kitti-distance": "accuracy",
    "mnist": "accuracy",
    "oxford-iiit-pets": "mean-per-class",
    "patch-camelyon": "accuracy",
    "rendered-sst2": "accuracy",
    "resisc45_clip": "accuracy",
    "stanford-cars": "accuracy",
    "voc-2007-classification": "11point_mAP",
}
METRICS = ("accuracy", "mean-per-class", "11point_mAP", "roc_auc")


# ---------------------------------------------------------------- F1 / F2

def accuracy(preds: DataFrame, pred: str = "pred", target: str = "target", group_cols=()) -> DataFrame:
    """top-1 accuracy (group..., accuracy)."""
    hit = F.when(F.col(pred) == F.col(target), 1.0).otherwise(0.0)
    return preds.groupBy(*group_cols).agg(F.avg(hit).alias("accuracy"))


def mean_per_class(preds: DataFrame, pred: str = "pred", target: str = "target", group_cols=()) -> DataFrame:
    """F2: balanced accuracy - recall of each true class, unweighted mean
    over the classes that occur."""
    hit = F.when(F.col(pred) == F.col(target), 1.0).otherwise(0.0)
    per = preds.groupBy(*group_cols, target).agg(F.avg(hit).alias("__r"))
    return per.groupBy(*group_cols).agg(F.avg("__r").alias("mean_per_class"))


# ---------------------------------------------------------------- F3

def map_11_point(scores: DataFrame, labels: DataFrame | None = None, item: str = "image_id", cls: str = "class_idx",
                 score: str = "prob", label: str = "present", group_cols=()) -> DataFrame:
    """11-point interpolated average precision per class, averaged over
    the classes with at least one positive.

    Per class, items in descending score (item id breaks ties); at each cut
    precision = tp / rank and recall = tp / P.  AP = mean over t in
    {0, 0.1, .., 1} of the largest precision with recall >= t (0 if none).
    recall >= t is tested in integers (10 * tp >= i * P).
    Without ``labels`` the score rows carry ``label`` themselves.
    Returns (group..., map, classes)."""
    g = list(group_cols)
    j = (scores.select(*g, item, cls, score, label) if labels is None
         else scores.select(*g, item, cls, score).join(labels.select(*g, item, cls, label), [*g, item, cls], "inner"))
    j = j.withColumn("__pos", F.col(label).cast("bigint")).withColumn("__one", F.lit(1).cast("bigint"))
    order = [*map(F.col, g), F.col(cls), F.desc(F.round(score, 9)), F.col(item)]
    j = prefix_sum(j, order, ["__pos", "__one"], ["__cum_tp", "__cum_n"])
    base = j.groupBy(*g, cls).agg(F.min(F.col("__cum_tp") - F.col("__pos")).alias("__tp0"),
                              F.min(F.col("__cum_n") - 1).alias("__n0"),
                              F.sum("__pos").alias("__P"))
    r = (j.join(broadcast_if_small(base), [*g, cls])
          .withColumn("__tp", F.col("__cum_tp") - F.col("__tp0"))
          .withColumn("__rank", F.col("__cum_n") - F.col("__n0"))
          .filter(F.col("__P") > 0)
          .withColumn("__prec", F.col("__tp") / F.col("__rank"))
          # largest i with 10 * tp >= i * P
          .withColumn("__tmax", F.floor(F.col("__tp") * 10 / F.col("__P")).cast("int")))
    best = r.groupBy(*g, cls, "__tmax").agg(F.max("__prec").alias("__p"))
    # interpolated precision at t_i = max over t_max >= i; one row per (class, i)
    grid = best.select(*g, cls, "__tmax", "__p",
                       F.explode(F.sequence(F.lit(0), F.col("__tmax"))).alias("__i"))
    interp = grid.groupBy(*g, cls, "__i").agg(F.max("__p").alias("__ip"))
    ap = interp.groupBy(*g, cls).agg((F.sum("__ip") / F.lit(11.0)).alias("ap"))
    return ap.groupBy(*g).agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("classes"))


# ---------------------------------------------------------------- F4

def roc_auc(df: DataFrame, label: str = "label", score: str = "score", group_cols=()) -> DataFrame:
    """binary ROC AUC (ties count one half).  Counts per distinct score,
    an exact distributed prefix sum of negatives, then
    sum(pos * (neg_below + neg_here / 2)) / (P * N).  Returns (group..., auc); null for a group
    with labels of one kind only."""
    by = list(group_cols)
    labels = df.select(*by, F.col(label).cast("int").alias("__y"), F.col(score).cast("double").alias("__s"))
    bad = labels.filter(~F.col("__y").isin(0, 1)).limit(1).count()
    if bad:
        raise ValueError("roc_auc supports binary labels only (0/1)")
    g = labels.groupBy(*by, "__s").agg(F.sum(F.when(F.col("__y") == 1, 1).otherwise(0)).cast("bigint").alias("__p"),
                                       F.sum(F.when(F.col("__y") == 0, 1).otherwise(0)).cast("bigint").alias("__n"))
    c = prefix_sum(g, [*by, "__s"], "__n", "__cn")
    # the running count goes on over the groups: a group's own begins with its first score
    base = F.min(F.struct("__s", (F.col("__cn") - F.col("__n")).alias("b")))["b"]
    part = c.groupBy(*by).agg(
        F.sum(F.col("__p") * (F.col("__cn") - F.col("__n") + F.col("__n") / 2.0)).alias("__a"), base.alias("__b"),
        F.sum("__p").cast("double").alias("__pos"), F.sum("__n").cast("double").alias("__neg"))
    return part.select(*by, F.try_divide(F.col("__a") - F.col("__b") * F.col("__pos"), F.col("__pos") * F.col("__neg")).alias("auc"))


# ---------------------------------------------------------------- F5

def dispatch(dataset_results: DataFrame, metadata: DataFrame) -> DataFrame:
    """pick, for every dataset, the metric its metadata names.
    ``dataset_results`` is (dataset, metric, value) with every metric that
    was computed; ``metadata`` (dataset, metric).  A metric that is not one of
    the four known names fails the job, and so does a dataset without a
    result for its metric.  Returns (dataset, metric, result) with result x 100."""
    known = F.when(F.col("metric").isin(*METRICS), F.col("metric")).otherwise(
        F.raise_error(F.concat(F.lit("unknown metric for dataset "), F.col("dataset"))))
    wanted = metadata.select("dataset", known.alias("metric"))
    value = F.when(F.col("value").isNotNull(), F.col("value") * 100.0).otherwise(
        F.raise_error(F.concat(F.lit("no result for dataset "), F.col("dataset"))))
    return wanted.join(dataset_results, ["dataset", "metric"], "left").select("dataset", "metric", value.alias("result"))


def metadata_table(spark, datasets=None) -> DataFrame:
    items = sorted(DATASET_METRIC.items()) if datasets is None else [(d, DATASET_METRIC[d]) for d in datasets]
    return spark.createDataFrame(items, "dataset string, metric string")


# ---------------------------------------------------------------- F7 / F8

def _batch_fn(scale: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pair_id")
        I = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["img_vec"]])
        T = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["txt_vec"]])
        L = scale * (I @ T.T)
        n = len(pdf)
        idx = np.arange(n)

        def ce(M):
            m = M.max(axis=1, keepdims=True)
            lse = (m + np.log(np.exp(M - m).sum(axis=1, keepdims=True)))[:, 0]
            return float(np.mean(lse - M[idx, idx]))

        def acc(M):
            # argmax with the lowest index on ties
            return float(np.mean(np.argmax(M, axis=1) == idx))
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "n": [n],
                             "loss": [(ce(L) + ce(L.T)) / 2.0],
                             "acc_image": [acc(L)], "acc_text": [acc(L.T)]})
    return fn


def in_batch_metrics(pairs: DataFrame, scale: float = 20.0) -> DataFrame:
    """F7 + F8 per batch: contrastive loss (mean of the row and column
    cross-entropies with target = own position) and the share of rows /
    columns whose argmax is their own position.  ``pairs``: (batch_id,
    pair_id, img_vec, txt_vec); a group is one batch (bounded by the batch
    size)."""
    ship_package(pairs.sparkSession)
    return pairs.groupBy("batch_id").applyInPandas(
        _batch_fn(float(scale)), "batch_id long, n long, loss double, acc_image double, acc_text double")


def epoch_metrics(per_batch: DataFrame) -> DataFrame:
    """F8 pooled over the epoch (weighted by batch size) and the mean loss."""
    return per_batch.agg(F.avg("loss").alias("mean_loss"),
                         (F.sum(F.col("acc_image") * F.col("n")) / F.sum("n")).alias("acc_image"),
                         (F.sum(F.col("acc_text") * F.col("n")) / F.sum("n")).alias("acc_text"))


# ---------------------------------------------------------------- F9

def classification_loss(scores: DataFrame, targets: DataFrame, image_id: str = "image_id",
                        class_idx: str = "class_idx", logit: str = "logit",
                        target: str = "target") -> DataFrame:
    """cross-entropy of the true class (log-sum-exp over classes minus
    the true logit) and argmax accuracy, averaged over images.  With
    ``is_pos`` on the score rows (``class_scores(..., target=...)``) the
    true logit is read in the same per-image aggregate; the per-image
    maximum is a window over that image's class rows.  An image of ``targets``
    without a score for its class has no loss and fails the job."""
    s = scores
    if "is_pos" not in s.columns:
        s = s.join(targets.select(image_id, target), image_id).withColumn(
            "is_pos", F.col(class_idx) == F.col(target))
    w = Window.partitionBy(image_id)
    per = (s.withColumn("__m", F.max(logit).over(w))
            .groupBy(image_id)
            .agg(F.first("__m").alias("__m"),
                 F.sum(F.exp(F.col(logit) - F.col("__m"))).alias("__se"),
                 F.max(F.when(F.col("is_pos"), F.col(logit))).alias("__tl"),
                 F.max(F.when(F.col("is_pos"), 1).otherwise(0)).alias("__has_t"),
                 F.max_by(F.col("is_pos").cast("int"),
                          F.struct(F.round(logit, 9), -F.col(class_idx))).alias("__hit")))
    loss = F.col("__m") + F.log("__se") - F.col("__tl")
    every = targets.select(image_id).join(per, image_id, "left")
    scored = F.coalesce("__has_t", F.lit(0)) == 1
    checked = F.when(scored, loss).otherwise(
        F.raise_error(F.concat(F.lit("no score for the class of image "), F.col(image_id).cast("string"))))
    return every.agg(F.avg(checked).alias("loss"), F.avg(F.col("__hit").cast("double")).alias("accuracy"))


# ---------------------------------------------------------------- F10

def run_summary(results: DataFrame, model: str = "model", dataset: str = "dataset",
                value: str = "value", baseline: str | None = None) -> DataFrame:
    """mean and sample standard deviation over repeated runs per
    (model, dataset), the model's average over datasets (dataset =
    '__average__'), and the difference in points to a baseline model."""
    per = results.groupBy(model, dataset).agg(F.avg(value).alias("mean"),
                                              F.stddev_samp(value).alias("std"),
                                              F.count(F.lit(1)).alias("runs"))
    avg = (per.groupBy(model).agg(F.avg("mean").alias("mean"))
              .select(model, F.lit("__average__").alias(dataset), "mean",
                      F.lit(None).cast("double").alias("std"), F.lit(None).cast("bigint").alias("runs")))
    out = per.unionByName(avg)
    if baseline is not None:
        b = out.filter(F.col(model) == F.lit(baseline)).select(dataset, F.col("mean").alias("__b"))
        out = out.join(b, dataset, "left").withColumn("diff", F.col("mean") - F.col("__b")).drop("__b")
    return out

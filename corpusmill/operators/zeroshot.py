"""E: zero-shot retrieval and classification over embedding tables.

Scores come from ``similarity.topk_scores`` (blocked, exact); everything here
is joins, windows partitioned by the query, and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators import pruned_topk
from corpusmill.operators import similarity as S
from corpusmill.operators.partitioning import broadcast_if_small

RECALL_KS = (1, 5, 10)


# ---------------------------------------------------------------- E9 / E10 / E11

def with_ks(df: DataFrame, ks, name: str = "k") -> DataFrame:
    """One copy of each row per k (a narrow ``explode`` of a literal list)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(k)).cast("bigint") for k in ks])))


def retrieval_topk(queries: DataFrame, candidates: DataFrame, k: int, q_id: str, c_id: str,
                   q_key: str, c_key: str, vec: str = "vec") -> DataFrame:
    """Top-k candidates per query with a positive flag: a candidate is a
    positive of the query when their integral match keys are equal
    (text.image_id = image.image_id).  The keys travel with the vectors
    through the blocks, so no join follows the scoring.
    Returns (q_id, c_id, score, rank, is_pos)."""
    return S.topk_scores(queries.select(q_id, q_key, vec), candidates.select(c_id, c_key, vec), k,
                         q_id=q_id, c_id=c_id, vec=vec, q_key=q_key, c_key=c_key)


def hit_recall(top: DataFrame, queries: DataFrame, q_id: str, ks=RECALL_KS) -> DataFrame:
    """Share of queries with at least one positive in the top k, for
    each k; every query is in the denominator (no positive = miss), taken
    from a count rather than a join of all queries.  Returns (k, recall)."""
    n_queries = queries.count()
    best = top.filter("is_pos").groupBy(q_id).agg(F.min("rank").alias("best_rank"))
    hits = (with_ks(best, ks).groupBy("k")
                .agg(F.sum(F.when(F.col("best_rank") <= F.col("k"), 1).otherwise(0)).alias("hits")))
    spark = top.sparkSession
    all_k = spark.createDataFrame([(int(k),) for k in ks], "k bigint")
    return (all_k.join(F.broadcast(hits), "k", "left")
                 .select("k", F.try_divide(F.coalesce(F.col("hits"), F.lit(0)).cast("double"),
                                           F.lit(float(n_queries))).alias("recall")))


def true_recall(top: DataFrame, queries: DataFrame, candidates: DataFrame, q_id: str,
                q_key: str, c_key: str, ks=RECALL_KS) -> DataFrame:
    """Per query and k, positives in the top k / positives overall
    (null when the query has no positive: 0/0).  Returns (q_id, k, recall)."""
    n_pos = candidates.groupBy(F.col(c_key).alias("__key")).agg(F.count(F.lit(1)).alias("n_pos"))
    q = queries.select(q_id, F.col(q_key).alias("__key")).join(n_pos, "__key", "left").drop("__key")
    hits = (with_ks(top.filter("is_pos"), ks).filter(F.col("rank") <= F.col("k"))
               .groupBy(q_id, "k").agg(F.count(F.lit(1)).alias("tp")))
    return (with_ks(q, ks).join(hits, [q_id, "k"], "left")
             .select(q_id, "k", F.try_divide(F.coalesce(F.col("tp"), F.lit(0)).cast("double"),
                                             F.col("n_pos").cast("double")).alias("recall")))


def retrieval_report(images: DataFrame, texts: DataFrame, ks=RECALL_KS,
                     image_id: str = "image_id", text_id: str = "text_id",
                     vec: str = "vec") -> DataFrame:
    """E10 in both directions: (direction, k, recall).

    ``image_retrieval``: each text retrieves images; ``text_retrieval``: each
    image retrieves texts.  Vectors are L2-normalised first (D1)."""
    kmax = max(ks)
    im = S.l2_normalize(images.select(image_id, vec), vec).select(
        image_id, F.col(image_id).alias("__key"), vec)
    tx = S.l2_normalize(texts.select(text_id, image_id, vec), vec).select(
        text_id, F.col(image_id).alias("__key"), vec)
    t2i = retrieval_topk(tx, im, kmax, text_id, image_id, "__key", "__key", vec)
    i2t = retrieval_topk(im, tx, kmax, image_id, text_id, "__key", "__key", vec)
    a = hit_recall(t2i, tx, text_id, ks).withColumn("direction", F.lit("image_retrieval"))
    b = hit_recall(i2t, im, image_id, ks).withColumn("direction", F.lit("text_retrieval"))
    return a.unionByName(b).select("direction", "k", "recall")


def mean_recall(report: DataFrame) -> DataFrame:
    """Mean over k of the hit recall, per direction."""
    return report.groupBy("direction").agg(F.avg("recall").alias("mean_recall"))


# ---------------------------------------------------------------- E1 / E2

def expand_prompts(classes: DataFrame, templates, name: str = "name",
                   class_idx: str = "class_idx") -> DataFrame:
    """Every class x every template, classes outer and templates inner;
    ``{}`` is formatted with the class name, ``[CLASS]`` replaced by it.

    ``templates`` is a list of strings (a narrow ``posexplode`` of a literal
    array per class row: no join) or a DataFrame (dataset, tpl_idx, template)
    joined to ``classes`` on ``dataset``; it is broadcast only when its size
    is checked to be small, else joined by shuffle."""
    if isinstance(templates, (list, tuple)):
        arr = F.array(*[F.lit(t) for t in templates])
        x = classes.select("*", F.posexplode(arr).alias("tpl_idx", "template"))
    else:
        t = templates.select("dataset", "tpl_idx", "template")
        x = classes.join(broadcast_if_small(t), "dataset", "inner")
    filled = F.replace(F.replace(F.col("template"), F.lit("{}"), F.col(name)), F.lit("[CLASS]"), F.col(name))
    return x.withColumn("tpl_idx", F.col("tpl_idx").cast("bigint")).withColumn("prompt", filled)


def first_alias(aliases) -> Column:
    """A class given as a list of aliases is named by its first alias;
    a plain name (one-element list) stays as it is."""
    a = F.col(aliases) if isinstance(aliases, str) else aliases
    return F.try_element_at(a, F.lit(1))


# ---------------------------------------------------------------- E3

def class_prototypes(prompt_vecs: DataFrame, variant: str = "a", class_idx: str = "class_idx",
                     vec: str = "vec", group_cols=()) -> DataFrame:
    """One vector per class from its prompt vectors (prompt ensemble).

    a: normalise each prompt vector, mean, normalise;
    b: mean then normalise, but a single prompt is used as is;
    c: mean of the raw vectors, then normalise.
    The mean is a partial aggregate over (class, dimension), so a class with
    very many prompts is combined map-side."""
    keys = list(group_cols) + [class_idx]
    src = prompt_vecs.select(*keys, V.as_double_array(vec).alias("__v"))
    if variant == "a":
        src = src.withColumn("__v", V.l2_normalize("__v"))
    elif variant not in ("b", "c"):
        raise ValueError("variant must be a, b or c")
    per_dim = (src.select(*keys, F.posexplode("__v").alias("__d", "__x"))
                  .groupBy(*keys, "__d").agg(F.avg("__x").alias("__m"), F.count(F.lit(1)).alias("__n")))
    proto = (per_dim.groupBy(*keys)
                    .agg(F.array_sort(F.collect_list(F.struct("__d", "__m"))).alias("__l"),
                         F.max("__n").alias("n_prompts"))
                    .withColumn("__mean", F.transform("__l", lambda s: s["__m"])))
    if variant == "b":
        # a single prompt's raw vector is its mean: only the normalisation is skipped
        out = F.when(F.col("n_prompts") == 1, F.col("__mean")).otherwise(V.l2_normalize("__mean"))
    else:
        out = V.l2_normalize("__mean")
    return proto.select(*keys, out.alias(vec), "n_prompts")


# ---------------------------------------------------------------- E4 scale

def logit_scale(kind="fixed100", logit_scale_param: float | None = None) -> float:
    """E4 scale: 100, a fixed 20, or exp(learned logit scale) clamped at
    ln(100)."""
    import math
    if kind == "fixed100":
        return 100.0
    if kind == "fixed20":
        return 20.0
    if kind == "learned":
        return math.exp(min(float(logit_scale_param), math.log(100.0)))
    raise ValueError(kind)


# ---------------------------------------------------------------- E5 / E6 / E12

def class_scores(images: DataFrame, prototypes: DataFrame, scale: float = 100.0,
                 image_id: str = "image_id", class_idx: str = "class_idx", vec: str = "vec",
                 normalize_images: bool = True, group_cols=(), target: str | None = None) -> DataFrame:
    """E4 against the class prototypes: (group..., image_id, class_idx, logit,
    rank) for every class (the class list is bounded; images are not).
    With ``target`` the rows also carry ``is_pos`` (class = the image's
    target), computed inside the scoring blocks."""
    cols = list(group_cols) + [image_id] + ([target] if target else []) + [vec]
    im = images.select(*cols)
    if normalize_images:
        im = S.l2_normalize(im, vec).select(*cols)
    pr = prototypes.select(*group_cols, class_idx, vec)
    return (S.all_scores(im, pr, q_id=image_id, c_id=class_idx, vec=vec, scale=scale, group_cols=group_cols,
                         q_key=target, c_key=class_idx if target else None)
             .withColumnRenamed("score", "logit"))


def softmax(scores: DataFrame, image_id: str = "image_id", logit: str = "logit",
            group_cols=()) -> DataFrame:
    """E5: class probabilities per image: exp(l - max) / sum(exp(l - max)),
    plus ``log_prob`` (log-softmax), which orders classes like ``prob`` but
    keeps tiny probabilities apart when ranks use rounded scores."""
    w = Window.partitionBy(*group_cols, image_id)
    sh = F.col(logit) - F.max(logit).over(w)
    return (scores.withColumn("__sh", sh).withColumn("__z", F.exp("__sh"))
                  .withColumn("__sz", F.sum("__z").over(w))
                  .withColumn("prob", F.col("__z") / F.col("__sz"))
                  .withColumn("log_prob", F.col("__sh") - F.log(F.col("__sz")))
                  .drop("__sh", "__z", "__sz"))


def predictions(probs: DataFrame, targets: DataFrame, image_id: str = "image_id",
                class_idx: str = "class_idx", target: str = "target", group_cols=()) -> DataFrame:
    """E5: (image_id, pred, confidence, target): argmax class (smaller class
    on ties) and its probability."""
    keys = list(group_cols) + [image_id]
    best = (probs.groupBy(*keys)
                 .agg(F.max_by(F.col(class_idx), F.struct(V.rank_score("prob"), -F.col(class_idx))).alias("pred"),
                      F.max("prob").alias("confidence")))
    return best.join(targets.select(*keys, target), keys, "inner")


def topk_classes(images: DataFrame, prototypes: DataFrame, k: int, image_id: str = "image_id",
                 class_idx: str = "class_idx", vec: str = "vec") -> DataFrame:
    """The k best classes per image, descending: (image_id, rank, class_idx, score)."""
    return S.topk_scores(images.select(image_id, vec), prototypes.select(class_idx, vec), k,
                         q_id=image_id, c_id=class_idx, vec=vec)


def topk_accuracy(scores: DataFrame, targets: DataFrame, ks=(1, 5, 10), image_id: str = "image_id",
                  class_idx: str = "class_idx", target: str = "target", group_cols=()) -> DataFrame:
    """Share of images whose true class is among the top k, per k
    (k above the class count is capped: everything is a hit), plus the
    plain average over the ks as k = 0.  The denominator is every image of
    ``targets`` (an image whose class has no prototype is a miss).
    Returns (group..., k, accuracy)."""
    keys = list(group_cols) + [image_id]
    if "is_pos" in scores.columns:
        hit_rank = scores.filter("is_pos").select(*keys, F.col("rank").alias("__r"))
    else:
        t = targets.select(*keys, F.col(target).alias("__t"))
        hit_rank = (scores.join(t, keys).filter(F.col(class_idx) == F.col("__t"))
                          .select(*keys, F.col("rank").alias("__r")))
    hits = (with_ks(hit_rank, ks).groupBy(*group_cols, "k")
            .agg(F.sum(F.when(F.col("__r") <= F.col("k"), 1).otherwise(0)).alias("__h")))
    n_img = targets.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__n"))
    # (groups x ks) rows: as many as there are groups, never data-sized
    per_k = (with_ks(n_img, ks).join(hits, list(group_cols) + ["k"], "left")
             .select(*group_cols, "k", (F.coalesce(F.col("__h"), F.lit(0)) / F.col("__n")).alias("accuracy")))
    avg = per_k.groupBy(*group_cols).agg(F.avg("accuracy").alias("accuracy")).withColumn("k", F.lit(0).cast("bigint"))
    return per_k.unionByName(avg)


# ---------------------------------------------------------------- E7 / E8

def retrieval_list(queries: DataFrame, candidates: DataFrame, k: int, q_id: str, c_id: str,
                   vec: str = "vec", normalize: bool = True, prune: bool = False) -> DataFrame:
    """For every query its k best candidates, descending:
    (q_id, rank, c_id, score).  All queries at once, keyed by query.  ``prune`` skips
    block pairs that cannot reach a query's k-th score: worth its two passes for many, clustered candidates."""
    q, c = queries.select(q_id, vec), candidates.select(c_id, vec)
    if normalize:
        q, c = S.l2_normalize(q, vec).select(q_id, vec), S.l2_normalize(c, vec).select(c_id, vec)
    topk = pruned_topk.topk_scores if prune else S.topk_scores
    return topk(q, c, k, q_id=q_id, c_id=c_id, vec=vec)


def retrieve_by_text(texts: DataFrame, encoder_factory, candidates: DataFrame, k: int,
                     q_id: str = "query_id", text: str = "text", c_id: str = "image_id",
                     vec: str = "vec", cache_key: str | None = None) -> DataFrame:
    """E7 with free-text queries: the texts are embedded by the pluggable
    encoder (C1, Arrow batches on the executors), normalised and matched
    against every candidate; (q_id, rank, c_id, score) for the k best."""
    from corpusmill.operators.infer import embed
    q = embed(texts.select(q_id, text), text, encoder_factory, out=vec, cache_key=cache_key)
    q = q.filter(F.col(vec).isNotNull()).select(q_id, V.as_double_array(vec).alias(vec))
    return retrieval_list(q, candidates, k, q_id, c_id, vec)


# ---------------------------------------------------------------- E13 / E14

def class_subset(images: DataFrame, prototypes: DataFrame, subset: DataFrame, target: str = "target",
                 class_idx: str = "class_idx") -> tuple:
    """Keep the images of the subset classes and re-index targets and
    prototypes to the class's position in the subset.  ``subset`` is (pos,
    class_idx).  Returns (images, prototypes) with ``class_idx``/``target``
    = position."""
    sub = subset.select(F.col("pos").cast("bigint").alias("__new"), F.col(class_idx).alias("__old"))
    sub = broadcast_if_small(sub)
    im = (images.join(sub, images[target] == sub["__old"], "inner")
                .drop(target, "__old").withColumnRenamed("__new", target))
    pr = (prototypes.join(sub, prototypes[class_idx] == sub["__old"], "inner")
                    .drop(class_idx, "__old").withColumnRenamed("__new", class_idx))
    return im, pr


def subset_accuracy(scores: DataFrame, targets: DataFrame, n_subset_classes: int,
                    images_per_class: int | None = None, image_id: str = "image_id",
                    target: str = "target") -> DataFrame:
    """Top-1 hits divided by (subset classes x images per class) when
    ``images_per_class`` is given (the reference's fixed 50), else by the
    number of subset images.  ``scores`` must carry ``is_pos``
    (``class_scores(..., target=...)``).  Returns (accuracy, n_images)."""
    n_images = targets.count()
    den = float(n_subset_classes * images_per_class) if images_per_class else float(n_images)
    hits = scores.filter((F.col("rank") == 1) & F.col("is_pos"))
    return hits.agg((F.count(F.lit(1)) / F.lit(den)).alias("accuracy"),
                    F.lit(n_images).cast("bigint").alias("n_images"))


def sweep_missing(requested: DataFrame, available: DataFrame, keys) -> DataFrame:
    """The (language, prompt set) combinations that are requested but
    have no classes or prompts: listed, then skipped."""
    return requested.join(available.select(*keys).distinct(), list(keys), "left_anti")


# ---------------------------------------------------------------- E15 / E16 / E17

def vocabulary_from_annotations(ann: DataFrame, label_col: str, id_col: str = "id",
                                cols=("id", "fine_grained_label", "translated_fine_grained_label",
                                      "translated_coarse_grained_label")) -> DataFrame:
    """E15 (annotation table): distinct label rows, ordered by numeric id;
    target = id - 1.  Returns (target, label, n_files)."""
    d = ann.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_files"))
    return d.select((F.col(id_col) - 1).cast("bigint").alias("target"), F.col(label_col).alias("label"), "n_files")


def vocabulary_last_wins(rows: DataFrame, id_col: str, name_col: str, pos: str = "pos") -> DataFrame:
    """E15 (id -> name list): later rows overwrite the name, order of first
    appearance.  Returns (class_id, name, first_pos)."""
    return rows.groupBy(id_col).agg(F.max_by(name_col, pos).alias("name"), F.min(pos).alias("first_pos")) \
               .withColumnRenamed(id_col, "class_id")


def translate_labels(classes: DataFrame, mapping: DataFrame, name: str = "class_name",
                     out: str = "label") -> DataFrame:
    """E15 (folder classes): class name -> translated label through a lookup
    table (source, target); the lookup is broadcast only after its size is
    checked, else joined by shuffle.  Unknown names keep a null label."""
    m = mapping.select(F.col("source").alias(name), F.col("target").alias(out))
    return classes.join(broadcast_if_small(m), name, "left")


def gather(rows: DataFrame, index: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """``rows[index]`` - reorder / subset / repeat rows by an index list
    given as (pos, idx); the output order is ``pos``."""
    return index.select(F.col("pos").cast("bigint").alias("pos"), F.col("idx").alias(row_idx)) \
                .join(rows, row_idx, "inner")


def multi_hot(images: DataFrame, pairs: DataFrame, classes: DataFrame, image: str = "image",
              class_col: str = "class_name", class_idx: str = "class_idx") -> DataFrame:
    """(image, class_idx, class_name, present) for every image x class of
    ``classes`` (class_idx, class_name); duplicates collapse, absent -> 0,
    images without objects -> all zeros.

    The class list is put together once, as one row, and exploded per image:
    the grid is the operator's output."""
    ids = images.select(image).distinct()
    row = classes.agg(F.array_sort(F.collect_list(F.struct(class_idx, class_col))).alias("l")).scalar()
    grid = ids.withColumn("__c", F.explode(row)).select(
        image, F.col("__c." + class_idx).cast("bigint").alias("class_idx"), F.col("__c." + class_col).alias(class_col))
    seen = pairs.select(image, class_col).distinct().withColumn("__p", F.lit(1))
    return grid.join(seen, [image, class_col], "left") \
               .select(image, "class_idx", class_col, F.coalesce("__p", F.lit(0)).cast("bigint").alias("present"))

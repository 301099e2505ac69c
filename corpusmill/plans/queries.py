"""Registered queries: each binds library operators to the test tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching oracle SQL in ``plans/oracle.py``.  Doubles
are rounded to 6 decimals on output only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators import similarity as S
from corpusmill.operators import zeroshot as Z
from corpusmill.plans import views
from corpusmill.session import reliable_checkpoint, scratch_folder
from corpusmill.operators.partitioning import broadcast_if_small
from corpusmill.sources import files as FS
from corpusmill.sources import shard_index as SI
from corpusmill.sources import shard_plan as SP
from corpusmill.sources import shards as SH
from corpusmill.sources.json_arrays import write_arrays

REGISTRY: dict = {}


def register(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _r(c):
    return V.out(c)


# ---------------------------------------------------------------- E: retrieval

@register("e10_retrieval_recall")
def e10_retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    rep = Z.retrieval_report(views.img(spark, d), views.txt(spark, d))
    return rep.select("direction", "k", _r("recall").alias("recall"))


@register("e11_mean_recall")
def e11_mean_recall(spark: SparkSession, d: str) -> DataFrame:
    rep = Z.retrieval_report(views.img(spark, d), views.txt(spark, d))
    return Z.mean_recall(rep).select("direction", _r("mean_recall").alias("mean_recall"))


@register("e9_true_recall")
def e9_true_recall(spark: SparkSession, d: str) -> DataFrame:
    """Image -> text true recall per image (several positives per image)."""
    im = S.l2_normalize(views.img(spark, d)).select("image_id", F.col("image_id").alias("key"), "vec")
    tx = S.l2_normalize(views.txt(spark, d)).select("text_id", F.col("image_id").alias("key"), "vec")
    top = Z.retrieval_topk(im, tx, 10, "image_id", "text_id", "key", "key")
    rec = Z.true_recall(top, im, tx, "image_id", "key", "key")
    return rec.select("image_id", "k", _r("recall").alias("recall"))


# ---------------------------------------------------------------- D: similarity and selection

from corpusmill.operators import diversity as DV  # noqa: E402
from corpusmill.operators import permutation as PM  # noqa: E402
from corpusmill.operators import sample as SM  # noqa: E402
from corpusmill.operators import select as SEL  # noqa: E402


def _scored(spark, d):
    return S.scored_samples(views.img(spark, d), views.caption_embeddings(spark, d), views.ORIGINAL_CAPTIONS)


@register("d1_l2_normalize")
def d1_l2_normalize(spark, d):
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = S.l2_normalize(e, "vec")
    return n.select("vec_id", F.posexplode("vec").alias("dim", "x"), "vec_is_zero") \
            .select("vec_id", F.col("dim").cast("bigint").alias("dim"), _r("x").alias("x"),
                    F.col("vec_is_zero").alias("is_zero"))


@register("d2_paired_cosine")
def d2_paired_cosine(spark, d):
    p = S.paired_cosine(views.pair_images(spark, d), views.pair_texts(spark, d), "pair_id")
    return p.select("pair_id", _r("sim").alias("sim"))


@register("d3_one_to_many_cosine")
def d3_one_to_many_cosine(spark, d):
    s = _scored(spark, d)
    return s.select("image_id", F.posexplode("similarities").alias("pos", "sim")) \
            .select("image_id", F.col("pos").cast("bigint").alias("pos"), _r("sim").alias("sim"))


@register("d4_filter_pairs")
def d4_filter_pairs(spark, d):
    p = S.paired_cosine(views.pair_images(spark, d), views.pair_texts(spark, d), "pair_id")
    f = SEL.filter_pairs(p.withColumn("sim", V.rank_score("sim")), "sim", 0.2, ["pair_id"])
    return f.select("idx", "pair_id", _r("sim").alias("sim"))


@register("d5_caption_pool")
def d5_caption_pool(spark, d):
    s = _scored(spark, d).withColumn("orig", F.slice("captions", 1, views.ORIGINAL_CAPTIONS))
    pool = s.select("image_id", SEL.caption_pool("orig", "generated", "pt", 2).alias("pool"))
    return pool.select("image_id", F.posexplode("pool").alias("idx", "text")) \
               .withColumn("idx", F.col("idx").cast("bigint"))


@register("d6_filter_by_ranking")
def d6_filter_by_ranking(spark, d):
    s = _scored(spark, d)
    p = s.select("image_id", SEL.top_k_by_similarity_pos("captions", "similarities", 3).alias("p"))
    return p.select("image_id", F.posexplode("p").alias("out_pos", "src_pos")) \
            .select("image_id", F.col("out_pos").cast("bigint").alias("out_pos"),
                    F.col("src_pos").cast("bigint").alias("src_pos"))


@register("d7_filter_by_threshold")
def d7_filter_by_threshold(spark, d):
    s = _scored(spark, d)
    p = s.select("image_id", SEL.above_threshold_pos("captions", "similarities", 0.2).alias("p"))
    return p.select("image_id", F.posexplode("p").alias("out_pos", "src_pos")) \
            .select("image_id", F.col("out_pos").cast("bigint").alias("out_pos"),
                    F.col("src_pos").cast("bigint").alias("src_pos"))


@register("d12_drop_empty")
def d12_drop_empty(spark, d):
    s = _scored(spark, d)
    p = s.select("image_id", SEL.above_threshold("captions", "similarities", 0.2).alias("pool"))
    return SEL.drop_empty(p, "pool").select("image_id", F.size("pool").cast("bigint").alias("n_kept"))


@register("d13_random_caption")
def d13_random_caption(spark, d):
    s = _scored(spark, d)
    return s.select("image_id", F.size("captions").cast("bigint").alias("n"),
                    SM.random_caption_index("captions", "image_id", seed=7, epoch=1).alias("pick"))


@register("d8_tfidf")
def d8_tfidf(spark, d):
    w = DV.tfidf(views.caps(spark, d), n_col="n_captions")
    return w.select("image", "pos", "token", _r("w").alias("w"))


@register("d9_caption_pair_similarity")
def d9_caption_pair_similarity(spark, d):
    p = DV.pair_similarity(DV.tfidf(views.caps(spark, d), n_col="n_captions"))
    return p.select("image", "pos_a", "pos_b", _r("sim").alias("sim"))


@register("d9_similar_pairs")
def d9_similar_pairs(spark, d):
    """The caption pairs above the pruning threshold, by a prefix-filtered join."""
    p = DV.similar_pairs(DV.tfidf(views.caps(spark, d), n_col="n_captions"), thr=0.3)
    return p.select("image", "pos_a", "pos_b", _r("sim").alias("sim"))


@register("d10_diversity_pruning")
def d10_diversity_pruning(spark, d):
    """Captions left by the greedy loop."""
    return DV.prune_similar(views.caps(spark, d), k_min=3, thr=0.3, n_col="n_captions").select("image", "pos")


@register("d11_threshold_diversity")
def d11_threshold_diversity(spark, d):
    """D7 on the image-caption similarity, then the diversity loop."""
    long = S.one_to_many_cosine(views.img(spark, d), views.caption_embeddings(spark, d))
    kept = DV.threshold_then_diversity(long.select(F.col("image_id").alias("image"), "pos", "text", "sim"),
                                       "sim", threshold=0.15, k_min=3)
    return kept.select("image", "pos")


@register("d14_seeded_shuffle")
def d14_seeded_shuffle(spark, d):
    """Seeded full shuffle of the documents (order lives in the partitions)."""
    return SM.seeded_shuffle(views.documents(spark, d).select("doc_id"), "doc_id", seed=3, epoch=0,
                             hash_kind="md5").select("doc_id", "shuffle_h")


@register("d15_batches")
def d15_batches(spark, d):
    b = SM.batches(views.documents(spark, d).select("doc_id"), "doc_id", 64, seed=3, epoch=0, hash_kind="md5")
    return b.select("doc_id", "idx", "batch_id", "slot")


@register("d15_permuted_batches")
def d15_permuted_batches(spark, d):
    """Batches of an epoch by the keyed permutation of the documents' numbers."""
    numbered = global_index(views.table(spark, d, "documents").select("doc_id"), ["doc_id"], col="idx")
    return PM.epoch_batches(numbered, numbered.count(), 64, seed=3, epoch=2).select("doc_id", "idx", "place", "batch_id", "slot")


# ---------------------------------------------------------------- E: classification

from corpusmill.operators import metrics as M  # noqa: E402
from corpusmill.operators import scoring_state as ST  # noqa: E402
from corpusmill.operators.indexing import global_index  # noqa: E402

# Prompt templates of the queries.
TEMPLATES = [
    "an event of type {}",
    "one [CLASS] in the log",
    "someone triggered {} today.",
]
SUBSET_CLASSES = [2, 4, 6, 8]       # classes covered by the "language" of E13
SWEEP_LANGS = ["de", "en", "es", "fr", "pt"]


def _protos(spark, d, variant="a"):
    return Z.class_prototypes(views.prompts(spark, d), variant)


def _class_scores(spark, d):
    return Z.class_scores(views.test_images(spark, d), _protos(spark, d), scale=100.0, target="target")


def _probs(spark, d):
    return Z.softmax(_class_scores(spark, d))


def _states(spark, d):
    return ST.class_states(views.test_images(spark, d), _protos(spark, d), scale=100.0)


def _preds(spark, d):
    return ST.predictions(_states(spark, d))


@register("e1_prompt_expansion")
def e1_prompt_expansion(spark, d):
    names = views.table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    classes = global_index(names, ["name"], col="class_idx")
    x = Z.expand_prompts(classes, TEMPLATES)
    return x.select("class_idx", "tpl_idx", "prompt")


@register("e2_first_alias")
def e2_first_alias(spark, d):
    b = views.table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("class_idx"), Z.first_alias(F.split("text", " ")).alias("name"))


@register("e3_class_prototypes")
def e3_class_prototypes(spark, d):
    out = None
    for v in ("a", "b", "c"):
        p = _protos(spark, d, v).select("class_idx", F.lit(v).alias("variant"),
                                         F.posexplode("vec").alias("dim", "x"))
        out = p if out is None else out.unionByName(p)
    return out.select("class_idx", "variant", F.col("dim").cast("bigint").alias("dim"), _r("x").alias("x"))


@register("e4_scaled_logits")
def e4_scaled_logits(spark, d):
    return _class_scores(spark, d).select("image_id", "class_idx", _r("logit").alias("logit"))


@register("e5_softmax")
def e5_softmax(spark, d):
    return _probs(spark, d).select("image_id", "class_idx", _r("prob").alias("prob"))


@register("e5_predictions")
def e5_predictions(spark, d):
    return _preds(spark, d).select("image_id", "pred", _r("confidence").alias("confidence"), "target")


@register("e6_topk_classes")
def e6_topk_classes(spark, d):
    im = S.l2_normalize(views.test_images(spark, d).select("image_id", "vec"))
    t = Z.topk_classes(im, _protos(spark, d), 5)
    return t.select("image_id", "rank", "class_idx")


@register("e7_text_to_image")
def e7_text_to_image(spark, d):
    r = Z.retrieval_list(views.txt(spark, d), views.img(spark, d), 5, "text_id", "image_id")
    return r.select("text_id", "rank", "image_id", _r("score").alias("score"))


@register("e8_image_to_text")
def e8_image_to_text(spark, d):
    r = Z.retrieval_list(views.img(spark, d), views.txt(spark, d), 5, "image_id", "text_id")
    return r.select("image_id", "rank", "text_id", _r("score").alias("score"))


@register("e7_text_to_image_pruned")
def e7_text_to_image_pruned(spark, d):
    r = Z.retrieval_list(views.txt(spark, d), views.img(spark, d), 5, "text_id", "image_id", prune=True)
    return r.select("text_id", "rank", "image_id", _r("score").alias("score"))


@register("e8_image_to_text_pruned")
def e8_image_to_text_pruned(spark, d):
    r = Z.retrieval_list(views.img(spark, d), views.txt(spark, d), 5, "image_id", "text_id", prune=True)
    return r.select("image_id", "rank", "text_id", _r("score").alias("score"))


@register("e12_topk_accuracy")
def e12_topk_accuracy(spark, d):
    acc = Z.topk_accuracy(ST.true_ranks(_states(spark, d)), views.test_images(spark, d), ks=(1, 5, 10))
    return acc.select("k", _r("accuracy").alias("accuracy"))


@register("e13_class_subset")
def e13_class_subset(spark, d):
    sub = spark.createDataFrame(list(enumerate(SUBSET_CLASSES)), "pos bigint, class_idx bigint")
    im, pr = Z.class_subset(views.test_images(spark, d), _protos(spark, d), sub)
    acc = Z.subset_accuracy(ST.true_ranks(ST.class_states(im, pr, scale=100.0)), im, len(SUBSET_CLASSES))
    return acc.select(_r("accuracy").alias("accuracy"), "n_images")


def _lang_of_vec(spark, d):
    return views.documents(spark, d).select(F.col("doc_id").alias("vec_id"), F.col("lang"))


PROMPT_SETS = ["ensemble", "label"]


def _sweep_inputs(spark, d):
    """Prompt sets per language: ``ensemble`` = every prompt of the class,
    ``label`` = one prompt per class (its first), as with the bare class
    name template.  Every image is evaluated under every prompt set."""
    lang = _lang_of_vec(spark, d)
    ens = views.prompts(spark, d).join(lang.withColumnRenamed("vec_id", "prompt_id"), "prompt_id") \
                                 .withColumn("prompt_set", F.lit("ensemble"))
    first = (ens.groupBy("lang", "class_idx")
                .agg(F.min_by(F.struct("prompt_id", "vec"), "prompt_id").alias("p"))
                .select("lang", "class_idx", "p.prompt_id", "p.vec", F.lit("label").alias("prompt_set")))
    pr = ens.unionByName(first)
    im = views.test_images(spark, d).join(lang.withColumnRenamed("vec_id", "image_id"), "image_id") \
                                    .withColumn("prompt_set", F.explode(F.array(*[F.lit(x) for x in PROMPT_SETS])))
    return im, pr


@register("e14_sweep_accuracy")
def e14_sweep_accuracy(spark, d):
    im, pr = _sweep_inputs(spark, d)
    g = ["lang", "prompt_set"]
    protos = Z.class_prototypes(pr, "a", group_cols=g)
    ranks = ST.true_ranks(ST.class_states(im, protos, scale=100.0, group_cols=g), group_cols=g)
    acc = Z.topk_accuracy(ranks, im, ks=(1, 5), group_cols=g)
    return acc.select("lang", "prompt_set", "k", _r("accuracy").alias("accuracy"))


@register("e14_sweep_skipped")
def e14_sweep_skipped(spark, d):
    _, pr = _sweep_inputs(spark, d)
    req = spark.createDataFrame([(l, ps) for l in SWEEP_LANGS for ps in PROMPT_SETS], "lang string, prompt_set string")
    return Z.sweep_missing(req, pr, ["lang", "prompt_set"])


@register("e15_vocabulary")
def e15_vocabulary(spark, d):
    rows = global_index(views.turns(spark, d).select("conv_id", "turn", "role"), ["conv_id", "turn"], col="pos")
    return Z.vocabulary_last_wins(rows, "conv_id", "role", "pos").select("class_id", "name", "first_pos")


@register("e16_gather")
def e16_gather(spark, d):
    lab = views.table(spark, d, "labels").select("doc_id")
    index = global_index(lab, [F.desc("doc_id")], col="pos").select("pos", F.col("doc_id").alias("idx"))
    rows = views.documents(spark, d).select(F.col("doc_id").alias("row_idx"), "lang")
    return Z.gather(rows, index).select("pos", F.col("row_idx").alias("doc_id"), "lang")


@register("e17_multi_hot")
def e17_multi_hot(spark, d):
    obj = views.objects(spark, d)
    classes = global_index(obj.select("class_name").distinct(), ["class_name"], col="class_idx")
    return Z.multi_hot(obj, obj, classes)


# ---------------------------------------------------------------- F: metrics

@register("f1_accuracy")
def f1_accuracy(spark, d):
    return M.accuracy(_preds(spark, d)).select(_r("accuracy").alias("accuracy"))


@register("f2_mean_per_class")
def f2_mean_per_class(spark, d):
    return M.mean_per_class(_preds(spark, d)).select(_r("mean_per_class").alias("mean_per_class"))


def _map(spark, d, probs=None):
    probs = probs if probs is not None else _probs(spark, d)
    # the score rows carry is_pos (class = target): labels need no join
    marked = probs.withColumn("present", F.col("is_pos").cast("int"))
    # ranked on the log-softmax: the order of the probabilities the reference passes
    return M.map_11_point(marked, score="log_prob")


@register("f3_map_11_point")
def f3_map_11_point(spark, d):
    return _map(spark, d).select(_r("map").alias("map"), "classes")


@register("f4_roc_auc")
def f4_roc_auc(spark, d):
    return M.roc_auc(views.bin_scores(spark, d)).select(_r("auc").alias("auc"))


DATASETS = sorted(M.DATASET_METRIC)
BINARY_EVERY = 3     # every third document belongs to the binary task


def _dataset_of(vec_id):
    """The dataset of a vector: blocks of one prompt and its images go round the datasets."""
    names = F.array(*map(F.lit, DATASETS))
    return F.get(names, F.pmod(F.floor(F.col(vec_id) / views.PROMPT_EVERY), F.lit(len(DATASETS))).cast("int"))


@register("f5_metric_dispatch")
def f5_metric_dispatch(spark, d):
    """The metric that its metadata names, of every dataset, over that dataset's images, classes and scores."""
    g = ["dataset"]
    meta = reliable_checkpoint(M.metadata_table(spark, DATASETS))
    wants = lambda df, metric: df.join(F.broadcast(meta.filter(F.col("metric") == metric).select("dataset")), "dataset", "left_semi")
    im = views.test_images(spark, d).withColumn("dataset", _dataset_of("image_id"))
    protos = reliable_checkpoint(Z.class_prototypes(views.prompts(spark, d).withColumn("dataset", _dataset_of("prompt_id")), "a", group_cols=g))
    preds = reliable_checkpoint(ST.predictions(ST.class_states(im, protos, scale=100.0, group_cols=g), group_cols=g))
    metric = "11point_mAP"
    scores = Z.class_scores(wants(im, metric), wants(protos, metric), scale=100.0, group_cols=g, target="target")
    marked = Z.softmax(scores, group_cols=g).withColumn("present", F.col("is_pos").cast("int"))
    # the binary task: every BINARY_EVERY-th document
    name = next(n for n in DATASETS if M.DATASET_METRIC[n] == "roc_auc")
    binary = views.bin_scores(spark, d).filter(F.col("doc_id") % BINARY_EVERY == 0).withColumn("dataset", F.lit(name))
    computed = [("accuracy", "accuracy", M.accuracy(wants(preds, "accuracy"), group_cols=g)),
                ("mean-per-class", "mean_per_class", M.mean_per_class(wants(preds, "mean-per-class"), group_cols=g)),
                (metric, "map", M.map_11_point(marked, score="log_prob", group_cols=g)),
                ("roc_auc", "auc", M.roc_auc(binary, group_cols=g))]
    results = None
    for metric, column, frame in computed:
        one = frame.select("dataset", F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))
        results = one if results is None else results.unionByName(one)
    return M.dispatch(results, meta).select("dataset", "metric", _r("result").alias("result"))


@register("f6_dataset_registry")
def f6_dataset_registry(spark, d):
    """The registry of the datasets, with the classes and images they have, written and read back."""
    with scratch_folder(spark) as tmp:
        e = views.table(spark, d, "embeddings").select(
            _dataset_of("vec_id").alias("name"), "label", (F.col("vec_id") % views.PROMPT_EVERY == 0).alias("prompt"))
        images = lambda keep: F.struct(F.sum(keep.cast("bigint")).alias("num_images"))
        rows = (e.groupBy("name").agg(F.countDistinct("label").alias("num_classes"), images(F.col("prompt")).alias("train"),
                                      images(~F.col("prompt")).alias("test"))
                .withColumn("type", F.lit("classification")).withColumn("val", F.lit(None).cast("struct<num_images:bigint>")))
        FS.write_registry(rows, f"{tmp}/r")
        return reliable_checkpoint(FS.read_registry(spark, f"{tmp}/r"))


def _pairs(spark, d):
    i = views.pair_images(spark, d).withColumnRenamed("vec", "img_vec")
    t = views.pair_texts(spark, d).withColumnRenamed("vec", "txt_vec")
    return i.join(t, "pair_id").withColumn("batch_id", (F.col("pair_id") / views.PAIR_BATCH).cast("bigint"))


@register("f7_contrastive_loss")
def f7_contrastive_loss(spark, d):
    m = M.in_batch_metrics(_pairs(spark, d), scale=20.0)
    return m.select("batch_id", _r("loss").alias("loss"))


@register("f8_in_batch_accuracy")
def f8_in_batch_accuracy(spark, d):
    m = M.in_batch_metrics(_pairs(spark, d), scale=20.0)
    return m.select("batch_id", _r("acc_image").alias("acc_image"), _r("acc_text").alias("acc_text"))


@register("f9_classification_loss")
def f9_classification_loss(spark, d):
    r = ST.classification_loss(_states(spark, d), views.test_images(spark, d))
    return r.select(_r("loss").alias("loss"), _r("accuracy").alias("accuracy"))


@register("f10_run_summary")
def f10_run_summary(spark, d):
    res = views.documents(spark, d).select(F.col("lang").alias("model"), F.col("source").alias("dataset"),
                                           F.col("n_chars").cast("double").alias("value"))
    s = M.run_summary(res, baseline="en")
    return s.select("model", "dataset", _r("mean").alias("mean"), _r("std").alias("std"), "runs",
                    _r("diff").alias("diff"))


# ---------------------------------------------------------------- B: corpus construction

from corpusmill.functions import text as TX  # noqa: E402
from corpusmill.operators import corpus as CP  # noqa: E402
from corpusmill.operators import infer as INF  # noqa: E402
from corpusmill.operators import translation_memory as TM  # noqa: E402
from corpusmill.operators.indexing import chunk  # noqa: E402


def _conv_rows(spark, d):
    """Conversation turns numbered in file order (conv_id, turn)."""
    return global_index(views.turns(spark, d), ["conv_id", "turn"], col="row")


def _zipped(spark, d):
    conv = _conv_rows(spark, d)
    orig = conv.select(F.col("row").alias("pos"), F.col("conv_id").alias("image_id"), F.col("text").alias("caption"))
    t1 = conv.select(F.col("row").alias("pos"), F.col("conv_id").alias("image_id"), F.col("role").alias("caption"))
    t2 = views.transl(spark, d).select(F.col("row").alias("pos"), "caption")
    return CP.positional_zip(orig, t1, t2)


@register("b1_positional_zip")
def b1_positional_zip(spark, d):
    z = _zipped(spark, d)
    return z.select("pos", "image_id", F.length("en").cast("bigint").alias("en_len"), "pt1",
                    F.length("pt2").cast("bigint").alias("pt2_len"))


@register("b2_group_captions")
def b2_group_captions(spark, d):
    g = CP.group_captions(_zipped(spark, d))
    en = g.select("image_id", "image_order", F.lit("en").alias("lang"), F.posexplode("captions_en").alias("idx", "text"))
    pt = g.select("image_id", "image_order", F.lit("pt").alias("lang"), F.posexplode("captions_pt").alias("idx", "text"))
    return en.unionByName(pt).select("image_id", "image_order", "lang", F.col("idx").cast("bigint").alias("idx"),
                                     F.md5("text").alias("text_md5"))


@register("b3_split_translations")
def b3_split_translations(spark, d):
    docs = views.documents(spark, d)
    manifest = docs.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("filename"), F.col("source").alias("split"),
                           F.transform(TX.nonblank_lines("text"), lambda x: F.struct(x.alias("raw"))).alias("sentences"))
    conv = _conv_rows(spark, d)
    tr = conv.select("row", F.concat(F.lit("doc"), F.col("conv_id"), F.lit("#"), F.col("turn")).alias("image"),
                     F.col("text").alias("caption"))
    s = CP.split_with_translations(manifest, tr, "src1")
    en = s.select("image", F.lit("en").alias("lang"), F.posexplode_outer("captions_en").alias("idx", "text"))
    pt = s.select("image", F.lit("pt").alias("lang"), F.posexplode_outer("captions_pt").alias("idx", "text"))
    return en.unionByName(pt).select("image", "lang", F.col("idx").cast("bigint").alias("idx"),
                                     F.md5("text").alias("text_md5"))


@register("b4_select_split")
def b4_select_split(spark, d):
    rows = views.documents(spark, d).select(F.col("source").alias("split"),
                                            F.concat(F.lit("doc"), F.col("doc_id")).alias("filename"),
                                            F.col("text").alias("caption"))
    s = CP.select_split(rows, "src3")
    return s.select("image", F.md5(F.get("captions_pt", 0)).alias("caption_md5"),
                    F.size("captions_pt").cast("bigint").alias("n_pt"), F.size("captions_en").cast("bigint").alias("n_en"))


def _b5(spark, d):
    p = views.tsv_pages(spark, d)
    samples = p.select(F.concat(F.lpad((F.col("page_id") / 10000).cast("bigint").cast("string"), 5, "0"),
                                F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0")).alias("key"), "caption")
    t1 = views.transl(spark, d).select("row", "caption")
    t2 = views.table(spark, d, "benchmark").select(F.col("item_id").alias("row"), F.col("text").alias("caption"))
    return CP.insert_translations(samples, t1, t2)


@register("b5_insert_translations")
def b5_insert_translations(spark, d):
    ins, _ = _b5(spark, d)
    en = ins.select("key", F.lit("en").alias("lang"), F.posexplode("captions_en").alias("idx", "text"))
    pt = ins.select("key", F.lit("pt").alias("lang"), F.posexplode("captions_pt").alias("idx", "text"))
    return en.unionByName(pt).select("key", "lang", F.col("idx").cast("bigint").alias("idx"),
                                     F.md5("text").alias("text_md5"))


@register("b5_missing_rows")
def b5_missing_rows(spark, d):
    _, miss = _b5(spark, d)
    return miss.select("key", "row")


@register("b6_dedup_first")
def b6_dedup_first(spark, d):
    docs = views.documents(spark, d).select("doc_id", "text")
    return CP.dedup_keep_first(docs, "text", "doc_id").select("doc_id")


@register("b7_image_id")
def b7_image_id(spark, d):
    p = views.tsv_pages(spark, d)
    s = p.select(F.nullif(F.regexp_extract("url", r"/([0-9]+)$", 1), F.lit("")).alias("image"),
                 F.concat(F.lit("p"), F.col("page_id")).alias("key"), "page_id")
    return s.select("page_id", CP.image_id("image", "key").alias("image_id"))


def _b8(spark, d):
    s = views.caption_lists(spark, d).withColumnRenamed("captions", "generated_captions_en")
    return CP.explode_for_translation(s)


@register("b8_explode_for_translation")
def b8_explode_for_translation(spark, d):
    return _b8(spark, d).select("image", "pos", F.md5("caption").alias("caption_md5"))


@register("b9_partitioned_export")
def b9_partitioned_export(spark, d):
    e = global_index(_b8(spark, d), ["image", "pos"], col="idx")
    return chunk(e, "idx", 1000, "part").select("image", "pos", "idx", "part")


@register("b10_merge_translations")
def b10_merge_translations(spark, d):
    samples = views.documents(spark, d).select(F.col("doc_id").cast("string").alias("image"))
    conv = _conv_rows(spark, d)
    tr = conv.select("row", F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias("image"),
                     F.col("text").alias("translated_caption"))
    m = CP.merge_translations(samples, tr)
    return m.select("image", F.posexplode_outer("generated_captions_pt").alias("idx", "text")) \
            .select("image", F.col("idx").cast("bigint").alias("idx"), F.md5("text").alias("text_md5"))


@register("b11_quarantine")
def b11_quarantine(spark, d):
    p = views.tsv_pages(spark, d)
    good, bad = CP.quarantine(p, {"no_title": F.col("caption") != "",
                                  "junk_title": ~F.col("caption").rlike("[%*#]{3}")})
    return good.select("page_id", F.lit(None).cast("string").alias("reject_reason")) \
               .unionByName(bad.select("page_id", "reject_reason"))


@register("b12_union_datasets")
def b12_union_datasets(spark, d):
    u = CP.union_datasets({
        "documents": views.documents(spark, d).select(F.col("doc_id").alias("id"), "text", "lang"),
        "benchmark": views.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
    })
    return u.select("source", "id", F.length("text").cast("bigint").alias("n_chars"), "lang")


@register("b13_language_select")
def b13_language_select(spark, d):
    docs = views.documents(spark, d)
    m = docs.select("doc_id", F.create_map(F.col("lang"), TX.nonblank_lines("text")).alias("captions"))
    sel = m.select("doc_id", CP.captions_for_language("captions", "fr").alias("c"))
    return sel.select("doc_id", F.posexplode("c").alias("idx", "text")) \
              .select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.md5("text").alias("text_md5"))


@register("b14_translator_slice")
def b14_translator_slice(spark, d):
    lists = CP.ordered_list(views.turns(spark, d), "conv_id", "turn", "text", "captions_pt")
    s = lists.select("conv_id", CP.translator_slice(F.array().cast("array<string>"), "captions_pt", "pt",
                                                    "marian").alias("c"))
    return s.select("conv_id", F.posexplode("c").alias("idx", "text")) \
            .select("conv_id", F.col("idx").cast("bigint").alias("idx"), F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- C: inference plumbing

def _identity_captioner():
    # stands in for the captioning model: returns the image's own caption
    return lambda pdf: pdf["caption"].tolist()


def _identity_translator():
    return lambda s: s.tolist()


@register("c1_embed_column")
def c1_embed_column(spark, d):
    """Every document text embedded by a pluggable encoder in Arrow batches
    (a hashed bag-of-tokens stands in for the text model)."""
    docs = views.documents(spark, d).select("doc_id", "text")
    return INF.embed(docs, "text", lambda: INF.hashed_bow_encoder(64), cache_key="hashed_bow_64") \
              .filter(F.exists("vec", lambda x: x != 0)) \
              .select("doc_id", F.posexplode("vec").alias("dim", "x")) \
              .select("doc_id", F.col("dim").cast("bigint").alias("dim"), _r(F.col("x").cast("double")).alias("x"))


@register("c1_hashed_bow_native")
def c1_hashed_bow_native(spark, d):
    """The same test encoder written natively (explode, count per dimension,
    scatter, normalise); long form (doc_id, dim, x)."""
    docs = views.documents(spark, d).select("doc_id", "text")
    v = INF.hashed_bow(docs, "doc_id", "text", 64)
    return v.select("doc_id", F.posexplode("vec").alias("dim", "x")) \
            .select("doc_id", F.col("dim").cast("bigint").alias("dim"), _r("x").alias("x"))


@register("c2_caption_fanout")
def c2_caption_fanout(spark, d):
    imgs = views.tsv_pages(spark, d).select(F.col("page_id").alias("image"), "caption")
    out = INF.caption_fanout(imgs, _identity_captioner)
    return out.select("image", "prompt_idx", "caption")


@register("c2_caption_lists")
def c2_caption_lists(spark, d):
    """The fanned out captions regrouped into one list per image, in prompt order."""
    imgs = views.tsv_pages(spark, d).select(F.col("page_id").alias("image"), "caption")
    lists = INF.caption_lists(INF.caption_fanout(imgs, _identity_captioner), out="captions")
    return lists.select("image", F.size("captions").cast("bigint").alias("n"), F.md5(F.array_join("captions", "|")).alias("captions_md5"))


@register("c3_translate_memory")
def c3_translate_memory(spark, d):
    rows = views.turns(spark, d).select(F.concat_ws("_", "conv_id", "turn").alias("key"),
                                        F.col("text").alias("original_sentence"),
                                        F.lit("conversations").alias("dataset_name"))
    t = INF.translate(rows, _identity_translator)
    return t.select("key", F.md5("original_sentence").alias("original_md5"),
                    F.md5("translated_sentence").alias("translated_md5"), "dataset_name")


@register("c3_kept_memory")
def c3_kept_memory(spark, d):
    """All turns translated with a kept memory, after a run over the users' turns: whose run translated each."""
    rows = views.turns(spark, d).select(F.concat_ws("_", "conv_id", "turn").alias("key"), "role",
                                        F.col("text").alias("original_sentence"))
    with scratch_folder(spark) as path:
        memory = TM.open_memory(spark, path)
        try:
            TM.translate_kept(rows.filter("role = 'user'"), _identity_translator, memory, "users")
            t = TM.translate_kept(rows, _identity_translator, memory, "all", run_col="run")
            return reliable_checkpoint(t.select("key", F.md5("original_sentence").alias("original_md5"),
                                                F.md5("translated_sentence").alias("translated_md5"), "run"))
        finally:
            spark.sql(f"DROP TABLE {memory}")


@register("c4_masked_mean_pool")
def c4_masked_mean_pool(spark, d):
    tok = views.txt(spark, d).select(F.col("image_id").alias("id"), "pos",
                                     F.when(F.col("pos") < 4, 1).otherwise(0).alias("mask"), "vec")
    p = INF.masked_mean_pool(tok)
    return p.select("id", F.posexplode("vec").alias("dim", "x")) \
            .select("id", F.col("dim").cast("bigint").alias("dim"), _r("x").alias("x"))


# ---------------------------------------------------------------- A: sinks and profiling

SHARD_SIZE = 10_000   # fixed value: samples per shard
RESUMED_SHARD_SIZE = 500
PART_SIZE = 5_000


@register("a2_sharded_sink")
def a2_sharded_sink(spark, d):
    s = views.caption_lists(spark, d)
    e = global_index(s, ["image"], col="idx")
    return chunk(e, "idx", SHARD_SIZE, "shard").select("idx", "shard", TX.sample_key("idx").alias("key"), "image")


@register("a3_resume")
def a3_resume(spark, d):
    s = views.caption_lists(spark, d)
    written = views.table(spark, d, "labels").select(F.col("doc_id").alias("image"))
    todo = s.join(written, "image", "left_anti")
    e = global_index(todo, ["image"], col="idx", start=3 * SHARD_SIZE)
    return chunk(e, "idx", SHARD_SIZE, "shard").select("idx", "shard", TX.sample_key("idx").alias("key"), "image")


def _planned_samples(spark, d):
    lists = views.caption_lists(spark, d).select(F.col("image").alias("id"), F.col("image").cast("string").alias("image"), "captions")
    return SH.sample_json(lists, {"image": "image", "captions": "captions-pt"})


def _read_planned(spark, path, plan):
    """The samples of planned shards, with the shard's state in the ledger."""
    back = SH.read_shards(spark, path + "/{00000..%05d}.tar" % max(0, plan.pieces - 1), include_images=False)
    ok = reliable_checkpoint(SP.check_shards(spark, path).select(F.format_string("%05d.tar", "shard").alias("shard"), "ok"))
    return back.join(broadcast_if_small(ok), "shard", "left").select(
        "key", "shard", F.col("sample.image").alias("image"), F.size("sample.`captions-pt`").cast("bigint").alias("n_captions"), "ok")


@register("a2_planned_shards")
def a2_planned_shards(spark, d):
    """Every document's caption list in tar shards that a plan of the ids alone cuts; read back."""
    with scratch_folder(spark) as path:
        plan = SP.write_planned(_planned_samples(spark, d), path, "id", size=SHARD_SIZE)
        return reliable_checkpoint(_read_planned(spark, path, plan))


@register("a3_resumed_shards")
def a3_resumed_shards(spark, d):
    """As ``a2_planned_shards``, in two runs: one that may write every other shard only, and one that resumes."""
    with scratch_folder(spark) as path:
        samples = _planned_samples(spark, d)
        for only in (range(0, samples.count(), 2), None):
            plan = SP.write_planned(samples, path, "id", size=RESUMED_SHARD_SIZE, only=only)
        return reliable_checkpoint(_read_planned(spark, path, plan))


@register("b9_written_parts")
def b9_written_parts(spark, d):
    """The captions to translate, written in parts of fixed size and read back."""
    with scratch_folder(spark) as path:
        SP.write_parts(_b8(spark, d), f"{path}/p", ["image", "pos"], PART_SIZE)
        back = spark.read.parquet(f"{path}/p")
        return reliable_checkpoint(back.select("image", "pos", F.md5("caption").alias("caption_md5"), F.col("part").cast("bigint").alias("part")))


def _written_captions(spark, d, folder):
    """The page captions as a CSV of several part files in page order."""
    p = global_index(views.tsv_pages(spark, d), ["page_id"], col="record")
    lines = p.orderBy("record").select(FS.tsv_line(F.array("caption", "url"), sep=",").alias("value"))
    lines.write.text(folder)


@register("a4_translation_table")
def a4_translation_table(spark, d):
    """Every document as a record of a translation table, read back with its row."""
    with scratch_folder(spark) as tmp:
        rows = views.table(spark, d, "documents").select("doc_id", "text", "source")
        rows.orderBy("doc_id").select(FS.tsv_line(F.array("text", "source")).alias("value")).write.text(f"{tmp}/t")
        back = FS.read_translation_table(spark, f"{tmp}/t", "other")
        return reliable_checkpoint(back.select("row", F.md5("caption").alias("caption_md5"), "url"))


@register("a5_csv_to_tsv")
def a5_csv_to_tsv(spark, d):
    """The page captions, written as CSV, rewritten as TSV without the first 10 records."""
    with scratch_folder(spark) as tmp:
        _written_captions(spark, d, f"{tmp}/csv")
        FS.csv_to_tsv(spark, f"{tmp}/csv", f"{tmp}/tsv", skip=10, blank_line=True)
        back = FS.read_records(spark, f"{tmp}/tsv", sep="\t")
        return reliable_checkpoint(back.select((F.col("rec") + 10).alias("record"),
                                               F.coalesce(F.get("fields", F.lit(0)), F.lit("")).alias("col0")))


@register("a6_caption_url_export")
def a6_caption_url_export(spark, d):
    """Caption and URL of every page, exported and read back."""
    with scratch_folder(spark) as tmp:
        FS.export_caption_url(views.tsv_pages(spark, d), f"{tmp}/tsv")
        back = FS.read_delimited(spark, f"{tmp}/tsv", ["caption", "url"], "\t")
        return reliable_checkpoint(back.select(F.coalesce("caption", F.lit("")).alias("caption"), "url"))


MANIFEST_ITEMS = 1_000   # fixed value: items of a split in one manifest
FOLDER_FILE_ROWS = 200   # fixed value: pages in one file of a labelled folder


@register("a7_split_manifest")
def a7_split_manifest(spark, d):
    """Every document as an item of split-keyed manifests, many bounded ones per
    source, read back by split with its position among the source's items."""
    with scratch_folder(spark) as tmp:
        split = F.element_at(F.array(*map(F.lit, FS.SPLITS)), (F.col("doc_id") % 3 + 1).cast("int"))
        items = views.table(spark, d, "documents").select(
            "source", split.alias("split"), F.concat(F.lit("doc"), F.col("doc_id")).alias("filename"), F.col("text").alias("caption"))
        FS.write_split_keyed(items, f"{tmp}/m", MANIFEST_ITEMS)
        back = FS.read_split_keyed(spark, f"{tmp}/m", MANIFEST_ITEMS)
        return reliable_checkpoint(back.select("split", "pos", "filename", F.md5("caption").alias("caption_md5")))


@register("a7_coco_manifest")
def a7_coco_manifest(spark, d):
    """Every caption of every image as an annotation of COCO-style documents, one per partition, read back in
    splits; the captions of each image in the order of their annotations."""
    with scratch_folder(spark) as tmp:
        note = F.to_json(F.struct(F.col("image").alias("image_id"), F.col("text").alias("caption")))
        write_arrays(views.caps(spark, d).select(note.alias("element")), f"{tmp}/m", "annotations", head={"info": {"year": 2020}})
        back = FS.read_coco(spark, f"{tmp}/m")     # read by now, and checkpointed
    lists = CP.ordered_list(back, "image_id", "pos", "caption", "captions")
    return lists.select("image_id", F.size("captions").cast("bigint").alias("n_captions"),
                        F.md5(F.array_join("captions", "\n")).alias("captions_md5"))


@register("a7_karpathy_manifest")
def a7_karpathy_manifest(spark, d):
    """Every document as an image with its sentences in Karpathy-style documents, read back in splits."""
    with scratch_folder(spark) as tmp:
        split = F.element_at(F.array(*map(F.lit, ("train", "val", "test", "restval"))), (F.col("image") % 4 + 1).cast("int"))
        item = F.struct(F.concat(F.lpad(F.col("image").cast("string"), 12, "0"), F.lit(".jpg")).alias("filename"), split.alias("split"),
                        F.transform("captions", lambda x: F.struct(x.alias("raw"))).alias("sentences"))
        write_arrays(views.caption_lists(spark, d).select(F.to_json(item).alias("element")), f"{tmp}/m", "images",
                     head={"dataset": "documents"})
        back = FS.read_karpathy(spark, f"{tmp}/m")     # read by now, and checkpointed
    raws = F.coalesce(F.transform("sentences", lambda x: x["raw"]), F.array().cast("array<string>"))
    return back.select("filename", "split", F.size(raws).cast("bigint").alias("n_sentences"),
                       F.md5(F.array_join(raws, "\n")).alias("sentences_md5"))


@register("a8_labelled_folder")
def a8_labelled_folder(spark, d):
    """Pages written to one folder per domain ending, many files each; all of them scanned as labelled
    files, and every page found in its file with the file's class."""
    with scratch_folder(spark) as tmp:
        p = views.table(spark, d, "pages")
        kind = F.regexp_extract("url", r"\.(com|net|org)", 1)
        (p.select(kind.alias("kind"), F.col("page_id").cast("string").alias("value"))
         .write.option("maxRecordsPerFile", FOLDER_FILE_ROWS).partitionBy("kind").text(f"{tmp}/c"))
        found = FS.scan_labelled_folder(spark, f"{tmp}/c")
        # by file name alone: the two readers write the scheme of a path differently
        name = lambda path: F.substring_index(path, "/", -1)
        lines = (spark.read.option("recursiveFileLookup", "true").text(f"{tmp}/c")
                 .select(F.col("value").cast("bigint").alias("page_id"), F.col("_metadata.file_path").alias("in_path")))
        key = lambda path: F.concat_ws("/", F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1), name(path))
        back = lines.withColumn("f", key("in_path")).join(found.withColumn("f", key("path")).select("f", "class_name", "class_idx"), "f")
        return reliable_checkpoint(back.select("page_id", "class_name", "class_idx"))


@register("a9_split_list")
def a9_split_list(spark, d):
    """The ids of all labelled documents as a split list, read back."""
    with scratch_folder(spark) as tmp:
        views.table(spark, d, "labels").select(F.concat(F.lit("doc"), "doc_id", F.lit("  "), "quality").alias("value")).write.text(f"{tmp}/l")
        return reliable_checkpoint(FS.read_split_list(spark, f"{tmp}/l"))


@register("a10_metric_lines")
def a10_metric_lines(spark, d):
    """The lines the metrics sink appends for one run, read back."""
    with scratch_folder(spark) as tmp:
        FS.append_metrics(f5_metric_dispatch(spark, d), f"{tmp}/m", "run-1")
        back = spark.read.schema("id string, dataset string, metric string, result double").json(f"{tmp}/m")
        return reliable_checkpoint(back)


@register("a11_prediction_export")
def a11_prediction_export(spark, d):
    """The class probabilities of every image, exported and read back."""
    with scratch_folder(spark) as tmp:
        probs = _probs(spark, d)
        idx = global_index(views.test_images(spark, d).select("image_id"), ["image_id"], col="row_idx")
        FS.export_predictions(probs.join(idx, "image_id"), f"{tmp}/p", {"model": "test"})
        back = spark.read.schema("row_idx bigint, probs array<double>, model string").json(f"{tmp}/p")
        return reliable_checkpoint(back.select("row_idx", F.posexplode("probs").alias("pos", "prob"))
                                   .select("row_idx", F.col("pos").cast("bigint").alias("class_idx"), "prob"))


@register("a12_peek")
def a12_peek(spark, d):
    """The first 5 captions in (image, pos) order: a limit that is the feature."""
    c = views.caps(spark, d)
    return c.orderBy("image", "pos").limit(5).select("image", "pos", F.md5("text").alias("text_md5"))


@register("a12_duplicate_captions")
def a12_duplicate_captions(spark, d):
    """Captions repeated within an image after position 2 (third caption on)."""
    lists = views.caption_lists(spark, d)
    rest = lists.filter(F.size("captions") >= 3).select(
        "image", F.explode(F.slice("captions", 3, F.size("captions"))).alias("text"))
    g = rest.groupBy("image", "text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return g.select("image", F.md5("text").alias("text_md5"), "n")


@register("a1_shard_roundtrip")
def a1_shard_roundtrip(spark, d):
    """Every document's caption list written as tar shards by the A2 sink
    (exact numbering, 10,000 samples per shard) into the session's shared
    checkpoint folder, then read back through the A1 tar data source:
    (key, shard, image, n_captions) of the samples read."""
    import math

    lists = views.caption_lists(spark, d).select(F.col("image").cast("string").alias("image"), "captions")
    numbered = SH.number_samples(lists, ["image"], shard_size=SHARD_SIZE)
    numbered = SH.sample_json(numbered, {"image": "image", "captions": "captions-pt"})
    with scratch_folder(spark) as path:
        SH.write_shards(numbered, path)
        n = numbered.count()
        last = max(0, math.ceil(n / SHARD_SIZE) - 1)
        back = SH.read_shards(spark, path + "/{00000..%05d}.tar" % last, include_images=False)
        return reliable_checkpoint(back.select("key", "shard", F.col("sample.image").alias("image"),
                                               F.size("sample.`captions-pt`").cast("bigint").alias("n_captions")))


INDEX_SPLIT_BYTES = 4 << 20   # fixed value: bytes of a tar that one task fetches


@register("a1_indexed_shards")
def a1_indexed_shards(spark, d):
    """As ``a2_planned_shards``, read back through an index of the shards, every shard by several tasks."""
    with scratch_folder(spark) as path:
        plan = SP.write_planned(_planned_samples(spark, d), path, "id", size=SHARD_SIZE)
        pattern = "::".join(f"{path}/{i:05d}.tar" for i in range(plan.pieces))
        back = SI.fetch(SI.write_index(spark, pattern, f"{path}/index"), False, INDEX_SPLIT_BYTES)
        return reliable_checkpoint(back.select("key", "shard", F.col("sample.image").alias("image"),
                                               F.size("sample.`captions-pt`").cast("bigint").alias("n_captions")))

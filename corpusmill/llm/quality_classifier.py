"""Quality classifier with hierarchical empirical Bayes over sites.

1. *Document features.*  One pass over the texts keeps a few numbers and the set of hashed words of
   each (``BUCKETS`` buckets, two bytes each), so texts are neither read twice nor shuffled.
2. *Document evidence.*  A multinomial over hashed words is counted for the good and for the bad labelled
   documents, by grouped sums; a document's word score is the mean log ratio of its words.  Labelled
   documents are dealt to ``FOLDS`` folds and scored by the other folds' counts, so that no document
   vouches for itself; an unlabelled one gets the mean over the folds.  The word score and seven shares of
   the text are binned, and naive Bayes adds up, per feature, the log ratio of the bin's shares
   among good and among bad labelled documents.
3. *Site evidence.*  The classifier gives every document a probability of being good;
   a labelled document counts with its label instead.  These are summed up per host
   and per path of a host.
4. *Shrinking.*  A host's posterior is a Beta mean with the corpus rate as its prior, a
   path's with its host's posterior as its prior.  The strength of either prior (in
   documents) is estimated from all groups by the method of moments: the variance
   between groups beyond what chance gives within them.  A probability p instead of a 0 or 1 varies less
   by p (1 - p), which is taken off the chance.  A site with few documents
   stays near its prior, one with many goes its own way.
5. *Combination.*  ``logit = classifier logit + logit(path posterior) - logit(corpus
   rate)``, so the site replaces the corpus rate as the prior of the document.

All sums are grouped aggregations with map-side partial sums.  Labels are joined to the rows of
features by id; posteriors are joined by host and path, by a broadcast for paths that many rows share.
The word model (FOLDS x BUCKETS numbers) and the bins go through the driver.

Cases: a null or blank text has its own bin in every feature.  A null host or path is a
group of its own.  Without labels of both kinds the classifier is silent and every
probability is the corpus rate (0.5 without labels).  Repeated labels of an id count
by their mean, repeated rows are judged alike, and rows with a null id have no
label.  A score that equals ``threshold`` is kept.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, ready
from corpusmill.llm.joins import join_back

SMOOTHING = 1.0
THRESHOLD = 0.5
#: Buckets of hashed words, and folds of the labelled documents.
BUCKETS = 1 << 16
FOLDS = 2
#: Words whose buckets a worker remembers.
CACHE_WORDS = 1 << 19
#: Strength of a prior, in documents, when the groups show no spread beyond chance.
MAX_STRENGTH = 1e6

#: Edges of the bins of each feature.
EDGES = {
    "words": [-1.0, -0.5, -0.25, -0.1, 0.0, 0.1, 0.25, 0.5, 1.0],
    "symbols": [0.0, 0.005, 0.02, 0.05, 0.1],
    "capitals": [0.01, 0.03, 0.06, 0.12, 0.3, 0.6],
    "digits": [0.0, 0.005, 0.02, 0.08],
    "stops": [0.0, 0.02, 0.05, 0.1, 0.2, 0.5],
    "distinct": [0.2, 0.35, 0.5, 0.65, 0.8, 0.95],
    "length": [0, 5, 20, 50, 200, 1000],
    "word": [4, 5, 6, 7, 8, 10],
}
_SHARES = [name for name in EDGES if name != "words"]
_SYMBOLS, _DIGITS, _STOPS = b"#*$%&|<>!", b"0123456789", b".!?"
_ASCII = bytes(range(128))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_buckets: dict[bytes, int] = {}


def shares(text: bytes) -> list:
    """The features of a text but its word score, None where there is no whole to take a share of."""
    words = text.split()
    beyond = "".join(_BEYOND.findall(text.decode())) if not text.isascii() else ""
    count = lambda chars: len(text) - len(text.translate(None, chars))
    chars = count(_ASCII) + len(beyond)
    letters = count(_LETTERS) + sum(map(str.isalpha, beyond))
    share = lambda part, whole: part / whole if whole else None
    return [share(count(_SYMBOLS), chars), share(count(_UPPER) + sum(map(str.isupper, beyond)), letters),
            share(count(_DIGITS), chars), share(count(_STOPS), len(words)), share(len(set(words)), len(words)),
            float(len(words)), share(chars, len(words))]


def word_buckets(text: bytes) -> np.ndarray:
    """Ascending buckets of the distinct lower-cased words."""
    words = set(text.lower().split())
    if len(_buckets) > CACHE_WORDS:
        _buckets.clear()
    for w in words.difference(_buckets):
        _buckets[w] = xxhash.xxh3_64_intdigest(w) % BUCKETS
    return np.unique(np.fromiter(map(_buckets.__getitem__, words), "<u2", len(words)))


def _described(batches):
    for rb in batches:
        texts = [t or b"" for t in rb.column("text").to_pylist()]
        cols = list(zip(*map(shares, texts))) if texts else [[]] * len(_SHARES)
        yield pa.RecordBatch.from_arrays(
            [*[rb.column(c) for c in ("doc_id", "host", "path")], *[pa.array(c, pa.float64()) for c in cols],
             pa.array([word_buckets(t).tobytes() for t in texts], pa.binary())],
            ["doc_id", "host", "path", *_SHARES, "buckets"])


def features(src: DataFrame) -> DataFrame:
    """``doc_id, host, path``, the shares and the hashed words of each row of ``doc_id, host, path, text``."""
    return src.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        _described, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, host string, path string, "
        + ", ".join(f"{c} double" for c in _SHARES) + ", buckets binary")


def word_model(rows: DataFrame) -> np.ndarray | None:
    """Log ratio of every bucket, per fold from the labelled rows of the other folds; None without both kinds."""
    def partial(batches):
        sums = np.zeros((FOLDS, 2, BUCKETS))
        for rb in batches:
            for data, fold, label in zip(rb.column(0), rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                at = np.frombuffer(data.as_buffer(), "<u2")
                sums[fold, 0, at] += label
                sums[fold, 1, at] += 1 - label
        fold, bucket = np.nonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(bucket, pa.int32()),
                                          pa.array(sums[fold, 0, bucket]), pa.array(sums[fold, 1, bucket])],
                                         ["fold", "bucket", "good", "bad"])

    labelled = rows.filter("label is not null").select("buckets", "fold", "label")
    found = (labelled.mapInArrow(partial, "fold int, bucket int, good double, bad double")
             .groupBy("fold", "bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow())
    sums = np.zeros((FOLDS, 2, BUCKETS))
    for i, name in enumerate(("good", "bad")):
        sums[found.column("fold").to_numpy(), i, found.column("bucket").to_numpy()] = found.column(name).to_numpy()
    others = sums.sum(axis=0) - sums
    if not others.sum(axis=2).all():
        return None
    p = (others + SMOOTHING) / (others.sum(axis=2, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(p[:, 0] / p[:, 1])


def _word_scored(rows: DataFrame, model: np.ndarray | None) -> DataFrame:
    """``rows`` with the word score ``words`` (null without words or a model) in place of ``buckets``."""
    if model is None:
        return rows.withColumn("words", F.lit(None).cast("double")).drop("buckets")
    shared = rows.sparkSession.sparkContext.broadcast(np.vstack([model, model.mean(axis=0)]))

    def scored(batches):
        for rb in batches:
            out = []
            for data, fold, label in zip(rb.column("buckets"), rb.column("fold").to_pylist(), rb.column("label").to_pylist()):
                at = np.frombuffer(data.as_buffer(), "<u2")
                out.append(float(shared.value[FOLDS if label is None else fold][at].mean()) if len(at) else None)
            keep = [c for c in rb.schema.names if c != "buckets"]
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in keep], pa.array(out, pa.float64())], [*keep, "words"])

    kept = rows.drop("buckets").schema
    return rows.mapInArrow(scored, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", words double")


def binned(name: str) -> Column:
    """Bin number of a feature among its edges; -1 if it is null."""
    edges = EDGES[name]
    return F.when(F.col(name).isNull(), -1).otherwise(sum((F.when(F.col(name) > e, 1).otherwise(0) for e in edges), F.lit(0)))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(q / (1 - q))


def _weights(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row: ``base`` (log odds of the labels) and ``w``, the log ratio of every bin."""
    long = (rows.filter("label is not null")
            .select("label", F.explode(F.array(*[F.concat_ws(":", F.lit(n), F.col(n)) for n in names])).alias("bin")))
    tot = rows.agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).select(
        F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad"))
    per = long.groupBy("bin").agg(F.sum("label").alias("g"), F.sum(1 - F.col("label")).alias("b"))
    # one row per bin: a fixed number
    table = per.agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("g", "b")))).alias("bins"))
    ratio = lambda _, v: F.log((v["g"] + SMOOTHING) / (F.col("good") + SMOOTHING)
                               / ((v["b"] + SMOOTHING) / (F.col("bad") + SMOOTHING)))
    both = (F.col("good") > 0) & (F.col("bad") > 0)
    return tot.withColumn("bins", table.scalar()).select(
        F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad"))).otherwise(0.5).alias("rate"),
        F.when(both, F.transform_values("bins", ratio)).alias("w"))


def _posterior(groups: DataFrame, prior: str, out: str) -> DataFrame:
    """``groups`` (``n``, ``s``, ``u``: documents, their summed goodness p and summed p (1 - p), and a
    ``prior``) with the posterior mean ``out``.  The prior's strength is that of a Beta whose variance is
    the spread of the group means around their priors beyond chance."""
    dev = (F.col("s") / F.col("n") - F.col(prior)) ** 2
    v = F.col(prior) * (1 - F.col(prior))
    chance = F.greatest(F.lit(0.0), v - F.col("u") / F.col("n"))
    m = groups.agg(F.sum(F.col("n") * dev).alias("dev"), F.sum(chance).alias("chance"),
                   F.sum((F.col("n") - 1) * v).alias("room"))
    # E[n dev] = v (n - 1) r + chance, r = 1 / (strength + 1) the share of variance between groups
    r = F.greatest(F.lit(1 / (MAX_STRENGTH + 1)), F.least(F.lit(0.999), F.coalesce(
        (F.col("dev") - F.col("chance")) / F.nullif(F.col("room"), F.lit(0.0)), F.lit(0.0))))
    strength = m.select(((1 - r) / r).alias("k")).scalar()
    with_k = groups.withColumn("_k", strength)
    return with_k.withColumn(out, (F.col("s") + F.col("_k") * F.col(prior)) / (F.col("n") + F.col("_k"))).drop("_k")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host: Column | None = None, path: Column | None = None, label_id: str = "doc_id",
             label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, host, path, doc_prob, host_post, path_post, score, kept`` per row of ``docs``."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    names = list(EDGES)
    src = ready(docs).select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                             F.col(text_col).cast("string").alias("text"))
    given = (labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(label_id).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label")))
    # by a shuffle at every size: labels grow with the documents
    known = cut(features(src).join(given.hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
                .withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")))
    # a few numbers a row from here on
    rows = cut(_word_scored(known, word_model(known)).select(
        "doc_id", "host", "path", "label", *[binned(n).alias(n) for n in names]))
    model = cut(_weights(rows, names))
    one = model.select(F.struct("rate", "w").alias("m")).scalar()
    scored = rows.withColumn("_m", one)
    evidence = sum((F.coalesce(F.try_element_at(F.col("_m.w"), F.concat_ws(":", F.lit(n), F.col(n))), F.lit(0.0))
                    for n in names), F.lit(0.0))
    scored = (scored.withColumn("rate", F.col("_m.rate")).withColumn("evidence", evidence)
              .withColumn("doc_prob", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("rate"))))))
              .select("doc_id", "host", "path", "label", "rate", "evidence", "doc_prob"))
    soft = F.coalesce("label", "doc_prob")
    per_path = cut(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(soft).alias("s"), F.sum(soft * (1 - soft)).alias("u")))
    corpus = per_path.agg((F.sum("s") / F.sum("n")).alias("p"))
    per_host = (per_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("u").alias("u"))
                .withColumn("prior", corpus.scalar()))
    hosts = _posterior(cut(per_host), "prior", "host_post").select(F.col("host").alias("_h"), "host_post", F.col("prior").alias("corpus"))
    paths = cut(_posterior(cut(per_path.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")), "host_post", "path_post"))
    total = paths.agg(F.sum("n")).first()[0] or 0
    logit = F.col("evidence") + _logit(F.col("rate")) + _logit(F.col("path_post")) - _logit(F.col("corpus"))
    return (join_back(scored, paths.select("host", "path", "n", "host_post", "path_post", "corpus"), ["host", "path"], "n", total)
            .withColumn("score", 1 / (1 + F.exp(-logit)))
            .withColumn("kept", F.col("score") >= threshold)
            .select("doc_id", "host", "path", "doc_prob", "host_post", "path_post", "score", "kept"))

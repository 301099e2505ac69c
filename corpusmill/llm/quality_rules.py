"""Quality rules: counted base rules plus a hashed n-gram likelihood ratio.

Every text is a bag of hashed word unigrams and bigrams.  Two multinomials over
the hash buckets are counted, one of the trusted documents and one of the whole
corpus, both smoothed with a prior mass in proportion to their n-grams, so that scores mean
the same however large the corpus grows.  A small trusted corpus has not met most good words,
so there is a least mass a bucket, which keeps the scores of good documents near 0.  A document's score is the mean over its n-grams of
``ln p_trusted(bucket) - ln p_corpus(bucket)``, so it does not depend on the
length.  Every document with ``score < threshold`` is rejected, as is every one
that fails a base rule.

Only DataFrame functions are used.  Counting explodes n-grams into a map-side
combined sum per bucket; scoring reads the bucket weights (``BUCKETS`` doubles, a
fixed size) from a scalar subquery and stays within the row, so no text is
shuffled.

Cases: a null text has no words; a text without words has all counts 0, score 0
and fails the base rule.  Without trusted documents every score is 0.  Repeated
rows are judged alike, each on its own row.  Rows with a null id are judged, but
are never trusted.  Hash equality stands for equality of 8-word windows (64 bits,
within one text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Prior mass of both multinomials: this share of the trusted n-grams, ...
PRIOR_SHARE = 0.25
#: ... and at least so many expected n-grams a bucket.
LEAST_PRIOR = 10.0
THRESHOLD = -0.10
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Ids of trusted documents are broadcast up to this number (8 bytes each), and
#: joined by a shuffle beyond it.
BROADCAST_IDS = 2_000_000


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _repeat_words(h: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more; ``h``: the
    hash of each word."""
    def covered(wh):
        pairs = F.array_sort(F.transform(wh, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s):
            def twice(x, k):
                return ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def total(p):
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                               F.lit(0).cast("bigint"), lambda a, x: a + x)
        return _let(_let(pairs, repeated), total)

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                          lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
    counted = _let(windows, lambda wh: F.when(F.size(F.array_distinct(wh)) < F.size(wh), covered(wh)))
    return F.when(F.size(h) > WINDOW, F.coalesce(counted, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def grams(h: Column, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of a text with word hashes ``h``."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.transform(F.sequence(F.lit(1), F.size(h) - 1),
                      lambda i: F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(buckets)).cast("int"))
    return F.when(F.size(h) > 1, F.concat(one, two)).otherwise(one)


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with the words of its column ``text`` and their hashes."""
    return (df.withColumn("words", words(F.col("text").cast("string")))
            .withColumn("h", F.transform("words", lambda w: F.xxhash64(w))))


def bucket_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   buckets: int = BUCKETS, prior_share: float = PRIOR_SHARE,
                   least_prior: float = LEAST_PRIOR) -> DataFrame:
    """One row, ``weights array<double>``: the log ratio of every bucket.
    ``trusted`` has the ids of the trusted documents in its first column."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).filter("_id is not null").distinct()
    few = ids.count() <= BROADCAST_IDS
    flagged = (docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
               .join(F.broadcast(ids) if few else ids, F.col("_doc") == F.col("_id"), "left"))
    gram = (_hashed(flagged)
            .select(F.col("_id").isNotNull().cast("bigint").alias("t"), F.explode(grams(F.col("h"), buckets)).alias("b")))
    counts = gram.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("tgt"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").fillna(0, ["raw", "tgt"])
    one = full.agg(F.sum("raw").alias("R"), F.sum("tgt").alias("T"),
                   F.array_sort(F.collect_list(F.struct("b", "raw", "tgt"))).alias("c"))
    # the same prior mass in proportion to either corpus, so the totals cancel
    prior = F.greatest(F.lit(least_prior), F.col("T") * prior_share / buckets)
    ratio = F.transform("c", lambda x: F.log((x["tgt"] + prior) / (x["raw"] * F.col("T") / F.col("R") + prior)))
    return one.select(F.when(F.col("T") > 0, ratio).otherwise(
        F.transform("c", lambda x: F.lit(0.0))).alias("weights"))


def judge(docs: DataFrame, weights: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
          buckets: int = BUCKETS) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``) and ``rules`` (a struct of
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept) per row of ``docs``.  Spark copies deterministic expressions into a later filter, and would
    copy the word hashes into every step of the rules' loops; a row number that is
    filtered here keeps every later filter, join and aggregate above the rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    score = _let(grams(F.col("h"), buckets), lambda f: F.when(F.size(f) > 0, F.aggregate(
        f, F.lit(0.0), lambda s, b: s + F.get(F.col("w"), b)) / F.size(f)).otherwise(F.lit(0.0)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    counted = (_hashed(packed).withColumn("w", weights.scalar())
               .withColumn("score", score)
               .withColumn("rep", _repeat_words(F.col("h")))
               .withColumn("n", F.size("h").cast("bigint"))
               .withColumn("failed", (F.col("n") < MIN_WORDS) | (100 * F.col("rep") > MAX_REPEAT_PERCENT * F.col("n"))))
    return counted.select("row", F.struct(
        F.col("n").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.col("rep").alias("n_repeat_words"), F.col("failed").alias("base_failed"), "score",
        (~F.col("failed") & (F.col("score") >= threshold)).alias("kept")).alias("rules"),
        F.monotonically_increasing_id().alias("place")).filter("place >= 0").drop("place")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, the base counts, ``base_failed``, ``kept`` and
    ``score``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = judge(src, bucket_weights(src, trusted), threshold=threshold)
    return out.select("row.doc_id", *[f"rules.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    weights = bucket_weights(docs, trusted, id_col, text_col)
    return judge(docs, weights, text_col).filter("rules.kept").select("row.*")

"""Bindings of the driver's test tables to the inputs the operators expect.

These only shape rows into the schemas of the reference's inputs (image and
caption embeddings, caption lists, translation files, label tables).  They do
none of the operators' work.  Every binding reads whole tables; the integer
tests on ``vec_id`` assign a role to each row (image or caption, prompt or
test image) and keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as TX
from corpusmill.operators.partitioning import spread

# Fixed values of the bindings (see the survey's binding table).
CAPTIONS_PER_GROUP = 6      # vec_id % 6 == 0 is an image, the next five its captions
PROMPT_EVERY = 5            # vec_id % 5 == 0 is a class-prompt vector
PAIR_BATCH = 50             # pairs per in-batch evaluation batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def img(spark, sf_dir) -> DataFrame:
    """(image_id, vec): image embeddings."""
    e = _emb(spark, sf_dir)
    return e.filter(F.col("vec_id") % CAPTIONS_PER_GROUP == 0).select(
        (F.col("vec_id") / CAPTIONS_PER_GROUP).cast("bigint").alias("image_id"), "vec")


def txt(spark, sf_dir) -> DataFrame:
    """(text_id, image_id, pos, vec): caption embeddings, ``pos`` 0-based."""
    e = _emb(spark, sf_dir)
    return e.filter(F.col("vec_id") % CAPTIONS_PER_GROUP != 0).select(
        F.col("vec_id").alias("text_id"),
        (F.col("vec_id") / CAPTIONS_PER_GROUP).cast("bigint").alias("image_id"),
        (F.col("vec_id") % CAPTIONS_PER_GROUP - 1).cast("bigint").alias("pos"), "vec")


def pair_images(spark, sf_dir) -> DataFrame:
    e = _emb(spark, sf_dir)
    return e.filter(F.col("vec_id") % 2 == 0).select(
        (F.col("vec_id") / 2).cast("bigint").alias("pair_id"), "vec")


def pair_texts(spark, sf_dir) -> DataFrame:
    e = _emb(spark, sf_dir)
    return e.filter(F.col("vec_id") % 2 == 1).select(
        (F.col("vec_id") / 2).cast("bigint").alias("pair_id"), "vec")


def prompts(spark, sf_dir) -> DataFrame:
    """(prompt_id, class_idx, vec): prompt vectors of each class."""
    e = _emb(spark, sf_dir)
    return e.filter(F.col("vec_id") % PROMPT_EVERY == 0).select(
        F.col("vec_id").alias("prompt_id"), F.col("label").cast("bigint").alias("class_idx"), "vec")


def test_images(spark, sf_dir) -> DataFrame:
    """(image_id, target, vec): images to classify."""
    e = _emb(spark, sf_dir)
    return e.filter(F.col("vec_id") % PROMPT_EVERY != 0).select(
        F.col("vec_id").alias("image_id"), F.col("label").cast("bigint").alias("target"), "vec")


def documents(spark, sf_dir) -> DataFrame:
    """The documents, spread over the cluster before any per-row text work."""
    return spread(table(spark, sf_dir, "documents"))


def caps(spark, sf_dir) -> DataFrame:
    """(image, pos, text, n_captions): every non-empty line of every
    document is a caption of image ``doc_id``; ``pos`` 0-based among the
    kept lines; ``n_captions`` the length of the image's caption list."""
    d = documents(spark, sf_dir)
    lines = TX.nonblank_lines("text")
    return d.select(F.col("doc_id").alias("image"), F.size(lines).cast("bigint").alias("n_captions"),
                    F.posexplode(lines).alias("pos", "text")
                    ).select("image", F.col("pos").cast("bigint").alias("pos"), "text", "n_captions")


def caption_lists(spark, sf_dir) -> DataFrame:
    """(image, captions array<string>): the caption list per image."""
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("image"), TX.nonblank_lines("text").alias("captions"))


def transl(spark, sf_dir) -> DataFrame:
    """Positional translation file: (row, key, caption); row number = doc_id."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("row"),
        F.concat(F.lpad((F.col("doc_id") / 10000).cast("bigint").cast("string"), 5, "0"),
                 F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")).alias("key"),
        F.col("text").alias("caption"))


def turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def bin_scores(spark, sf_dir) -> DataFrame:
    """(doc_id, label, score): quality label with n_chars as the score."""
    l = table(spark, sf_dir, "labels")
    d = documents(spark, sf_dir).select("doc_id", "n_chars")
    return l.join(d, "doc_id").select("doc_id", F.col("quality").alias("label"),
                                      F.col("n_chars").cast("double").alias("score"))


def objects(spark, sf_dir) -> DataFrame:
    """(image, class_name): objects seen per image (user = image, event type = class)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("image"),
                                                 F.col("event_type").alias("class_name"))


def tsv_pages(spark, sf_dir) -> DataFrame:
    """(page_id, url, caption): page title as the caption."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url",
                    F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("caption"))


def caption_embeddings(spark, sf_dir) -> DataFrame:
    """(text_id, image_id, pos, text, vec): caption vectors with their text
    (the document whose doc_id equals the caption's vec_id).  Positions 0-1
    stand for the original captions, 2-4 for generated ones."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "text")
    return txt(spark, sf_dir).join(d, "text_id", "left").select("text_id", "image_id", "pos", "text", "vec")


ORIGINAL_CAPTIONS = 2   # positions below this are original captions, the rest generated

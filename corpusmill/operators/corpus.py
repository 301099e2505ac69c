"""B: corpus construction - positional zips, ordered grouping, lookups, merges.

Array order never relies on shuffle order: every caption carries an explicit
position and lists are rebuilt with ``array_sort`` over (position, value)
structs.  Lists per sample are built with ``collect_list`` only at the end
(partial aggregation applies); the long form ``(image, lang, pos, text)`` is
the working shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as TX


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_str_array() -> Column:
    return F.array().cast("array<string>")


def ordered_list(df: DataFrame, key, order_cols, value: str, out: str) -> DataFrame:
    """``key -> [value ordered by order_cols]`` (ties must not exist)."""
    key = [key] if isinstance(key, str) else list(key)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    st = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)], F.col(value).alias("v"))
    return (df.groupBy(*key).agg(F.array_sort(F.collect_list(st)).alias("__l"))
              .select(*key, F.transform("__l", lambda x: x["v"]).alias(out)))


def explode_list(df: DataFrame, list_col: str, pos: str = "pos", value: str = "text",
                 keep=()) -> DataFrame:
    """Long form of a list column: one row per element with its 0-based position."""
    return df.select(*keep, F.posexplode(list_col).alias(pos, value)).withColumn(pos, F.col(pos).cast("bigint"))


# ---------------------------------------------------------------- B1 / B2

def positional_zip(orig: DataFrame, t1: DataFrame, t2: DataFrame | None = None) -> DataFrame:
    """B1: zip three annotation lists by position; stops at the shortest.

    ``orig``/``t1``: (pos, image_id, caption); ``t2``: (pos, caption).
    A row whose original and first translation disagree on ``image_id``
    fails the job ("Not synced").  Returns (pos, image_id, en, pt1, pt2)."""
    o = orig.select("pos", "image_id", F.col("caption").alias("en"))
    a = t1.select("pos", F.col("image_id").alias("__t1_image"), F.col("caption").alias("pt1"))
    z = o.join(a, "pos", "inner")
    if t2 is not None:
        z = z.join(t2.select("pos", F.col("caption").alias("pt2")), "pos", "inner")
    else:
        z = z.withColumn("pt2", F.lit(None).cast("string"))
    # the check is part of a kept value, so column pruning cannot drop it
    check = F.assert_true(F.col("image_id") == F.col("__t1_image"), F.lit("Not synced"))
    return z.select(F.coalesce(check.cast("bigint"), F.col("pos")).alias("pos"), "image_id", "en", "pt1", "pt2")


def interleaved_captions(zipped: DataFrame) -> DataFrame:
    """B2 long form: ``en`` = originals in order, ``pt`` = first translation
    then the stripped second one, per original caption.  Position is the
    sortable pair (pos, sub); ``image_order`` = first appearance."""
    en = zipped.select("image_id", F.lit("en").alias("lang"), "pos", F.lit(0).alias("sub"),
                       F.col("en").alias("text"))
    pt = zipped.select("image_id", F.lit("pt").alias("lang"), "pos",
                       F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("pt1").alias("t")),
                                         F.struct(F.lit(1).alias("s"), TX.strip("pt2").alias("t")))).alias("x"))
    pt = pt.filter(F.col("x.t").isNotNull()).select("image_id", "lang", "pos",
                                                     F.col("x.s").alias("sub"), F.col("x.t").alias("text"))
    return en.unionByName(pt)


def group_captions(zipped: DataFrame) -> DataFrame:
    """B2: one row per image (image_id, image_order, captions_en, captions_pt)."""
    long = interleaved_captions(zipped)
    st = F.struct("pos", "sub", "text")
    # one aggregation: collect_list skips the nulls of the other language
    g = long.groupBy("image_id").agg(
        F.min("pos").alias("image_order"),
        F.array_sort(F.collect_list(F.when(F.col("lang") == "en", st))).alias("__en"),
        F.array_sort(F.collect_list(F.when(F.col("lang") == "pt", st))).alias("__pt"))
    return g.select("image_id", "image_order",
                    F.transform("__en", lambda x: x["text"]).alias("captions_en"),
                    F.transform("__pt", lambda x: x["text"]).alias("captions_pt"))


# ---------------------------------------------------------------- B3 / B4

def split_with_translations(manifest: DataFrame, translations: DataFrame, split: str) -> DataFrame:
    """Images of one split with their English sentences, plus the
    translations whose key (image name minus its last two characters, the
    ``#n`` suffix) names an image of the split, in file order; images without
    translations get ``[]``.

    ``manifest``: (filename, split, sentences array<struct<raw>>)
    ``translations``: (row, image, caption) with ``row`` = file position."""
    imgs = (manifest.filter(F.col("split") == F.lit(split))
                    .select(F.col("filename").alias("image"),
                            F.transform("sentences", lambda s: s["raw"]).alias("captions_en")))
    tr = translations.select("row", F.expr("left(image, length(image) - 2)").alias("image"), "caption")
    tr = tr.join(imgs.select("image"), "image", "left_semi")
    pt = ordered_list(tr, "image", "row", "caption", "captions_pt")
    return (imgs.join(pt, "image", "left")
                .withColumn("captions_pt", F.coalesce("captions_pt", empty_str_array())))


def resolve_split(split: str) -> str:
    """``val`` is stored as ``validation``."""
    return "validation" if split.lower() == "val" else split


def select_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows (split, filename, caption) of one split as samples with
    ``captions_pt = [caption]`` and ``captions_en = []``."""
    s = resolve_split(split)
    return rows.filter(F.col("split") == F.lit(s)).select(
        F.col("filename").alias("image"), F.array("caption").alias("captions_pt"),
        empty_str_array().alias("captions_en"))


# ---------------------------------------------------------------- B5

def insert_translations(samples: DataFrame, t1: DataFrame, t2: DataFrame | None = None):
    """Attach the translation found at row ``int(key[:5])*10000 +
    int(key[5:])`` of the positional translation file(s).

    ``samples``: (key, caption, captions_pt nullable);
    ``t1``/``t2``: (row, caption).  A sample that already has
    ``captions_pt`` gets the first translation appended; otherwise it gets
    ``[t1]`` (``[t1, strip(t2)]`` with a second file).  ``caption`` becomes
    ``captions_en = [caption]``; a sample without ``caption`` keeps the
    ``captions_en`` it has.  All other columns stay.  Returns (inserted,
    missing): samples whose row is absent from a file that their branch reads
    are dropped and listed in ``missing``."""
    s = samples.withColumn("__row", TX.shard_row_key("key"))
    a = t1.select(F.col("row").alias("__row"), F.col("caption").alias("__t1"), F.lit(True).alias("__in1"))
    j = s.join(a, "__row", "left")
    has = F.col("captions_pt").isNotNull() if "captions_pt" in samples.columns else F.lit(False)
    found = F.coalesce("__in1", F.lit(False))
    fresh = F.array(F.col("__t1"))
    if t2 is not None:
        b = t2.select(F.col("row").alias("__row"), F.col("caption").alias("__t2"), F.lit(True).alias("__in2"))
        j = j.join(b, "__row", "left")
        fresh = F.array(F.col("__t1"), TX.strip("__t2"))
        # the second file is read only for samples without translations
        found = found & (has | F.coalesce("__in2", F.lit(False)))
    pt = (F.when(has, F.concat("captions_pt", F.array("__t1"))).otherwise(fresh)
          if "captions_pt" in samples.columns else fresh)
    en = F.when(F.col("caption").isNotNull(), F.array("caption")).otherwise(empty_str_array())
    if "captions_en" in samples.columns:
        en = F.when(F.col("caption").isNull(), F.coalesce("captions_en", empty_str_array())).otherwise(en)
    rest = [c for c in samples.columns if c not in ("key", "caption", "captions_en", "captions_pt")]
    inserted = j.filter(found).select("key", *rest, en.alias("captions_en"), pt.alias("captions_pt"))
    missing = j.filter(~found).select("key", F.col("__row").alias("row"))
    return inserted, missing


# ---------------------------------------------------------------- B6 / B7 / B8

def dedup_keep_first(df: DataFrame, key, order: str) -> DataFrame:
    """Keep only the first row (smallest ``order``) of each ``key``.
    ``min_by`` over a struct: a partial aggregate, so a hot key is combined
    map-side instead of being gathered into one task."""
    cols = [c for c in df.columns]
    k = _col(key).alias("__dk")
    agg = (df.select(k, F.struct(*cols).alias("__r"), F.col(order).alias("__o"))
             .groupBy("__dk").agg(F.min_by("__r", "__o").alias("__r")))
    return agg.select("__r.*")


def image_id(image="image", key="key") -> Column:
    """The image name if present, else the sample key."""
    return F.coalesce(_col(image), _col(key))


def explode_for_translation(samples: DataFrame, image: str = "image",
                            generated: str = "generated_captions_en") -> DataFrame:
    """One (image, pos, caption) row per generated caption, order kept."""
    return samples.select(F.col(image).alias("image"),
                          F.posexplode(generated).alias("pos", "caption")
                          ).withColumn("pos", F.col("pos").cast("bigint"))


# ---------------------------------------------------------------- B10

def merge_translations(samples: DataFrame, translated: DataFrame, image: str = "image",
                       out: str = "generated_captions_pt") -> DataFrame:
    """Attach translated captions by image.  Both columns are stripped;
    ``translated`` is (row, image, translated_caption) with ``row`` its file
    order; images without a translation get ``[]``.  An equi-join: the
    reference's scan of the next part only is not needed."""
    tr = translated.select("row", TX.strip("image").alias(image),
                           TX.strip("translated_caption").alias("t"))
    lst = ordered_list(tr, image, "row", "t", out)
    return (samples.join(lst, image, "left")
                   .withColumn(out, F.coalesce(out, empty_str_array())))


# ---------------------------------------------------------------- B11 / B12 / B13 / B14

def quarantine(df: DataFrame, checks: dict):
    """Split rows into (good, rejects).  ``checks`` maps a reason to a
    predicate that holds for a valid row; a row failing several gets the
    first reason.  Nothing is dropped silently."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = df.withColumn("reject_reason", reason)
    return (tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.filter(F.col("reject_reason").isNotNull()))


def union_datasets(frames: dict) -> DataFrame:
    """Bag union of several datasets (no de-duplication), each tagged
    with its ``source`` name; missing columns become null."""
    out = None
    for name, df in frames.items():
        d = df.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def captions_for_language(captions_by_lang, lang: str, pt_only: bool = False) -> Column:
    """The caption list of one language from a ``map<lang, array>``
    column (null when absent).  ``pt_only`` reproduces the filter job, which
    treats every language but ``pt`` as English."""
    if pt_only and lang.lower() != "pt":
        lang = "en"
    return F.element_at(_col(captions_by_lang), F.lit(lang))


def translator_slice(captions_en, captions_lang, lang: str, translation: str | None) -> Column:
    """English -> ``captions_en``.  Otherwise a one-element list is used
    as is; for ``pt`` the list interleaves two translators: ``marian`` keeps
    even positions, ``google`` odd ones; other languages keep all."""
    if lang.lower() == "en":
        return _col(captions_en)
    c = _col(captions_lang)
    if lang.lower() != "pt":
        return c
    if translation is None:
        raise ValueError("translation must be 'marian' or 'google' for pt")
    parity = {"marian": 0, "google": 1}[translation.lower()]
    sliced = F.filter(c, lambda x, i: i % 2 == parity)
    return F.when(F.size(c) == 1, c).otherwise(sliced)

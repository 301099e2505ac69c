"""C: batch inference stages with a pluggable model callable.

The networks themselves are outside this library.  What Spark runs is the
fan-out, Arrow batching, distribution and regrouping around a callable:

* ``embed`` (C1) runs ``encoder(pandas.Series) -> list of vectors`` in
  ``mapInPandas`` (the model built once per task, or once per Python
  worker when a ``cache_key`` is given);
* ``caption_fanout`` (C2) pairs every image with every prompt, calls the
  captioner on (image, prompt) batches and regroups in prompt order;
* ``translate`` (C3) prefixes the target-language token, translates each
  distinct sentence once (translation memory) and joins the result back;
* ``masked_mean_pool`` (C4) is a plain aggregate.

Results of an expensive callable should be cut with ``reliable_checkpoint``
(or written) before reuse, so a lost executor never re-runs the model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as TX
from corpusmill.operators.corpus import ordered_list
from corpusmill.session import ship_package

# The captioning prompts of the reference, in order.
CAPTION_PROMPTS = [
    "the foreground features", "a photo of", "a picture of",
    "this is a scene depicting", "an image of", "portrait of a",
    "this image captures a moment of", "a painting of", "an art of",
    "the picture shows",
]
# Fixed value: the target-language token prefixed for the translator.
PT_TOKEN = ">>por<<"


# ---------------------------------------------------------------- C1

def token_dim(token, dim: int) -> Column:
    """Dimension of a token in the hashed bag-of-tokens encoder:
    ``int(md5(token)[:8], 16) mod dim`` (Python computes the same)."""
    t = F.col(token) if isinstance(token, str) else token
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def hashed_bow(df: DataFrame, id_col: str, text: str, dim: int = 64, out: str = "vec") -> DataFrame:
    """Deterministic test encoder, native and linear in the text length:
    tokens exploded, counted per (id, dimension) as a partial aggregate,
    scattered into a dense vector and L2-normalised (null without tokens).
    Returns (id, out)."""
    tok = df.select(id_col, F.explode(TX.tokens(text)).alias("__t"))
    counts = (tok.groupBy(id_col, token_dim("__t", dim).alias("__d"))
                 .agg(F.count(F.lit(1)).cast("double").alias("__c"))
                 .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("__d", "__c"))).alias("__m")))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint")),
                        lambda d: F.coalesce(F.element_at("__m", d), F.lit(0.0)))
    v = counts.select(id_col, dense.alias("__v"))
    n = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
    with_vec = v.select(id_col, F.when(n > 0, F.transform("__v", lambda x: x / n)).alias(out))
    return df.select(id_col).join(with_vec, id_col, "left")


def hashed_bow_encoder(dim: int = 64):
    """The same encoder as a pandas callable (for ``embed``)."""
    import hashlib

    import regex

    pat = regex.compile(r"[\p{L}\p{N}_]{2,}")

    def enc(texts: pd.Series) -> list:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            v = np.zeros(dim)
            for tok in pat.findall(t.lower()):
                v[int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim] += 1.0
            n = np.sqrt((v * v).sum())
            out.append(v / n if n > 0 else None)
        return out
    return enc


# Models built by the callables' factories, kept for the life of a Python
# worker process (Spark reuses workers across tasks) under a caller-given key.
_MODELS: dict = {}


def _model(factory, cache_key):
    if cache_key is None:
        return factory()
    if cache_key not in _MODELS:
        _MODELS[cache_key] = factory()
    return _MODELS[cache_key]


def embed(df: DataFrame, col: str, encoder_factory: Callable[[], Callable[[pd.Series], list]],
          out: str = "vec", cache_key: str | None = None) -> DataFrame:
    """Add ``out`` = encoder(col) computed in Arrow batches on the
    executors.  ``encoder_factory`` runs once per task; with ``cache_key``
    the model is built once per Python worker and reused by later tasks."""
    ship_package(df.sparkSession)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def fn(batches):
        enc = _model(encoder_factory, cache_key)
        for pdf in batches:
            vecs = enc(pdf[col])
            pdf[out] = [None if v is None else np.asarray(v, dtype=np.float32) for v in vecs]
            yield pdf
    return df.mapInPandas(fn, schema)


# ---------------------------------------------------------------- C2

def caption_fanout(images: DataFrame, captioner_factory, image: str = "image",
                   prompts=CAPTION_PROMPTS, cache_key: str | None = None) -> DataFrame:
    """Every image x every prompt of the fixed list.  Each image row crosses
    to Python once; the captioner is called on its Arrow batch once per
    prompt, caption = prompt + " " + strip(text).  ``captioner_factory()``
    (run once per task, or once per worker with ``cache_key``) returns
    ``f(pandas.DataFrame with the image columns and 'prompt') -> sequence
    of str``.

    Returns (image, prompt_idx, caption) long rows; ``caption_lists``
    regroups them into the per-image list in prompt order."""
    ship_package(images.sparkSession)
    schema = T.StructType([images.schema[image], T.StructField("prompt_idx", T.LongType()),
                           T.StructField("prompt", T.StringType()), T.StructField("text", T.StringType())])

    def fn(batches):
        cap = _model(captioner_factory, cache_key)
        for pdf in batches:
            for i, prompt in enumerate(prompts):
                texts = list(cap(pdf.assign(prompt=prompt)))
                yield pd.DataFrame({image: pdf[image], "prompt_idx": i, "prompt": prompt, "text": texts})
    gen = images.mapInPandas(fn, schema)
    return gen.select(F.col(image), F.col("prompt_idx").cast("bigint").alias("prompt_idx"),
                      F.concat(F.col("prompt"), F.lit(" "), TX.strip("text")).alias("caption"))


def caption_lists(fanout: DataFrame, image: str = "image", out: str = "generated_captions_en") -> DataFrame:
    return ordered_list(fanout, image, "prompt_idx", "caption", out)


# ---------------------------------------------------------------- C3

def translate(rows: DataFrame, translator_factory, text: str = "original_sentence",
              token: str = PT_TOKEN, out: str = "translated_sentence",
              cache_key: str | None = None) -> DataFrame:
    """Every row translated exactly once per distinct sentence
    (translation memory): distinct sentences -> ``token + " " + sentence``
    -> translator on Arrow batches -> joined back on the sentence."""
    ship_package(rows.sparkSession)
    distinct = rows.select(F.col(text).alias("__src")).distinct() \
                   .withColumn("__in", F.concat(F.lit(token + " "), F.col("__src")))
    def fn(batches):
        tr = _model(translator_factory, cache_key)
        for pdf in batches:
            pdf["__out"] = list(tr(pdf["__in"]))
            yield pdf[["__src", "__out"]]
    memo = distinct.mapInPandas(fn, "__src string, __out string")
    return rows.join(memo, rows[text] == memo["__src"], "left").drop("__src").withColumnRenamed("__out", out)


# ---------------------------------------------------------------- C4

def masked_mean_pool(tokens: DataFrame, id_col: str = "id", mask: str = "mask", vec: str = "vec") -> DataFrame:
    """C4: sum(mask * token vector) / sum(mask) per id, as a partial
    aggregate over (id, dimension).  Returns (id, vec)."""
    per = (tokens.select(id_col, F.col(mask).cast("double").alias("__m"), F.posexplode(vec).alias("__d", "__x"))
                 .groupBy(id_col, "__d")
                 .agg(F.try_divide(F.sum(F.col("__m") * F.col("__x")), F.sum("__m")).alias("__v")))
    return (per.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__d", "__v"))).alias("__l"))
               .select(id_col, F.transform("__l", lambda s: s["__v"]).alias(vec)))

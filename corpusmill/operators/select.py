"""Caption selection.

The per-sample selections (D5, D6, D7, D12) are native array expressions on
one row per sample: no shuffle, no UDF, they also run unchanged on a stream.
D4 filters caption pairs and re-indexes the survivors exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators.indexing import global_index

# Defaults of the reference's selection steps.
DEFAULT_PAIR_THRESHOLD = 0.2
DEFAULT_RANK_K = 5
DEFAULT_SIM_THRESHOLD = 0.2


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- D4

def filter_pairs(df: DataFrame, sim: str = "sim", threshold: float = DEFAULT_PAIR_THRESHOLD,
                 order_by=("pair_id",), idx: str = "idx") -> DataFrame:
    """Keep pairs with ``sim >= threshold`` and number the survivors
    0, 1, 2, ... in ``order_by`` order (exact global index)."""
    kept = df.filter(F.col(sim) >= F.lit(threshold))
    return global_index(kept, list(order_by), col=idx)


# ---------------------------------------------------------------- D5

def base_captions(captions, lang: str) -> Column:
    """First two captions for ``pt``, first one otherwise."""
    n = 2 if lang.lower() == "pt" else 1
    return F.slice(_col(captions), 1, n)


def caption_pool(captions, generated, lang: str = "pt", strategy=None) -> Column:
    """The base pool, extended by generated captions by strategy:
    ``None`` -> base, ``"all"`` -> base ++ generated, int k -> base ++ first k
    generated."""
    base = base_captions(captions, lang)
    gen = F.coalesce(_col(generated), F.array().cast("array<string>"))
    if strategy is None:
        return base
    if strategy == "all":
        return F.concat(base, gen)
    if isinstance(strategy, int) and not isinstance(strategy, bool):
        if strategy < 0:
            raise ValueError("k must be >= 0")
        return F.concat(base, F.slice(gen, 1, strategy)) if strategy > 0 else base
    raise ValueError(f"unknown strategy {strategy!r}")


# ---------------------------------------------------------------- D6 / D7

def _zip_sorted(captions, sims) -> Column:
    """(s, pos, c) structs of the aligned prefix (zip stops at the shorter)."""
    c, s = _col(captions), _col(sims)
    n = F.least(F.size(c), F.size(s))
    z = F.transform(F.sequence(F.lit(0), n - 1),
                    lambda i: F.struct(V.rank_score(F.get(s, i)).alias("s"), i.alias("pos"),
                                       F.get(c, i).alias("c")))
    return F.when(n > 0, z).otherwise(F.array().cast("array<struct<s:double,pos:int,c:string>>"))


def _top_k_sorted(captions, sims, k: int) -> Column:
    """The k highest (s, pos, c) structs in ascending similarity; ties go to
    the larger index (last k of a stable ascending sort); k is capped at
    the list size, an empty list stays empty."""
    if k < 1:
        raise ValueError("k must be >= 1")
    z = F.array_sort(_zip_sorted(captions, sims))
    m = F.least(F.size(z), F.lit(k))
    return F.when(m > 0, F.slice(z, -m, m)).otherwise(F.slice(z, 1, 0))


def top_k_by_similarity_pos(captions, sims, k: int = DEFAULT_RANK_K) -> Column:
    """D6 positions: the ``k`` highest similarities, listed in ascending
    similarity."""
    return F.transform(_top_k_sorted(captions, sims, k), lambda x: x["pos"])


def top_k_by_similarity(captions, sims, k: int = DEFAULT_RANK_K) -> Column:
    """The captions themselves, same order as the positions."""
    return F.transform(_top_k_sorted(captions, sims, k), lambda x: x["c"])


def above_threshold_pos(captions, sims, threshold: float = DEFAULT_SIM_THRESHOLD) -> Column:
    """D7 positions: captions with ``sim >= threshold``, order kept."""
    z = _zip_sorted(captions, sims)
    return F.transform(F.filter(z, lambda x: x["s"] >= F.lit(threshold)), lambda x: x["pos"])


def above_threshold(captions, sims, threshold: float = DEFAULT_SIM_THRESHOLD) -> Column:
    """Captions with ``sim >= threshold``, order kept."""
    z = _zip_sorted(captions, sims)
    return F.transform(F.filter(z, lambda x: x["s"] >= F.lit(threshold)), lambda x: x["c"])


# ---------------------------------------------------------------- D12

def drop_empty(df: DataFrame, pool: str = "pool") -> DataFrame:
    """Samples whose pool is empty are dropped."""
    return df.filter(F.size(F.col(pool)) > 0)

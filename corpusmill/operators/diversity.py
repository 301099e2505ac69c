"""Per-image TF-IDF, within-image caption similarity, greedy pruning.

D8 and D9 are plain aggregates and joins.  The TF-IDF corpus is the caption
set of *one image* (vectoriser defaults: lower case, ``\\b\\w\\w+\\b`` tokens, raw
term counts, ``idf = ln((1+n)/(1+df)) + 1``, L2 norm per caption).

D10's greedy loop is sequential per image.  It needs no list of caption pairs: the summed
similarity of a caption to the others is the dot product of its weights with the summed weights of
the captions left (less its own), and shrinks by the removed caption's products along the postings of
its tokens.  Whether some pair is still above the threshold is kept as one witness pair, looked for
again only when one of the two goes.  Memory is linear in the tokens of the image.  The loop
runs per image in ``applyInArrow``.  A pair above the threshold shares a *prefix* token: the prefix of a caption
is its tokens from the rarest on, until the norm of the rest is within the threshold, and all tokens
outside both prefixes together cannot reach it.  An image with few enough captions and tokens has its similarities as one
matrix instead; the loop is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as TX
from corpusmill.session import ship_package

# Defaults of the reference's diversity pruning.
DEFAULT_K_MIN = 3
DEFAULT_THR = 0.3
#: Caption text of one task; its tokens are some 20 times as large in memory.
TASK_BYTES = 8 << 20
#: Entries of one array where the pairs of an image are worked off in pieces, and of its caption x token and
#: caption x caption matrices where the greedy loop uses them.
PIECE = 1 << 20


def _by_image(captions: DataFrame) -> DataFrame:
    """``captions`` dealt by image, about ``TASK_BYTES`` of text to a task: the one shuffle of all that follows
    here.  Their tokens, weights and pairs take many times the space of the text, and groups and windows within an
    image need no shuffle of their own after this one."""
    size = captions.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    tasks = max(captions.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    return captions.repartition(tasks, "image")


def _weights(captions: DataFrame, image: str, pos: str, text: str, n_col: str | None, bare: bool = False) -> DataFrame:
    """``tfidf``; with ``bare`` a caption without tokens has one row with a null token and weight."""
    c = _by_image(captions.select(F.col(image).alias("image"), F.col(pos).alias("pos"), F.col(text).alias("text"),
                                  *([F.col(n_col).alias("n")] if n_col else [])))
    if not n_col:
        c = c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("image")))
    explode = F.explode_outer if bare else F.explode
    tok = c.select("image", "pos", "n", explode(TX.tokens("text")).alias("token"))
    tf = tok.groupBy("image", "pos", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"))
    df_ = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("image", "token")))
    raw = df_.select("image", "pos", "token", "df", F.when(
        F.col("token").isNotNull(),
        F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)).alias("raw"))
    nrm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("image", "pos")))
    return raw.select("image", "pos", "token", (F.col("raw") / nrm).alias("w"), "df")


def tfidf(captions: DataFrame, image: str = "image", pos: str = "pos", text: str = "text",
          n_col: str | None = None) -> DataFrame:
    """(image, pos, token, w, df) - L2-normalised TF-IDF weight of each
    token of each caption, the corpus being the captions of the same image
    (``df``: captions of the image containing the token).

    ``n_col`` names a column that already holds the image's caption count
    (the length of its caption list).  The captions are shuffled once, as text, by image;
    term counts are grouped, document frequencies and norms are windows over one token of an image and
    one caption, within the task of the image, and spill if an image is large."""
    return _weights(captions, image, pos, text, n_col)


def pair_similarity(weights: DataFrame) -> DataFrame:
    """(image, pos_a, pos_b, sim) for caption pairs of the same image
    that share at least one token, pos_a < pos_b.  Pairs sharing nothing
    have similarity 0 and are not listed.  A token found in one caption
    only (``df`` = 1) cannot join two captions and is left out.  Every caption of a token meets the later ones of
    the token's list, so weights dealt by image (as ``tfidf`` leaves them) are not shuffled again."""
    if "df" in weights.columns:
        weights = weights.filter(F.col("df") >= 2)
    lists = weights.groupBy("image", "token").agg(F.collect_list(F.struct("pos", "w")).alias("of"))
    a = lists.select("image", "of", F.explode("of").alias("a"))
    later = F.filter("of", lambda x: x["pos"] > F.col("a")["pos"])
    both = a.select("image", "a", F.explode(later).alias("b"))
    return (both.groupBy("image", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"))
            .agg(F.sum(F.col("a.w") * F.col("b.w")).alias("sim")))


def prefixes(weights: DataFrame, thr: float = DEFAULT_THR) -> DataFrame:
    """The (image, pos, token, w) rows of the prefix of each caption: tokens by rising ``df`` (then name),
    each with a rest, itself included, whose norm is above ``thr``.  Two captions with a similarity above
    ``thr`` share a token in both prefixes."""
    rest = (Window.partitionBy("image", "pos").orderBy("df", "token")
            .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # a little below the threshold, as the weights are rounded numbers
    kept = weights.withColumn("__rest", F.sum(F.col("w") * F.col("w")).over(rest)).filter(F.col("__rest") > thr * thr - 1e-9)
    return kept.select("image", "pos", "token", "w")


def similar_pairs(weights: DataFrame, thr: float = DEFAULT_THR) -> DataFrame:
    """D9 above a threshold: (image, pos_a, pos_b, sim) for the pairs with ``sim > thr`` only.  Candidates share
    a prefix token; they are verified on all their tokens.  A word that many captions share is in few prefixes, so it
    does not bring together all captions that have it.  The captions of an image meet within the task that has its
    weights (no shuffle follows ``tfidf``), in memory linear in the image's tokens; pairs leave in pieces."""
    ship_package(weights.sparkSession)
    schema = weights.select("image", F.col("pos").alias("pos_a"), F.col("pos").alias("pos_b"), F.lit(0.0).alias("sim")).schema
    return (weights.filter("token is not null").select("image", "pos", "token", "w")
            .groupBy("image").applyInArrow(_near_groups(thr), schema))


def _numbered(batches) -> tuple:
    """The rows of one image as arrays: image, caption positions, and number of the caption, number of the token
    and weight of every row with a token."""
    t = pa.Table.from_batches(batches)
    pos, caption = np.unique(t["pos"].to_numpy(), return_inverse=True)
    words = t["token"].is_valid().to_numpy()
    token = t["token"].combine_chunks().dictionary_encode()
    token = token.combine_chunks() if isinstance(token, pa.ChunkedArray) else token
    token = token.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return t.slice(0, 1)["image"], pos, caption[words], token[words], t["w"].to_numpy()[words].astype(np.float64)


def _near_groups(thr: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, pos, caption, token, w = _numbered(batches)
        for a, b, sim in _Captions(len(pos), caption, token, w, thr).near(thr):
            yield pa.RecordBatch.from_arrays([image.take(pa.array(np.zeros(len(a), np.int64))).combine_chunks(),
                                              pa.array(pos[a]), pa.array(pos[b]), pa.array(sim)],
                                             ["image", "pos_a", "pos_b", "sim"])
    return fn


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``count[i]`` numbers for every i."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _pieces(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges over ``count`` whose sums are about ``PIECE``; one that is larger stands alone."""
    ends, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
        yield i, j
        i = j


class _Captions:
    """The captions of one image as postings: ``caption`` (0..n-1), ``token`` and ``w`` of every weight."""

    def __init__(self, n: int, caption: np.ndarray, token: np.ndarray, w: np.ndarray, thr: float):
        self.n, self.n_tokens = n, int(token.max()) + 1 if len(token) else 0
        # each caption's tokens from the rarest on; its prefix as in ``prefixes``
        order = np.lexsort((token, np.bincount(token)[token], caption))
        rest = np.cumsum((w[order] ** 2)[::-1])[::-1]
        after = np.r_[rest, 0.0][np.searchsorted(caption[order], caption[order], "right")]
        prefix = rest - after > thr * thr - 1e-9
        at = np.flatnonzero(prefix)
        self.prefix_own = np.searchsorted(caption[order][at], np.arange(n + 1))
        self.prefix_token = token[order][at]
        by_token = np.argsort(self.prefix_token, kind="stable")
        self.prefix_start = np.searchsorted(self.prefix_token[by_token], np.arange(self.n_tokens + 1))
        self.prefix_caption = caption[order][at][by_token]
        self.prefix_place = np.argsort(by_token, kind="stable")   # of each prefix token in ``prefix_caption``
        self.own = np.searchsorted(caption[order], np.arange(n + 1))
        self.token, self.w = token[order], w[order]
        post = np.argsort(self.token, kind="stable")
        self.start = np.searchsorted(self.token[post], np.arange(self.n_tokens + 1))
        self.caption, self.post_w = caption[order][post], self.w[post]
        self.has_tokens = np.diff(self.own) > 0
        self.alive = np.ones(n, dtype=bool)

    def near(self, thr: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs (a, b, similarity) above ``thr``, a < b, in pieces by ``a``."""
        keys = np.repeat(np.arange(self.n), np.diff(self.own)) * self.n_tokens + self.token
        by_key = np.argsort(keys, kind="stable")
        keys, key_w = keys[by_key], self.w[by_key]
        later = self.prefix_start[self.prefix_token + 1] - self.prefix_place - 1
        met = np.diff(np.r_[0, np.cumsum(later)][self.prefix_own])
        for i, j in _pieces(met):
            e = slice(self.prefix_own[i], self.prefix_own[j])
            first = np.repeat(np.repeat(np.arange(i, j), np.diff(self.prefix_own[i:j + 1])), later[e])
            pair = np.unique(first * self.n + self.prefix_caption[_spans(self.prefix_place[e] + 1, later[e])])
            size = np.diff(self.own)[pair // self.n]
            for p, q in _pieces(size):
                a, b = pair[p:q] // self.n, pair[p:q] % self.n
                mine = _spans(self.own[a], size[p:q])
                key = np.repeat(b, size[p:q]) * self.n_tokens + self.token[mine]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                sim = np.bincount(np.repeat(np.arange(q - p), size[p:q]),
                                  np.where(keys[at] == key, self.w[mine] * key_w[at], 0.0), q - p)
                found = sim > thr
                if found.any():
                    yield a[found], b[found], sim[found]

    def products(self, i: int) -> np.ndarray:
        """Similarity of caption ``i`` to every caption."""
        out = np.zeros(self.n)
        for t, w in zip(self.token[self.own[i]:self.own[i + 1]].tolist(), self.w[self.own[i]:self.own[i + 1]].tolist()):
            at = slice(self.start[t], self.start[t + 1])
            out[self.caption[at]] += w * self.post_w[at]   # a caption is at most once among the postings of a token
        return out

    def costs(self) -> np.ndarray:
        """Summed similarity of each caption to the others; -1 without tokens."""
        sums = np.bincount(self.token, self.w, self.n_tokens)
        cost = np.bincount(np.repeat(np.arange(self.n), np.diff(self.own)), self.w * sums[self.token], self.n)
        return np.where(self.has_tokens, cost - np.bincount(np.repeat(np.arange(self.n), np.diff(self.own)), self.w * self.w, self.n), -1.0)

    def partner(self, i: int, thr: float) -> int:
        """A surviving caption more similar to ``i`` than ``thr``, or -1."""
        lists = [self.prefix_caption[self.prefix_start[t]:self.prefix_start[t + 1]]
                 for t in self.prefix_token[self.prefix_own[i]:self.prefix_own[i + 1]].tolist()]
        maybe = [x for x in lists if len(x) > 1]
        if not maybe:
            return -1
        near = np.concatenate(maybe)
        near = near[self.alive[near] & (near != i)]
        found = near[self.products(i)[near] > thr] if len(near) else near
        return int(found.min()) if len(found) else -1


def _prune_matrix(n: int, with_tokens: np.ndarray, caption: np.ndarray, token: np.ndarray, w: np.ndarray,
                  k_min: int, thr: float) -> np.ndarray:
    """``greedy_prune`` over the matrix of similarities; tokens of one caption only are left out."""
    m = np.zeros((n, int(token.max()) + 1))
    m[caption, token] = w
    sim = m @ m.T
    np.fill_diagonal(sim, 0.0)
    near = sim > thr
    degree, cost, alive, left = near.sum(1), np.full(n, -1.0), np.ones(n, dtype=bool), n
    cost[with_tokens] = 0.0
    cost += sim.sum(1)
    pairs = int(degree.sum()) // 2
    while left > k_min and pairs:
        i = int(np.argmax(np.where(alive, np.round(cost, 9), -np.inf)))   # 9 decimals: see ``greedy_prune``
        alive[i] = False
        left -= 1
        pairs -= int(degree[i])
        degree = degree - near[i]
        cost -= sim[i]
    return alive


def greedy_prune(n: int, caption: np.ndarray, token: np.ndarray, w: np.ndarray, k_min: int = DEFAULT_K_MIN,
                 thr: float = DEFAULT_THR, drop_isolated: bool = False) -> np.ndarray:
    """The greedy loop for one image with captions 0..n-1 and their unit token weights; a keep mask.

    While some surviving pair is above ``thr`` and more than ``k_min`` captions survive, the caption with the
    largest summed similarity to the others (lowest position on ties; a caption without tokens counts -1)
    is removed.  ``drop_isolated`` reproduces the reference's final step, which also drops
    survivors that share no token with any other survivor."""
    if n < k_min or not len(token):
        return np.ones(n, dtype=bool)
    shared = np.bincount(token)[token] > 1
    if not shared.any() and not drop_isolated:
        return np.ones(n, dtype=bool)
    if not drop_isolated:
        met, column = np.unique(token[shared], return_inverse=True)
        if n * max(n, len(met)) <= PIECE:
            return _prune_matrix(n, caption, caption[shared], column, w[shared], k_min, thr)
    c = _Captions(n, caption, token, w, thr)
    cost = c.costs()
    left, first, second = n, 0, -1
    while left > k_min:
        # the next pair above the threshold; a caption without one never gets one again
        while first < n and not (c.alive[first] and second >= 0 and c.alive[second]):
            second = c.partner(first, thr) if c.alive[first] else -1
            first += second < 0
        if first == n:
            break
        # compared at 9 decimals: the running update must not turn an exact tie
        # (lowest position wins) into a float-noise decision
        i = int(np.argmax(np.where(c.alive, np.round(cost, 9), -np.inf)))
        c.alive[i] = False
        left -= 1
        cost -= c.products(i)
    if drop_isolated:
        live = np.repeat(c.alive, np.diff(c.own))
        shared = np.bincount(c.token[live], minlength=c.n_tokens) > 1
        linked = np.bincount(np.repeat(np.arange(n), np.diff(c.own)), shared[c.token], n) > 0
        c.alive &= linked | ~c.has_tokens
    return c.alive


def _prune_groups(k_min: int, thr: float, drop_isolated: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, pos, caption, token, w = _numbered(batches)
        left = pos[greedy_prune(len(pos), caption, token, w, k_min, thr, drop_isolated)]
        yield pa.RecordBatch.from_arrays([image.take(pa.array(np.zeros(len(left), np.int64))).combine_chunks(), pa.array(left)],
                                         ["image", "pos"])
    return fn


def prune_similar(captions: DataFrame, k_min: int = DEFAULT_K_MIN, thr: float = DEFAULT_THR,
                  drop_isolated: bool = False, image: str = "image", pos: str = "pos",
                  text: str = "text", n_col: str | None = None) -> DataFrame:
    """Captions kept after greedy diversity pruning, as (image, pos,
    text) rows.  The weights go to the loop image by image from the task that computed them; the texts are
    joined to the kept positions.  The weights of one image are one group: linear in its tokens."""
    ship_package(captions.sparkSession)
    c = captions.select(F.col(image).cast("bigint").alias("image"), F.col(pos).cast("bigint").alias("pos"),
                        F.col(text).alias("text"), *([F.col(n_col).alias("__n")] if n_col else []))
    w = _weights(c, "image", "pos", "text", "__n" if n_col else None, bare=True).select("image", "pos", "token", "w")
    kept = w.groupBy("image").applyInArrow(_prune_groups(k_min, thr, drop_isolated), "image long, pos long")
    return c.join(kept, ["image", "pos"], "inner").select("image", "pos", "text")


def threshold_then_diversity(captions: DataFrame, sims_col: str = "sim", threshold: float = 0.2,
                             k_min: int = DEFAULT_K_MIN) -> DataFrame:
    """D7 (keep ``sim >= threshold``) then D10 with the fixed 0.3
    pair threshold (the configured threshold only feeds D7)."""
    kept = captions.filter(F.round(F.col(sims_col), 9) >= F.lit(threshold))
    return prune_similar(kept, k_min=k_min, thr=DEFAULT_THR)

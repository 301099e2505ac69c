"""Near-duplicate documents by bottom-k MinHash sketches of one hash function.

1. Each text becomes its set of five-word shingle hashes.  The ``k`` smallest
   hashes are its sketch; a digest of the whole set finds equal sets, which
   are represented by their smallest id from here on.
2. Inverted lists of the retained values give the overlaps.  Let a pair be
   similar (Jaccard >= t).  The k smallest values of the union are a random
   sample of it, so at least ``c = ceil(share * k)`` of them lie in both sketches,
   but for a chance of LOSS, from which ``share`` follows for any t and k.  Two sketches with c
   values in common must meet in the lists of all but their c - 1 most frequent
   values.  So values held by one document alone, and values of passages that
   many documents share, bring no candidates unless most of a sketch is made
   of them.
3. Lists are not expanded into all pairs.  Every member is paired with three
   fixed members of its list, the pairs are filtered by the union-sketch
   estimate and verified by exact Jaccard on the full sets, and the verified
   links give components.  Only pairs whose ends lie in different components
   can still matter: they are compared in a second round, by a join in short lists
   and in cells of bounded size in long ones, filtered and verified alike.
4. Components are the transitive closure of the verified links.

Cases: a null or blank text has an empty set and links with nothing.  Equal
sets always link.  Rows that share an id are one document and link wherever one of
them does; each row reports its own set size.  A row with a null id links with
nothing, has a null component and is kept.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, ready, shingles, signed
from corpusmill.llm.graph import connected_components

SKETCH = 64           # values kept per document
LOSS = 1e-8           # chance that the sketches of a similar pair share too few values
SHORT_LIST = 64       # members of a list that are joined directly
BLOCK = 512           # documents per block of a cluster of longer lists


def _features(batches, k):
    for rb in batches:
        ids, digests, sizes, parts, ends = rb.column(0), [], [], [], [0]
        for text in rb.column(1).to_pylist():
            s = shingles(text)
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sizes.append(len(s))
            parts.append(signed(s[:k]))
            ends.append(ends[-1] + len(parts[-1]))
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
            ["doc_id", "digest", "n_shingles", "sketch"])


def _verified(batches, percent):
    """Pairs whose full sets reach the similarity; rows are ``a, b, ta, tb``."""
    last = {}
    for rb in batches:
        keep = []
        for i, (ta, tb) in enumerate(zip(rb.column(2).to_pylist(), rb.column(3).to_pylist())):
            cur = {}
            for t in (ta, tb):
                if t not in cur:
                    cur[t] = last[t] if t in last else shingles(t)
            last = cur
            a, b = cur[ta], cur[tb]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both) and both:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(keep, pa.int64())),
                                          rb.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])


def _shared_counts(sketches: list[np.ndarray]) -> np.ndarray:
    """How many values each two sketches share."""
    vals, inv, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    both = times[inv] > 1
    cols, col = np.unique(inv[both], return_inverse=True)
    rows, n = owner[both], len(sketches)
    out = np.zeros((n, n), np.float32)
    for at in range(0, len(cols), 4096):
        here = (col >= at) & (col < at + 4096)
        member = np.zeros((n, 4096), np.float32)
        member[rows[here], col[here] - at] = 1
        out += member @ member.T
    return out


def _cell_links(pdf: pd.DataFrame, percent: int, k: int, share: float) -> pd.DataFrame:
    """Verified links of one cell that join different components: a spanning set,
    so fewer than the cell has rows."""
    node, label, side = (pdf[c].to_numpy() for c in ("node", "label", "side"))
    sets = [shingles(t) for t in pdf["text"]]
    sizes = np.array([len(x) for x in sets])
    need = np.ceil(share * np.minimum(sizes, k))
    maybe = _shared_counts([x[:k] for x in sets]) >= np.maximum(need[:, None], need[None, :])
    maybe &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    if (side != side[0]).any():  # a cell of two blocks: each block has a cell of its own
        maybe &= side[:, None] != side[None, :]
    root = {x: x for x in label}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i in range(len(sets)):
        todo = [j for j in np.flatnonzero(maybe[i, :i]) if find(label[j]) != find(label[i])]
        if not todo:
            continue
        flat = np.concatenate([sets[j] for j in todo])
        at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        ends = np.cumsum([0] + [len(sets[j]) for j in todo])
        both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), ends[:-1])
        for j, n in zip(todo, both):
            if 100 * n >= percent * (sizes[i] + sizes[j] - n) and find(label[j]) != find(label[i]):
                root[find(label[j])] = find(label[i])
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def share_of(percent: int, k: int, loss: float = LOSS) -> float:
    """Largest share of a sketch such that a pair at ``percent`` similarity shares fewer than that
    of its k values with a chance of at most ``loss`` (binomial)."""
    p, below, least = percent / 100, 0.0, 0
    for c in range(k + 1):
        below += math.comb(k, c) * p ** c * (1 - p) ** (k - c)
        if below > loss:
            break
        least = c + 1
    if not least:
        raise ValueError(f"sketches of {k} values cannot find pairs at {percent} percent; take a larger k")
    return least / k


def _least_shared(n, share: float):
    return F.greatest(F.lit(1), F.ceil(F.lit(share) * n)).cast("int")


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, share: float) -> DataFrame:
    """Pairs whose union sketch holds at least ``share`` common values."""
    sa = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("_sa"))
    sb = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("_sb"))
    union = F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, k)
    x = F.transform(F.array(union), lambda u: F.struct(
        F.size(u).alias("n"),
        F.size(F.array_intersect(u, F.array_intersect("_sa", "_sb"))).alias("x")))[0]
    return (pairs.join(sa, "a").join(sb, "b").withColumn("_x", x)
            .filter(F.col("_x.x") >= F.lit(share) * F.least(F.size("_sa"), F.size("_sb"), F.col("_x.n")))
            .select("a", "b").distinct())


def _long_list_links(lab: DataFrame, texts: DataFrame, percent: int, k: int, share: float) -> DataFrame:
    """Links between different components among the members of the long lists,
    ``lab(v, node, label)``.

    Documents that meet in any of these lists form a cluster, so two documents
    are compared once, however many lists they share.  In a cluster the largest
    component is the main one and needs no comparison within itself; its members
    and the rest are dealt into blocks, and every two blocks with a part of the
    rest meet in a cell of bounded size.
    """
    hub = lab.groupBy("v").agg(F.min("node").alias("b"))
    spokes = lab.join(cut(hub), "v").select(F.col("node").alias("a"), "b")
    members = cut(lab.select("node", "label").distinct()
                  .join(connected_components(spokes).withColumnRenamed("component", "cluster"), "node"))
    per_label = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(per_label.groupBy("cluster").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
        .select("cluster", F.col("top.label").alias("main"),
                F.ceil(F.col("top.n") / BLOCK).cast("int").alias("nm"),
                F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("nr")).filter("nr > 0"))
    dealt = (members.join(sizes, "cluster")
             .withColumn("rest", F.col("label") != F.col("main"))
             .withColumn("blk", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int")))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, main: F.struct(i.alias("i"), j.alias("j"), F.lit(main).alias("main"))
    with_rest = F.transform(upto("nr"), lambda o: cell(F.least("blk", o), F.greatest("blk", o), False))
    with_main = F.transform(upto("nm"), lambda o: cell(F.col("blk"), o, True))
    as_main = F.transform(upto("nr"), lambda o: cell(o, F.col("blk"), True))
    cells = (dealt.withColumn("c", F.explode(F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(as_main)))
             .select("cluster", "c.i", "c.j", "c.main", "node", "label",
                     F.when(F.col("c.main"), F.col("rest").cast("int")).otherwise(F.col("blk")).alias("side"))
             .join(texts, "node"))
    return cells.groupBy("cluster", "i", "j", "main").applyInPandas(
        lambda pdf: _cell_links(pdf, percent, k, share), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = 80, k: int = SKETCH, loss: float = LOSS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``; linked at
    ``100 * intersection >= percent * union``.  See the module text."""
    share = share_of(percent, k, loss)
    src = ready(docs).select(F.col(id_col).cast("bigint").alias("doc_id"),
                             F.col(text_col).cast("string").cast("binary").alias("text"))
    feats = cut(src.mapInArrow(lambda it: _features(it, k),
                               "doc_id bigint, digest binary, n_shingles bigint, sketch array<bigint>"))

    usable = feats.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    reps = cut(usable.withColumnRenamed("doc_id", "node")
               .join(classes.select("node", "digest"), ["node", "digest"], "left_semi")
               .select("node", "digest", "sketch"))
    sketches = reps.select("node", "sketch")

    # inverted lists, without the values that one document holds alone
    posts = reps.select("node", "digest", F.size("sketch").alias("kk"), F.explode("sketch").alias("v"))
    # (cut: a join of two plain inputs lets Spark split a frequent value)
    freq = cut(posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    held = (posts.join(freq, "v").groupBy("node", "digest", "kk")
            .agg(F.sort_array(F.collect_set(F.struct("df", "v"))).alias("vs"))  # at most k values
            .withColumn("take", F.size("vs") - _least_shared(F.col("kk"), share) + 1)
            .filter("take > 0"))
    lists = cut(held.select("node", F.explode(F.slice("vs", F.lit(1), F.col("take"))).alias("e"))
                .select("node", F.col("e.v").alias("v")))

    hub = F.struct(F.xxhash64("node").alias("h"), "node")
    hubs = cut(lists.groupBy("v").agg(F.min("node").alias("h1"), F.min(hub).alias("h2"), F.max(hub).alias("h3"))
               .select("v", F.array("h1", "h2.node", "h3.node").alias("hub")))
    first = (lists.join(hubs, "v").select("node", F.explode("hub").alias("hub")).filter("node <> hub")
             .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())

    # texts of the documents that any list names
    named = lists.select("node").distinct()
    texts = cut(src.withColumnRenamed("doc_id", "node").join(named, "node", "left_semi").distinct())

    def verify(pairs):
        ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        full = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
        return full.mapInArrow(lambda it: _verified(it, percent), "a bigint, b bigint")

    links = cut(verify(_estimated(first, sketches, k, share)))
    comp = connected_components(links)

    # second round: pairs of a list whose ends are still in different components
    lab = (lists.join(comp.withColumnRenamed("component", "label"), "node", "left")
           .withColumn("label", F.coalesce("label", "node")))
    open_lists = cut(lab.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                          F.count(F.lit(1)).alias("m"))
                     .filter("lo <> hi").select("v", "m"))
    lab = cut(lab.join(open_lists, "v"))
    short = lab.filter(F.col("m") <= SHORT_LIST)
    other = short.select("v", F.col("node").alias("b"), F.col("label").alias("lb"))
    near = (short.select("v", F.col("node").alias("a"), F.col("label").alias("la"))
            .join(other, "v").filter("a < b and la <> lb").select("a", "b").distinct())
    more = cut(verify(_estimated(near, sketches, k, share)).unionByName(
        _long_list_links(lab.filter(F.col("m") > SHORT_LIST), texts, percent, k, share)))

    final = connected_components(links.unionByName(more))
    named_class = (classes.join(final, "node", "left")
                   .filter("n > 1 or component is not null")
                   .select("digest", F.coalesce("component", "node").alias("component_id")))
    return (feats.join(named_class, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(
                        F.coalesce("component_id", "doc_id")).cast("bigint").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, percent).filter(~F.col("kept")).select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")

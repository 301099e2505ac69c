"""Vector code compression: product quantisation by dual-tree Lloyd rounds on integers.

Vectors become integers ``floor(scale * x)`` and are cut into equal consecutive parts; each part
position has its own codebook.

*Blocks.*  Rows are packed once into blocks of ``BLOCK`` vectors.  In a block, the parts of every
position are arranged in a tree by median cuts along the widest dimension; each node stores its box,
its count and the sum of its parts.  Blocks are written to the shared folder and read by every
round, so no round moves vectors: only sums per entry leave a task.

*Dual-tree assignment.*  The entries of a codebook form a tree of boxes, too.  Both trees are
descended together, all node pairs of a level at once:

1. a pair goes when the least distance between its boxes is above the largest that another pair of
   the same part node can have;
2. when only single entries are left, an entry goes when some other is nearer (or as near with a lower
   index) over the node's whole box: the difference of two squared distances is linear in the part, so
   its largest value over the box is exact.

A node left with one entry is assigned whole, by its stored sum and count.  The leaves that
stay uncertain compare their parts with the remaining entries.  All of it is exact in integers:
products of values below 2^53 run as doubles, which hold them exactly, and larger ones as longs.

Every round sends the codebooks (entries x dim integers) with the tasks, and adds the partial sums by
position and entry.  The final labels' errors are joined back by label, with a
broadcast for labels that many rows share.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped.  The first codebook
takes the rows with the smallest ids, ties by their integers, null ids last; with fewer rows than
``entries`` it is that much shorter.  Repeated rows are coded each; null labels are one group.  An entry
without parts stays.  Vectors of different lengths, a length that ``parts`` does not divide (0 included),
and values whose distances leave the range of a long are errors.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, ready
from corpusmill.llm.joins import join_back
from corpusmill.llm.whitening import matrix, usable

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of a block, and parts of a leaf.
BLOCK = 4096
LEAF = 64
_EXACT = 2 ** 53


def _halves(n: int, leaf: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level: all nodes are halved until none holds more than ``leaf``; a single stays."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        b = levels[-1]
        levels.append(np.unique(np.r_[b, (b[:-1] + b[1:]) // 2]))
    return levels


class Tree:
    """Points in tree order with, per level, the nodes' bounds, boxes and sums."""

    def __init__(self, points: np.ndarray, leaf: int):
        order = np.arange(len(points))
        self.bounds = _halves(len(points), leaf)
        for upper, lower in zip(self.bounds, self.bounds[1:]):
            for a, b in zip(upper[:-1].tolist(), upper[1:].tolist()):
                mid = (a + b) // 2
                if mid == a:
                    continue
                own = points[order[a:b]]
                wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid - a)]
        self.order, self.points = order, points[order]
        at = [b[:-1] for b in self.bounds]
        self.low = [np.minimum.reduceat(self.points, b) for b in at]
        self.high = [np.maximum.reduceat(self.points, b) for b in at]
        self.sums = [np.add.reduceat(self.points, b) for b in at]

    def pack(self) -> bytes:
        """Order, points and the nodes' boxes and sums, one array behind another."""
        return b"".join([self.order.astype("<i4").tobytes(), self.points.astype("<i4").tobytes(),
                         *[x.astype("<i4").tobytes() for x in (*self.low, *self.high)],
                         *[x.astype("<i8").tobytes() for x in self.sums]])

    @classmethod
    def unpack(cls, data: bytes, n: int, dim: int, leaf: int) -> Tree:
        self, place = cls.__new__(cls), 0

        def take(rows, width, kind):
            nonlocal place
            size = rows * width * np.dtype(kind).itemsize
            out = np.frombuffer(data, kind, rows * width, place).reshape(rows, width)
            place += size
            return out.astype(np.int64)

        self.bounds = _halves(n, leaf)
        self.order, self.points = take(n, 1, "<i4")[:, 0], take(n, dim, "<i4")
        self.low = [take(len(b) - 1, dim, "<i4") for b in self.bounds]
        self.high = [take(len(b) - 1, dim, "<i4") for b in self.bounds]
        self.sums = [take(len(b) - 1, dim, "<i8") for b in self.bounds]
        return self


def _nearest(points: np.ndarray, entries: np.ndarray):
    """(index, squared distance) of the nearest entry of each point, ties to the lower index."""
    reach = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * reach * reach * points.shape[1] < _EXACT else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    d = (e * e).sum(axis=1) - 2 * (p @ e.T)
    best = d.argmin(axis=1)
    return best, (d[np.arange(len(p)), best] + (p * p).sum(axis=1)).astype(np.int64)


def _lowest(group: np.ndarray, values: np.ndarray):
    """Least value of each run of equal ``group`` (ascending), given to every member."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.repeat(np.minimum.reduceat(values, starts), np.diff(np.r_[starts, len(group)]))


def _children(tree: Tree, level: int):
    """(next level, first child of each node there, number of children)."""
    upper = tree.bounds[level]
    if level + 1 == len(tree.bounds):
        return level, np.arange(len(upper) - 1), np.ones(len(upper) - 1, np.int64)
    at = np.searchsorted(tree.bounds[level + 1], upper)
    return level + 1, at[:-1], np.diff(at)


class Assignment:
    """What the dual descent leaves: whole nodes with their entry, and leaves with candidates."""

    def __init__(self, parts: Tree, entries: Tree):
        self.parts, self.entries = parts, entries
        self.nodes: list[tuple[int, np.ndarray, np.ndarray]] = []  # level, nodes, entry of each
        self.pairs = 0
        p, e, pl, el = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
        while len(p):
            p, e = self._bounded(p, e, pl, el)
            single = el == len(entries.bounds) - 1
            if single:
                p, e = self._dominated(p, e, pl)
                p, e = self._whole(p, e, pl)
            pl2, first_p, n_p = _children(parts, pl)
            el2, first_e, n_e = _children(entries, el)
            if (pl2, el2) == (pl, el):
                break
            many = n_p[p] * n_e[e]
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            p, e = np.repeat(p, many), np.repeat(e, many)
            p, e = first_p[p] + k // n_e[e], first_e[e] + k % n_e[e]
            sort = np.argsort(p, kind="stable")
            p, e, pl, el = p[sort], e[sort], pl2, el2
        self.open = p, e

    def _bounded(self, p, e, pl, el):
        self.pairs += len(p)
        a, b = self.parts.low[pl][p], self.parts.high[pl][p]
        c, d = self.entries.low[el][e], self.entries.high[el][e]
        gap = np.maximum(np.maximum(c - b, a - d), 0)
        span = np.maximum(d - a, b - c)
        least, most = np.einsum("ij,ij->i", gap, gap), np.einsum("ij,ij->i", span, span)
        keep = least <= _lowest(p, most)
        return p[keep], e[keep]

    def _dominated(self, p, e, pl):
        """Drop entries that one rival, the nearest to the box's middle, beats over the whole box."""
        low, high = self.parts.low[pl][p], self.parts.high[pl][p]
        own, number = self.entries.points[e], self.entries.order[e]
        mid = low + high - 2 * own
        far = np.einsum("ij,ij->i", mid, mid)
        first = np.lexsort((number, far, p))
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        rival = np.repeat(first[starts], np.diff(np.r_[starts, len(p)]))
        step = own - own[rival]
        # largest over the box of |x - rival|^2 - |x - own|^2 = 2 x.step + |rival|^2 - |own|^2
        corner = np.where(step > 0, high, low)
        size = np.einsum("ij,ij->i", own, own)
        gain = 2 * np.einsum("ij,ij->i", corner, step) + size[rival] - size
        keep = (gain > 0) | ((gain == 0) & (number <= number[rival]))
        keep[rival] = True
        return p[keep], e[keep]

    def _whole(self, p, e, pl):
        if not len(p):
            return p, e
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        alone = np.diff(np.r_[starts, len(p)]) == 1
        one = starts[alone]
        self.nodes.append((pl, p[one], self.entries.order[e[one]]))
        keep = ~np.repeat(alone, np.diff(np.r_[starts, len(p)]))
        return p[keep], e[keep]

    def leaves(self):
        """(first, end, entry and distance of each part) of the uncertain leaves."""
        p, e = self.open
        if not len(p):
            return
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[starts[1:], len(p)]
        bounds = self.parts.bounds[-1]
        for s, t in zip(starts.tolist(), ends.tolist()):
            a, b = int(bounds[p[s]]), int(bounds[p[s] + 1])
            # ascending numbers, so that the first of equal distances has the lower index
            cand = e[s:t][np.argsort(self.entries.order[e[s:t]])]
            best, d = _nearest(self.parts.points[a:b], self.entries.points[cand])
            yield a, b, self.entries.order[cand][best], d

    def totals(self):
        """(sum of parts, count) of each entry."""
        n, dim = len(self.entries.points), self.parts.points.shape[1]
        sums, counts = np.zeros((n, dim), np.int64), np.zeros(n, np.int64)
        for level, nodes, entry in self.nodes:
            np.add.at(sums, entry, self.parts.sums[level][nodes])
            np.add.at(counts, entry, np.diff(self.parts.bounds[level])[nodes])
        for a, b, entry, _ in self.leaves():
            np.add.at(sums, entry, self.parts.points[a:b])
            counts += np.bincount(entry, minlength=n)
        return sums, counts

    def codes(self):
        """(entry, squared distance) of each part, in the order the tree was built from."""
        code, error = np.empty(len(self.parts.points), np.int64), np.empty(len(self.parts.points), np.int64)
        book = self.entries.points[np.argsort(self.entries.order)]
        for level, nodes, entry in self.nodes:
            first, size = self.parts.bounds[level][nodes], np.diff(self.parts.bounds[level])[nodes]
            at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            code[at] = np.repeat(entry, size)
            diff = self.parts.points[at] - book[code[at]]
            error[at] = np.einsum("ij,ij->i", diff, diff)
        for a, b, entry, d in self.leaves():
            code[a:b], error[a:b] = entry, d
        out = np.empty_like(code), np.empty_like(error)
        for o, v in zip(out, (code, error)):
            o[self.parts.order] = v
        return out


def _entry_tree(book: np.ndarray) -> Tree:
    return Tree(book, 1)


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks of up to BLOCK vectors: ids, labels, the number of vectors and a packed tree per position."""
    block, leaf = BLOCK, LEAF

    def pack(table):
        v = matrix(table.column("v"))
        dim = v.shape[1] // parts
        trees = [Tree(v[:, i * dim:(i + 1) * dim], leaf).pack() for i in range(parts)]
        ids, labels = table.column("id"), table.column("label")
        cols = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([len(v)], pa.int32()), pa.array([dim], pa.int32()),
                                           pa.array([trees], pa.list_(pa.binary()))], ["id", "label", "n", "dim", "trees"])

    def build(batches):
        kept, size = [], 0
        for rb in batches:
            at = 0
            while at < len(rb):
                part = rb.slice(at, block - size)
                at, size = at + len(part), size + len(part)
                kept.append(part)
                if size == block:
                    yield pack(_one_batch(kept))
                    kept, size = [], 0
        if kept:
            yield pack(_one_batch(kept))

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(build, f"id array<{kind('id')}>, label array<{kind('label')}>, n int, dim int, trees array<binary>")


def _one_batch(parts):
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _position_trees(rb, i, leaf):
    for row in range(len(rb)):
        n, dim = rb.column("n")[row].as_py(), rb.column("dim")[row].as_py()
        for position, data in enumerate(rb.column("trees")[row]):
            yield i + row, position, Tree.unpack(data.as_py(), n, dim, leaf)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    leaf = LEAF
    parts, n, dim = books.shape

    def partial(batches):
        entry_trees = [_entry_tree(b) for b in books]
        sums, counts = np.zeros((parts, n, dim), np.int64), np.zeros((parts, n), np.int64)
        for rb in batches:
            for _, position, tree in _position_trees(rb, 0, leaf):
                s, c = Assignment(tree, entry_trees[position]).totals()
                sums[position] += s
                counts[position] += c
        used = np.argwhere(counts > 0)
        if len(used):
            a, b = used.T
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[a, b]),
                 pa.array(list(sums[a, b]), pa.list_(pa.int64()))], ["position", "entry", "n", "s"])

    found = blocks.mapInArrow(partial, "position int, entry int, n bigint, s array<bigint>")
    total = found.groupBy("position", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(dim)]).alias("s")).collect()
    out = books.copy()
    for r in total:
        out[r.position, r.entry] = [s // r.n for s in r.s]
    return out


def _coded(blocks: DataFrame, books: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    """``vec_id, label, code array<int>, error`` of each vector."""
    leaf = LEAF

    def code(batches):
        entry_trees = [_entry_tree(b) for b in books]
        for rb in batches:
            for row in range(len(rb)):
                one = rb.slice(row, 1)
                found = [Assignment(t, entry_trees[i]).codes() for _, i, t in _position_trees(one, row, leaf)]
                codes, errors = np.stack([c for c, _ in found], 1), np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [one.column("id").flatten(), one.column("label").flatten(),
                     pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors)],
                    ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(code, f"vec_id {id_type}, label {label_type}, code array<int>, error bigint")


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
        parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE):
    """(blocks, codebooks): the packed vectors, and an array parts x entries x dim / parts, or None without vectors."""
    rows = (ready(df).filter(usable(F.col(vector_col)))
            .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                    F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale)).alias("v")))
    # the limit is the size of a codebook
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None, None
    size = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    if size[0] != size[1] or size[0] % parts or not size[0]:
        raise ValueError(f"vectors of {size[0]} to {size[1]} entries cannot be cut into {parts} equal parts")
    if size[2] >= 2 ** 31 or 16 * size[2] ** 2 * size[0] >= 2 ** 63:
        raise ValueError(f"entries up to {size[2]}: distances leave the range of a long")
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    blocks = cut(_blocks(rows, parts))
    for _ in range(rounds):
        books = _round(blocks, books)
    return blocks, books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE):
    """(coded, codebooks).  ``coded`` has ``vec_id, label, code, error, label_error`` per usable row: an index
    per part, the squared distance over all parts, and its sum over the rows of the same label."""
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    blocks, books = fit(df, id_col, vector_col, label_col, parts, entries, rounds, scale)
    if blocks is None:
        empty = f"vec_id {types[id_col]}, label {types[label_col]}, code array<int>, error bigint, label_error bigint"
        return df.sparkSession.createDataFrame([], empty), np.empty((parts, 0, 0), np.int64)
    coded = cut(_coded(blocks, books, types[id_col], types[label_col]))
    labels = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("error").alias("label_error"))
    found = join_back(coded, cut(labels), ["label"], "n_rows", coded.count())
    return found.select("vec_id", "label", "code", "error", "label_error"), books

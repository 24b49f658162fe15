"""Links inside the buckets of a key, and the components that links form.

Rows (key, node, ...) are dealt by key and sorted; a task streams through its buckets and holds at most one part of a bucket, so a
bucket of any size is a bounded amount of memory. Inside a part all pairs that may matter are compared in numpy, and
only those that are wanted leave the worker. A bucket that is larger than a part is finished afterwards: only its members
outside its largest component are compared with its other parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import forget, lean, save

#: Rows of a bucket that a worker compares at once.
PART = 4096
#: Buckets of so many rows are compared together with others, row by row at each distance.
SMALL = 8
#: Pairs whose columns are gathered at once for a test that needs all of them.
SIFTED = 100_000
#: Nodes whose links a task remembers, so that it doesn't say again what other buckets have told.
REMEMBERED = 500_000
#: Edges (16 bytes) whose components one task forms; more of them take distributed rounds, each task writing as many.
COMPONENT_ROWS = 1_000_000
#: Rows of (node, root) that are broadcast at most; above that they are joined by a shuffle.
BROADCAST_ROOTS = 500_000

Match = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


# -- components -----------------------------------------------------------------------------------------------


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the edges (a, b): each root is the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if (lo == hi).all():
            return nodes, nodes[up]
        np.minimum.at(up, hi, lo)
        while (up[up] != up).any():
            up = up[up]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the saved edges (a, b): root is the smallest node of its component.

    A counted bounded number of edges is one task's work; beyond it alternating large-star and small-star rounds run until nothing
    changes, each written to the shared folder.
    """
    if edges.count() <= COMPONENT_ROWS:

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if all_:
                out = union(*(np.concatenate(x) for x in zip(*all_)))
                for i in range(0, len(out[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in out], ["node", "root"])

        return save(edges.select("a", "b").coalesce(1).mapInArrow(one, "node long, root long"))
    files = lambda n: max(1, -(-n // max(1, COMPONENT_ROWS)))
    e = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    every = save(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, save(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").repartition("a", "b").distinct().coalesce(files(mark[0]) if mark else 64))
        forget(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    out = save(every.join(roots, every.node == roots.a, "left").select("node", F.coalesce("root", "node").alias("root")))
    forget(e, every)
    return out


class Known:
    """The links that a task has told, as a forest; forgotten when they are too many."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the link is news."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if len(self.up) > REMEMBERED:
            self.up.clear()
        self.up[max(a, b)] = min(a, b)
        return True


# -- buckets --------------------------------------------------------------------------------------------------


def parts(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """(columns, more): whole buckets of rows sorted by their first column, or a part of one bucket that is larger (more)."""
    lean()
    rest: list[np.ndarray] | None = None
    large = None  # the key of which parts have been given
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
        if large is not None:
            own = int(np.searchsorted(cols[0], large, "right"))
            while own >= part or own and own < len(cols[0]):
                n = min(own, part)
                yield [c[:n] for c in cols], True
                cols, own = [c[n:] for c in cols], own - n
            if own or not len(cols[0]):
                rest = cols
                continue
            large = None
        at = int(np.searchsorted(cols[0], cols[0][-1]))
        if at:
            yield [c[:at] for c in cols], False
        rest = [c[at:] for c in cols]
        while len(rest[0]) > part:
            large = rest[0][0]
            yield [c[:part] for c in rest], True
            rest = [c[part:] for c in rest]
    if rest is not None and len(rest[0]):
        yield rest, large is not None


def pairs_in(cols: list[np.ndarray], match: Match, known: Known | None, sift: Match | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The matching pairs of nodes (second column) that share a key (first column), sifted; with ``known`` links that are news, a forest."""
    key = cols[0]
    same = key[1:] == key[:-1]
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(key)]])
    sizes = np.diff(starts)
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    small = [c[few] for c in cols]
    for d in range(1, SMALL):
        i = np.flatnonzero(small[0][d:] == small[0][:-d])
        if not len(i):
            break
        for test in (match, sift):
            if test and len(i):
                i = i[test([c[i] for c in small[1:]], [c[i + d] for c in small[1:]])]
        if len(i):
            yield told(small[1][i], small[1][i + d], known)
    for k in np.flatnonzero(sizes > SMALL):
        own = [c[starts[k] : starts[k + 1]] for c in cols[1:]]
        if known is not None:
            yield forest(own, match, known)
        else:
            for at in range(0, len(own[0]), 256):
                i, j = np.nonzero(match([c[at : at + 256, None] for c in own], [c[None, :] for c in own]))
                i += at
                yield tuple(own[0][x] for x in sifted(own, own, i[i < j], j[i < j], sift))


def sifted(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray, sift: Match | None) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows (i of x, j of y) that the test leaves, so many at a time that their columns are a bounded amount of memory."""
    if sift is None or not len(i):
        return i, j
    ok = [sift([c[i[k : k + SIFTED]] for c in x], [c[j[k : k + SIFTED]] for c in y]) for k in range(0, len(i), SIFTED)]
    ok = np.concatenate(ok)
    return i[ok], j[ok]


def told(a: np.ndarray, b: np.ndarray, known: Known | None) -> tuple[np.ndarray, np.ndarray]:
    if known is None:
        return a, b
    both = np.unique(np.stack([a, b], 1), axis=0)
    both = both[[known.join(x, y) for x, y in both.tolist()]]
    return both[:, 0], both[:, 1]


def forest(own: list[np.ndarray], match: Match, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all nodes of a bucket that matching pairs join.

    A row is compared with all others unless it is in the component of the anchor, so no link between two components is missed.
    """
    node = own[0].tolist()
    label = np.array([known.root(x) for x in node])
    a, b = [], []

    def compare(i: int) -> None:
        hit = match([c[i : i + 1] for c in own], own) & (label != label[i])
        hit = np.flatnonzero(hit)
        if len(hit):
            labels, first = np.unique(label[hit], return_index=True)
            for j in hit[first].tolist():
                known.join(node[i], node[j])
                a.append(node[i])
                b.append(node[j])
            label[np.isin(label, labels) | (label == label[i])] = known.root(node[i])

    compare(0)
    labels, counts = np.unique(label, return_counts=True)
    anchor = int(np.flatnonzero(label == labels[counts.argmax()])[0])
    for i in range(1, len(node)):
        if label[i] != label[anchor]:
            compare(i)
    return np.array(a, np.int64), np.array(b, np.int64)


def bucket_pairs(keys: DataFrame, match: Match, *, true: bool, part: int = PART, sift: Match | None = None) -> DataFrame:
    """Saved pairs (a, b) of nodes that share a key and match, from rows (key, node, ...) of bigints; a < b, each once.

    match compares rows of the columns after the key, elementwise; it must be symmetric. If matches are ``true`` links, the pairs are
    a forest with the components of all matches; else they are all matches, and match has to leave out pairs that don't
    matter (the third column is then the node's root, and those of one root don't). ``sift`` is a dearer test of the matches, on rows
    of one length each, before they leave the worker.
    """
    names = keys.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known() if true else None
        for cols, more in parts(batches, part):
            for a, b in pairs_in(cols, match, known, sift):
                if len(a):
                    yield edge_rows(a, b)
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([cols[0][0]]), pa.array([np.stack(cols[1:]).tobytes()], pa.binary())], EDGE)

    # a parallel sort of all keys by number: no two tasks share a bucket
    found = save(keys.repartition("key").sortWithinPartitions("key").mapInArrow(find, "a long, b long, key long, rows binary"))
    pairs = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", "rows")
    if large.limit(1).count():
        pairs = pairs.unionByName(_across(large, names, pairs, match, true, part, sift))
    out = save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), compact=True)
    forget(found)
    return out


EDGE = ["a", "b", "key", "rows"]


def edge_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], EDGE)


def _across(large: DataFrame, names: list[str], pairs: DataFrame, match: Match, true: bool, part: int, sift: Match | None) -> DataFrame:
    """Pairs between the parts of large buckets: members outside a bucket's largest component, packed, against each part."""
    width = len(names) - 1

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, rows in zip(b.column(0).to_pylist(), b.column(1)):
                cols = np.frombuffer(rows.as_py(), np.int64).reshape(width, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cols.shape[1], key)), *map(pa.array, cols)], names)

    members = large.mapInArrow(unpack, ", ".join(f"{c} long" for c in names))
    if true:
        roots = components(save(pairs))
        members = members.join(roots, "node", "left").withColumn("__root", F.coalesce("root", "node"))
    else:
        members = members.withColumn("__root", F.col(names[2]))
    members = save(members.select(*names, "__root"))
    sizes = members.groupBy("key", "__root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("__root", F.struct("n", "__root")).alias("__most"), F.sum("n").alias("__n"))
    few = members.join(most, "key").where("__root <> __most")
    packed = few.groupBy("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("__n") / part)).alias("p")).agg(F.collect_list(F.struct(*names[1:])).alias("few"))  # some PART rows

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known() if true else None
        for b in batches:
            for rows, own in zip(b.column("rows"), b.column("few")):
                y = list(np.frombuffer(rows.as_py(), np.int64).reshape(width, -1))
                x = [c.to_numpy(zero_copy_only=False) for c in own.values.flatten()]
                for at in range(0, len(x[0]), 256):
                    i, j = np.nonzero(match([c[at : at + 256, None] for c in x], [c[None, :] for c in y]))
                    i, j = sifted(x, y, i + at, j, sift)
                    u, v = x[0][i], y[0][j]
                    u, v = u[u != v], v[u != v]
                    if true and len(u):
                        news = [known.join(s, t) for s, t in zip(u.tolist(), v.tolist())]
                        u, v = u[news], v[news]
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return large.join(packed, "key").select("rows", "few").mapInArrow(cross, "a long, b long")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (node, ...) with the root of each node; nodes without a link are their own."""
    few = roots.count() <= BROADCAST_ROOTS
    return rows.join(F.broadcast(roots) if few else roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

"""Near copies of whole documents: SimHash groups first, and a prefix filter for every other pair.

Texts are sets of word shingles; two texts are linked if the Jaccard similarity of their sets is 0.8 or more, and linked texts
are a class. Candidates come in two steps, and the exact similarity decides on all of them:

1. The operator's Golay keys join texts whose SimHash fingerprints differ in a few bits, as a forest; and in each bucket of a prefix
   hash all members are tried against the one that is most like the bucket's core. That settles most of a group with a
   number of trials in proportion to its members.
2. Buckets of prefix hashes that still hold more than one class: all pairs of different classes in them. In buckets of more than a
   few texts, as templates make them, rows carry a sketch of their set, and only pairs that it leaves possible get out of the worker.

Sets of similarity ``least`` share one of their size - ceil(least * size) + 1 first hashes in any common order, so step 2 misses no
pair. In the order, shingles that a sample of texts has often come last, which keeps buckets small and changes no
result. A pair is left out before its sets are read only where that is proven: by the sizes, by the places of the common hash in
the two orders, or by counts of hashes with common top bits (sketches), all bounds on the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.buckets import PART, SMALL, bucket_pairs, components, parts, with_roots
from quarry.llm.common import bounded_batches, forget, lean, save
from quarry.llm.simhash import close, golay_keys, majority, shingles

#: Words of a shingle, least Jaccard similarity of the shingle sets.
NEAR_WORDS, NEAR = 5, 0.8
#: One text of so many is read to tell common shingles; so many of the commonest (16 bytes each) go to the workers.
SAMPLE, COMMON = 16, 200_000
#: Texts that a task remembers, so that copies are not cut into shingles again.
REMEMBERED = 100_000
#: Keys of texts (some 60 bytes each) that are broadcast at most; above that texts are shuffled by their key.
BROADCAST_TEXTS = 1_000_000
#: Top bits of hashes that a sketch tells apart at most, and the number that stands for itself and more.
SKETCH_BITS, FULL = 24, 15
#: Counts of a byte each in the small sketch that goes with the rows of large buckets.
CELLS = 128


# -- sets -----------------------------------------------------------------------------------------------------


def text_key_of(col: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(col, F.lit(""))))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    own = shingles(text, words)
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in own), np.uint64, len(own)))


def prefix(hashes: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a sorted set in the order (count, hash), so many that two sets of similarity ``least`` share one of them.

    Such sets have at least ``least`` times the size of either in common, so that one which lacks all of a prefix of
    size - ceil(least * size) + 1 hashes has too few left. Any order does that is the same for all sets; rare ones first leave
    few sets to a hash. common is sorted; what isn't in it counts 0. An empty set has the prefix 0.
    """
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    cost = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        cost = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.argsort(cost, kind="stable")[: n - math.ceil(least * n - 1e-9) + 1]]


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes of a set there are for each value of their top bits, about one each: two counts in a byte, FULL for any above."""
    if not len(hashes):
        return b""
    bits = min(max(1, (len(hashes) - 1).bit_length()), SKETCH_BITS)
    n = np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), FULL).astype(np.uint8)
    return (n[0::2] | n[1::2] << 4).tobytes()


def cells(hashes: np.ndarray) -> np.ndarray:
    """The small sketch of a set: hashes by their top bits, CELLS counts of a byte each (255: that or more) as CELLS / 8 numbers."""
    n = np.bincount((hashes >> np.uint64(65 - CELLS.bit_length())).astype(np.int64), minlength=CELLS)
    return np.minimum(n, 255).astype(np.uint8).view(np.int64)


def may_share(least: float):
    """Whether two sets can be similar by their small sketches: rows (node, root, cells..., place << 32 | size)."""

    def test(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        a, b = (np.stack(z[2:-1], 1).view(np.uint8) for z in (x, y))
        least_of = np.minimum(a, b).astype(np.int32)
        least_of[least_of == 255] = 1 << 20  # may stand for more
        sx, sy = x[-1] & 0xFFFFFFFF, y[-1] & 0xFFFFFFFF
        return similar(np.minimum(least_of.sum(1), np.minimum(sx, sy)), sx, sy, least)

    return test


def most_common(a: bytes, b: bytes, na: int, nb: int) -> int:
    """As many hashes as two sets of these sketches and sizes can have in common."""
    if not a or not b:
        return min(na, nb)
    counts = []
    for s in (a, b):
        x = np.frombuffer(s, np.uint8)
        n = np.empty(2 * len(x), np.int64)
        n[0::2], n[1::2] = x & FULL, x >> 4
        n[n == FULL] = 1 << 20
        counts.append(n)
    x, y = sorted(counts, key=len)
    y = y.reshape(len(x), -1).sum(1)
    return min(na, nb, int(np.minimum(x, y).sum()))


def similar(common: int | np.ndarray, na: int | np.ndarray, nb: int | np.ndarray, least: float) -> bool | np.ndarray:
    """Whether sets with so many common elements reach the similarity; empty sets are equal."""
    return common >= least * (na + nb - common) - 1e-9


def may_be_near(least: float):
    """Whether two sets with a common hash at these places of their orders, none before, can be similar. Rows end with place << 32 | size."""

    def match(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        sx, px, sy, py = x[-1] & 0xFFFFFFFF, x[-1] >> 32, y[-1] & 0xFFFFFFFF, y[-1] >> 32
        common = np.minimum(sx - px, sy - py)
        return similar(common, sx, sy, least)

    return match


def _once(batches: Iterator[pa.RecordBatch], key: int, text: int) -> Iterator[tuple[list, list]]:
    """(keys, texts) without most copies of texts."""
    lean()
    known: set[bytes] = set()
    for b in batches:
        if len(known) > REMEMBERED:
            known.clear()
        keys, at = b.column(key).to_pylist(), []
        for i, k in enumerate(keys):
            if k not in known:
                known.add(k)
                at.append(i)
        yield [keys[i] for i in at], b.column(text).take(pa.array(at, pa.int64())).to_pylist()


def common_shingles(bodies: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingle hashes in a sample of (text, text_key), sorted, and their texts in it."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _once(batches, 1, 0):
            own = [shingle_set(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["shingle"])

    sample = bodies.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLE)) == 0).mapInArrow(every, "shingle long")
    counted = sample.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()  # bounded by COMMON
    hashes, counts = (top[c].to_numpy() for c in ("shingle", "n"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def drawn_sets(bodies: DataFrame, words: int, least: float) -> DataFrame:
    """(text_key, size, fp, sketch, cells, prefix) of each distinct text."""
    common, counts = common_shingles(bodies, words)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _once(batches, 1, 0):
            own = [shingle_set(t, words) for t in texts]
            first = [prefix(x, least, common, counts).view(np.int64) for x in own]
            arrays = [
                pa.array(keys, pa.binary()),
                pa.array([len(x) for x in own], pa.int64()),
                pa.array([majority(x) for x in own], pa.int64()),
                pa.array([sketch(x) for x in own], pa.binary()),
                pa.array([cells(x) for x in own], pa.list_(pa.int64())),
                pa.array(first, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["text_key", "size", "fp", "sketch", "cells", "prefix"])

    own = bodies.mapInArrow(draw, "text_key binary, size long, fp long, sketch binary, cells array<long>, prefix array<long>")
    return own.groupBy("text_key").agg(*(F.first(c).alias(c) for c in ("size", "fp", "sketch", "cells", "prefix")))


# -- candidates -----------------------------------------------------------------------------------------------


def fingerprint_pairs(drawn: DataFrame) -> DataFrame:
    """A forest over the texts whose fingerprints Golay keys link; texts of one fingerprint are tried against one of them."""
    prints = save(drawn.groupBy(F.col("fp").alias("node")).agg(F.min("drawn_node").alias("first")), compact=True)
    links = bucket_pairs(golay_keys(prints, triple=False), close, true=True)
    side = lambda s: prints.select(F.col("node").alias(s), F.col("first").alias(f"first_{s}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    inside = drawn.join(side("fp"), "fp").where("drawn_node <> first_fp").select(F.col("first_fp").alias("a"), F.col("drawn_node").alias("b"))
    out = save(between.unionByName(inside), compact=True)
    forget(links, prints)
    return out


def hub_pairs(keys: DataFrame, least: float, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(saved, pairs, members) of rows (key, node, at): in each bucket the rows that may be near the first one, whose hash comes first in its
    order, or the one before; and the rows (key, node, at, many) of all buckets of two or more."""
    match = may_be_near(least)
    names = ["a", "b", "key", "at"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, node, at of the first row of a bucket that comes in parts
        for (key, node, at), more in parts(batches, part):
            start = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
            hub, hub_at = node[first], at[first]
            if more:
                held = held if held is not None and held[0] == key[0] else (key[0], node[0], at[0])
                hub, hub_at = np.full(len(key), held[1]), np.full(len(key), held[2])
            x = [node, at]
            near = np.flatnonzero((hub != node) & match([hub, hub_at], x))
            near_last = 1 + np.flatnonzero(~start[1:] & match([c[:-1] for c in x], [c[1:] for c in x]))
            a, b = np.concatenate([hub[near], node[near_last - 1]]), np.concatenate([node[near], node[near_last]])
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            none = pa.nulls(len(both), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), none, none], names)
            alone = start & np.concatenate([start[1:], [True]])
            kept = np.flatnonzero(~alone | more)
            ends = np.append(np.flatnonzero(start), len(key))
            many = np.repeat((np.diff(ends) > SMALL) | more, np.diff(ends)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(many[kept]), pa.array(key[kept]), pa.array(at[kept])], names)

    found = save(keys.repartition("key").sortWithinPartitions("key", "at", "node").mapInArrow(find, "a long, b long, key long, at long"))
    return found, found.where("key is null").select("a", "b").distinct(), found.where("key is not null").select("key", F.col("a").alias("node"), "at", (F.col("b") > 0).alias("many"))


def rest_pairs(members: DataFrame, drawn: DataFrame, roots: DataFrame, tried: DataFrame, least: float) -> DataFrame:
    """Saved pairs (a, b), not tried before, of nodes with different roots that share a bucket and may be near; those of large
    buckets sifted by their small sketches."""
    of = with_roots(members, roots)
    may = may_be_near(least)
    match = lambda x, y: (x[1] != y[1]) & may(x, y)
    few = bucket_pairs(of.where("not many").select("key", "node", "root", "at"), match, true=False)
    large = of.where("many").select("key", "node", "root", "at")
    mixed = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    own = drawn.select(F.col("drawn_node").alias("node"), *(F.get("cells", F.lit(i)).alias(f"cell{i}") for i in range(CELLS // 8)))
    large = large.join(mixed, "key", "left_semi").join(own, "node")
    many = bucket_pairs(large.select("key", "node", "root", *own.columns[1:], "at"), match, true=False, sift=may_share(least))
    out = save(few.unionByName(many).distinct().join(tried, ["a", "b"], "left_anti"), compact=True)
    forget(few, many)
    return out


def verified(pairs: DataFrame, drawn: DataFrame, texts: DataFrame, bodies: DataFrame, words: int, least: float) -> DataFrame:
    """The saved pairs whose sets have the similarity."""
    side = lambda table, s, *cols: table.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in cols))
    known = drawn.select(F.col("drawn_node").alias("node"), "size", "sketch")
    both = pairs.join(side(known, "a", "size", "sketch"), "a").join(side(known, "b", "size", "sketch"), "b").where(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(("a", "b", "size_a", "size_b", "sketch_a", "sketch_b"))}
            ok = [similar(most_common(x.as_py(), y.as_py(), na, nb), na, nb, least) for x, y, na, nb in zip(c["sketch_a"], c["sketch_b"], c["size_a"].to_pylist(), c["size_b"].to_pylist())]
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = save(bounded_batches(both).select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(likely, "a long, b long"), compact=True)
    wanted = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    keyed = save(texts.join(wanted, "node").select("node", "text_key"), compact=True)
    few = F.broadcast(keyed) if keyed.count() <= BROADCAST_TEXTS else keyed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, own in _once(batches, 0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([shingle_set(t, words).tobytes() for t in own], pa.binary())], ["node", "shingles"])

    sets = bodies.join(few, "text_key").select("node", "text").mapInArrow(cut, "node long, shingles binary")
    sets = save(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    both = left.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b").select("a", "b", "shingles_a", "shingles_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                ok.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = save(both.mapInArrow(compare, "a long, b long"), compact=True)
    forget(sets, left, keyed)
    return out


# -- operators ------------------------------------------------------------------------------------------------


def near_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = NEAR_WORDS, least: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Classes of copies and near copies of whole texts.

    Returns (texts, classes): texts has (node, text_key, first, rows, same) for each distinct text: its smallest id, its rows, and those with
    that id; classes (node, root) for those with a link. Null texts count as empty; texts without words are copies of each
    other. Null ids come after all others. Other columns are not read; an empty table gives empty results.
    """
    df = bounded_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    bodies = df.select("text", text_key_of(F.col("text")).alias("text_key"))
    each = df.select("doc_id", text_key_of(F.col("text")).alias("text_key")).groupBy("text_key", "doc_id").agg(F.count("*").alias("n"))
    texts = each.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.sum("n").alias("rows"), F.coalesce(F.min_by("n", "doc_id"), F.sum("n")).alias("same"))
    texts = texts.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    texts = save(texts.withColumn("node", F.monotonically_increasing_id()))
    drawn = save(texts.select("text_key", F.col("node").alias("drawn_node")).join(drawn_sets(bodies, words, least), "text_key").drop("text_key"))
    prints = fingerprint_pairs(drawn)
    keys = drawn.select(F.posexplode("prefix").alias("place", "key"), F.col("drawn_node").alias("node"), "size")
    keys = keys.select("key", "node", F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("size")).alias("at"))
    found, pairs, members = hub_pairs(keys, least)
    check = lambda p: verified(p, drawn, texts, bodies, words, least)
    tried = save(prints.unionByName(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), compact=True)
    edges = check(tried)
    roots = components(edges)
    rest = rest_pairs(members, drawn, roots, tried, least)
    forget(found, prints, roots)
    more = check(rest)
    classes = components(save(edges.unionByName(more), compact=True))
    forget(drawn, tried, edges, rest, more)
    return texts.select("node", "text_key", "first", "rows", "same"), classes


def drop_near_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs without copies and near copies: of each class the row with the smallest id stays (null ids last).

    Rows that repeat id and text are one. Columns may have any names; an empty table gives an empty result.
    """
    names = docs.columns
    texts, classes = near_copies(docs, text=text, doc_id=doc_id, **how)
    of = texts.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = of.groupBy("root").agg(F.min_by("node", F.struct(F.col("first").isNull(), "first", "text_key")).alias("best"))
    # texts that have one row and no class stay as they are; only the others take part in the join
    others = of.join(best, "root").select(F.col("text_key").alias("__key"), (F.col("node") == F.col("best")).alias("__stays"), _id_key(F.col("first")).alias("__first"), (F.col("same") > 1).alias("__again"), ((F.col("rows") > 1) | (F.col("node") != F.col("best"))).alias("__special"))
    others = save(others.where("__special").drop("__special"), compact=True)
    d = docs.withColumn("__key", text_key_of(docs[text])).withColumn("__id", _id_key(docs[doc_id].cast("long")))
    if others.count() <= BROADCAST_TEXTS:
        joined = d.join(F.broadcast(others), "__key", "left").where("__stays is null or (__stays and __id = __first)")
    else:
        # joined by text and id, so that many copies of one text are many keys
        stay = others.where("__stays").withColumnRenamed("__first", "__id").select("__key", "__id", "__again", F.lit(True).alias("__stays"))
        alone = d.join(others.select("__key").distinct(), "__key", "left_anti").withColumn("__again", F.lit(False))
        joined = d.join(stay, ["__key", "__id"]).drop("__stays").unionByName(alone)
    # of rows that repeat id and text one stays: each task keeps one before they meet, however many there are
    again = F.coalesce("__again", F.lit(False))
    one = joined.where(again).groupBy("__key", "__id").agg(F.first(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))).alias("one"))
    return joined.where(~again).select(*names).unionByName(one.select(*(F.col(f"one.c{i}").alias(c) for i, c in enumerate(names))))


def _id_key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("-"))

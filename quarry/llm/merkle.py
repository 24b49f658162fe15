"""Merkle manifest of a dataset: a tree for each key over its rows' digests, and a tree over the keys' roots.

A node is the SHA-256 (lowercase hex, of its children's hex texts) of up to three consecutive nodes below. Rows are leaves, in the order of
their ids. The levels of a tree are taken several at a time: the leaves of an aligned block are in one task, where a postorder
recursion returns a subtree's digest and appends, while it unwinds, the siblings of each child to the leaves that the child contains.
The blocks' roots are the leaves of the next such traversal, until each key has one root; those go the same way to the root of all.

Plan: texts are read once, into digests. Rows find their place by a range sort over key and id: a key with a third of all rows is
many ranges, and a place is one in the range plus the rows of the key in the ranges before (one row for each range and key). A task has
blocks of at most 3^6 leaves. Proofs are put together from the top down over the block tables, each 3^6 times smaller
than the one below, then joined once to the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import clear_of, host_key, save

FAN = 3
#: Levels that one traversal takes.
LEVELS = 6
#: Rows of offsets, and of upper proofs (some kilobytes each), that are broadcast at most.
BROADCAST_OFFSETS, BROADCAST_PROOFS = 200_000, 5_000

PROOF = "array<struct<before: binary, after: binary>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 of the values in turn, each as its UTF-8 byte count, a colon and its text; null: a hyphen."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof make."""
    text = lambda c: F.lower(F.hex(c))
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(text(s.before), at, text(s.after)), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof as hex text, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.lower(F.hex(F.concat(s.before, s.after)))), ""), 256)


def traverse(digests: list[bytes], height: int) -> tuple[bytes, list[list[tuple[bytes, bytes]]]]:
    """The root of a block ``height`` levels above its leaves, and for each leaf its siblings before and after it at every level."""
    paths: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]

    def visit(lo: int, hi: int, height: int) -> bytes:
        if not height:
            return digests[lo]
        bounds = [*range(lo, hi, FAN ** (height - 1)), hi]
        below = [visit(a, b, height - 1) for a, b in zip(bounds, bounds[1:])]
        for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
            beside = b"".join(below[:j]), b"".join(below[j + 1 :])
            for path in paths[a:b]:
                path.append(beside)
        return hashlib.sha256(b"".join(below).hex().encode()).digest()

    return visit(0, len(digests), height), paths


def height_of(n: int, most: int) -> int:
    """Levels above n nodes until one is left, ``most`` at most."""
    height = 0
    while n > 1 and height < most:
        n, height = -(-n // FAN), height + 1
    return height


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (saved) with n, how many its key has, and i, its place among them: by key, then ``order``. Rows that agree come in any order."""
    sort = [F.col("key"), *order]
    placed = save(rows.repartitionByRange(*sort, F.xxhash64("row")).sortWithinPartitions(*sort).withColumn("mid", F.monotonically_increasing_id()))
    part = F.shiftright("mid", 33).alias("part")
    counts = placed.groupBy("key", part).agg(F.count("*").alias("here"), F.min("mid").alias("first"))
    own = Window.partitionBy("key")
    before = F.sum("here").over(own.orderBy("part")) - F.col("here")
    offsets = save(counts.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(own).alias("n")), compact=True)
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_OFFSETS else offsets
    out = placed.withColumn("part", part).join(offsets, ["key", "part"])
    return out.select(*rows.columns, (F.col("mid") + F.col("shift")).alias("i"), "n")


def block_of(place: Column | str) -> Column:
    place = F.col(place) if isinstance(place, str) else place
    return F.floor(place / F.lit(FAN**LEVELS)).cast("long")


def traversed(nodes: DataFrame) -> DataFrame:
    """nodes (key, i, n, digest, and others) with the proof up to the root of each one's block, and that root."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in nodes.schema)}, proof {PROOF}, block_root binary"
    levels = LEVELS

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        root, paths = traverse(block["digest"].to_pylist(), height_of(block["n"][0].as_py(), levels))
        flat = [x for p in paths for x in p]
        ends = [0]
        for p in paths:
            ends.append(ends[-1] + len(p))
        pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.binary()) for i in (0, 1)], ["before", "after"])
        block = block.append_column("proof", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
        return block.append_column("block_root", pa.array([root] * len(paths), pa.binary()))

    of = nodes.withColumn("block", block_of("i"))
    return of.groupBy("key", "block").applyInArrow(lambda block: run(block.drop_columns(["block"])), schema)


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The traversals from the leaves up, and (key, digest): the root of each key."""
    done = []
    while True:
        done.append(save(traversed(nodes)))
        first = done[-1].where(F.col("i") % FAN**LEVELS == 0)
        nodes = first.select("key", block_of("i").alias("i"), F.ceil(F.col("n") / FAN**LEVELS).alias("n"), F.col("block_root").alias("digest"))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return done, nodes.select("key", "digest")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, key: str = "source", order: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), more: dict[str, Column] | None = None) -> DataFrame:
    """For each row the columns ``keep``, its leaf digest over ``fields``, the root of its key, the root of all, and its proof.

    Leaves ascend by ``order`` (nulls first, ties by digest) in each key; keys ascend bytewise, null first. ``more`` are further columns to
    carry, computed from docs. A proof has the siblings before and after at each level, so that fold(leaf, proof) is the root.
    Nulls, empty texts and repeated rows are leaves like any other (of equal leaves, which one has which place isn't defined); an
    empty table gives an empty result. A kept column whose name is a result's gets underscores at its end.
    """
    more = more or {}
    names = clear_of(list(keep), ["leaf", "subroot", "root", "proof", *more])
    kept = {c: f"k{i}" for i, c in enumerate(keep)}
    added = {c: f"m{i}" for i, c in enumerate(more)}
    leaves = docs.select(
        host_key(docs[key].cast("string")).alias("key"), docs[order].alias("by"), F.unhex(leaf_digest(docs[f] for f in fields)).alias("digest"), F.monotonically_increasing_id().alias("row"),
        *(docs[c].alias(k) for c, k in kept.items()), *(x.alias(added[c]) for c, x in more.items()),
    )
    leaves = save(leaves)
    tables, subroots = climbed(ranked(leaves, [F.col("by").asc_nulls_first(), F.col("digest")]).drop("by", "row"))
    top = save(subroots.select(F.lit(0).alias("key"), F.col("key").alias("of"), "digest", F.lit(0).alias("row")), compact=True)
    above, root = climbed(ranked(top, [F.col("of")]).drop("row"))
    up = _down(above).join(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    up = up.select(F.col("of").alias("key"), F.lit(0).cast("long").alias("i"), "proof", F.col("digest").alias("subroot"), "root")
    out = _down([*tables, up], ["subroot", "root"])
    text = lambda c: F.lower(F.hex(c))
    return out.select(*(F.col(k).alias(names[c]) for c, k in kept.items()), *(F.col(k).alias(c) for c, k in added.items()), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof")


def _down(tables: list[DataFrame], extra: list[str] = []) -> DataFrame:  # noqa: B006
    """The lowest table, its proofs continued by those of the blocks in the tables above, and the columns ``extra`` of the last."""
    up = tables[-1]
    for below in reversed(tables[:-1]):
        of = up.select(F.col("key").alias("__key"), F.col("i").alias("__i"), F.col("proof").alias("__proof"), *extra)
        of = F.broadcast(of) if of.count() <= BROADCAST_PROOFS else of
        up = below.join(of, (below["key"] == of["__key"]) & (block_of(below["i"]) == of["__i"]))
        up = up.withColumn("proof", F.concat("proof", "__proof")).drop("__key", "__i", "__proof", "block_root")
    return up

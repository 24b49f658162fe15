"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words; a document of a source with target / size = r is taken floor(r) times, and once
more with probability r - floor(r). The fractional parts go through the flight phase of the cube method: probabilities
move along the null space of the constraints (words and documents of the source), which keeps both totals, until each is
0 or 1. Flight runs in bounded blocks of a source; each block leaves at most two documents undecided, which
meet in blocks of the next level, until one block is left for each source; there the landing drops the document
constraint, then tosses for the last one.

Plan: sources are aggregated with map-side combine and stay a DataFrame; only scalars reach the driver (the water level
of the targets). Equal (id, source, size) rows are one unit with a count, so repeats of a row don't pile up. The blocks of
a source are dealt by a hash of the unit, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import n_words, save

#: Documents in a block of the first level, and blocks that meet at the next.
BLOCK = 2048
FAN_IN = 512
#: A document is taken so many times its size at most.
MOST = 3
# The weights that sources get in turn.
WEIGHTS = (1, 2, 3)
#: Rows of source statistics that are broadcast at most.
BROADCAST_SOURCES = 100_000


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """The probabilities after the flight phase: 0 or 1 but for two at most; with ``land`` for none.

    At all steps before landing sum(pi) and sum(pi * size) stay what they were.
    """
    p, s = pi.tolist(), size.tolist()
    active: list[int] = []
    draws, d = rng.random(2 * len(p) + 8).tolist(), 0

    def move(idx: list[int], u: list[float]) -> None:
        nonlocal d
        up = down = float("inf")
        for i, x in zip(idx, u):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        for i, x in zip(idx, u):
            v = p[i] + step * x
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v

    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = (s[i] for i in active)
            u = [b - c, c - a, a - b]
            if a == b == c:
                u = [1.0, -1.0, 0.0]
            m = max(map(abs, u))
            move(active, [x / m for x in u])
            active = [i for i in active if 0 < p[i] < 1]
    if len(active) == 2 and s[active[0]] == s[active[1]]:
        move(active, [1.0, -1.0])
        active = [i for i in active if 0 < p[i] < 1]
    if land:
        if len(active) == 2:
            a, b = (max(s[i], 1) for i in active)
            m = max(1 / a, 1 / b)
            move(active, [1 / a / m, -1 / b / m])
            active = [i for i in active if 0 < p[i] < 1]
        for i in active:
            p[i] = 1.0 if draws[d] < p[i] else 0.0
            d += 1
    return np.array(p)


def source_targets(rows: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, place, target) from rows (source, size): min(most x size, level x weight), all targets together the corpus.

    Rows that repeat count each; a null source is a source, the last; an empty table gives an empty result.
    """
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = [F.col("source").asc_nulls_last()]
    placed = save(stats.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()), compact=True)
    # place in code point order: rows before in the partition, plus those of the partitions before (one row for each)
    part = F.shiftright("mid", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    parts = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    placed = placed.withColumn("part", part).join(F.broadcast(parts), "part")
    place = F.col("before") + F.col("mid") - F.shiftleft("part", 33)
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    w = save(placed.withColumn("place", place).select("source", "source_size", "n", "place", weight.cast("double").alias("weight")), compact=True)
    level, capped = 0.0, -1
    while True:  # water-filling; the level only rises, and each turn caps at least one more source
        cap = F.col("weight") * level >= most * F.col("source_size")
        got = w.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(cap, most * F.col("source_size"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~cap, F.col("weight"))), F.lit(0.0)).alias("open"), F.count_if(cap).alias("capped")).first()
        if not got["all"] or not got.open or got.capped == capped:
            break
        capped, level = got.capped, (got["all"] - got.full) / got.open
    return w.select("source", "source_size", "n", "place", F.least(most * F.col("source_size").cast("double"), F.col("weight") * level).alias("target"))


def _flights(units: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    def fly(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])  # nulls last
        rng = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        pi = flight(block["pi"].to_numpy(), block["size"].to_numpy().astype(float), rng, last)
        return block.set_column(block.schema.get_field_index("pi"), "pi", pa.array(pi, pa.float64()))

    return units.groupBy("place", "bucket").applyInArrow(fly, units.schema)


def cube_mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """A row for each distinct (doc_id, source, size): its count c, the target of its source, and how often it is taken.

    The first ``more`` of the c rows are taken copies + 1 times, the others copies times. Null text: size 0; such documents
    count for the document balance alone. A null source is a source of its own, the last. Reruns agree: the
    draws depend on ids, sizes and sources. An empty table gives an empty result.
    """
    of = n_words(docs[text]) if size is None else size
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[source].alias("source"), of.cast("long").alias("size"))
    units = save(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("c")), compact=True)
    stats = source_targets(units.select("source", (F.col("size") * F.col("c")).alias("size"), "c"), weights=weights, most=most)
    stats = save(stats, compact=True)
    few = stats.count() <= BROADCAST_SOURCES
    joined = units.join(F.broadcast(stats) if few else stats, units.source.eqNullSafe(stats.source)).drop(stats.source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.round(rate, 12)
    blocks = F.ceil(F.col("n") / BLOCK)
    order = F.xxhash64("doc_id", "size", F.lit(seed))
    u = joined.select(
        "doc_id", "source", "size", "c", "source_size", "target", "place", order.alias("order"),
        F.pmod(F.xxhash64(order), blocks).alias("bucket"),
        F.floor(rate).alias("whole"),
        (F.col("c") * (rate - F.floor(rate))).alias("extra"),
    )
    # of c equal rows a whole number is taken once more for certain; the rest of the expectation is one unit of the cube
    u = u.withColumn("more", F.floor("extra")).withColumn("pi", F.col("extra") - F.col("more")).drop("extra")
    blocks_left = int(stats.agg(F.max(blocks)).first()[0] or 0)
    done, level = None, 0
    while True:
        flown = save(_flights(u, seed, level, blocks_left <= 1), compact=True)
        decided = flown if blocks_left <= 1 else flown.where("pi <= 0 or pi >= 1")
        done = decided if done is None else done.unionByName(decided)
        if blocks_left <= 1:
            break
        u = flown.where("pi > 0 and pi < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        blocks_left, level = -(-blocks_left // FAN_IN), level + 1
    return done.select("doc_id", "source", "size", "c", "source_size", "target", F.col("whole").alias("copies"), (F.col("more") + F.round("pi").cast("long")).alias("more"))


def taken_rows(mix: DataFrame) -> DataFrame:
    """One row for each document row, with taken: the words the mix takes from it, repeats counted.

    Rows that repeat are as many as in the documents; null ids and sources are kept; an empty mix gives an empty result.
    """
    each = mix.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("k"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + (F.col("k") <= F.col("more")).cast("long"))).alias("taken"))


def mixed_documents(docs: DataFrame, mix: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Repeated rows are numbered; single ones, the rule, aren't sorted.

    Null ids, sources and texts match their own units of the mix. Columns may have any names but the operator's own (c, copies, more and
    names that begin with two underscores). An empty table gives an empty result.
    """
    names = docs.columns
    d = docs.select("*", n_words(docs[text]).alias("__size"))
    m = mix.select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__n"), "c", "copies", "more")
    j = d.join(m, d[doc_id].cast("long").eqNullSafe(m["__i"]) & d[source].eqNullSafe(m["__s"]) & (d["__size"] == m["__n"]))
    single = j.where("c = 1").withColumn("__k", F.lit(1))
    again = j.where("c > 1").withColumn("__k", F.row_number().over(Window.partitionBy("__i", "__s", "__n").orderBy(F.xxhash64(text))))
    both = single.unionByName(again).withColumn("__times", F.col("copies") + (F.col("__k") <= F.col("more")).cast("long"))
    return both.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*names)

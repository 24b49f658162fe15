"""Minimum-cost-flow resharding.

Documents lie in old shards of uneven size. Each old shard is cut into a fixed number of blocks by a hash; the
blocks' bytes and rows are aggregated with map-side combine into a table whose size doesn't depend on the corpus
(old shards x blocks). On the driver a minimum-cost flow from old shard sizes to new capacities says how many bytes
go from where to where (moving costs a byte's worth, staying is free), and blocks are picked to realise it.
Rows then get their shard by a lookup of their block. Slots are numbered inside a block and offset by the blocks before
it in the shard, so that no task sorts a whole shard.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import clear_of, save

SHARDS = 16
BLOCKS = 256


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at the least number of moved bytes (i == j is free).

    Successive shortest augmenting paths on the bipartite residual graph. sum(capacity) must reach sum(supply).
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are smaller than the shards")
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    cost = lambda i, j: int(i != j)
    n, m = len(supply), len(capacity)
    for s in range(n):
        while left[s]:
            # Bellman-Ford: old shards are nodes 0..n-1, new ones n..n+m-1
            dist = [float("inf")] * (n + m)
            via = [-1] * (n + m)
            dist[s] = 0
            changed = True
            while changed:
                changed = False
                for i in range(n):
                    if dist[i] == float("inf"):
                        continue
                    for j in range(m):
                        if dist[i] + cost(i, j) < dist[n + j]:
                            dist[n + j], via[n + j], changed = dist[i] + cost(i, j), i, True
                for (i, j), f in flow.items():
                    if f and dist[n + j] - cost(i, j) < dist[i]:
                        dist[i], via[i], changed = dist[n + j] - cost(i, j), n + j, True
            end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
            path, at = [], n + end
            while at != s:
                path.append((via[at], at))
                at = via[at]
            amount = min([left[s], room[end], *(flow[b, a - n] for a, b in path if a >= n)])
            for a, b in path:
                if a < n:
                    flow[a, b - n] += amount
                else:
                    flow[b, a - n] -= amount
            left[s] -= amount
            room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def plan_transfers(blocks: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard, for blocks (old, block, bytes), with new sizes near equal.

    The flow between shards is exact; blocks are whole, so each transfer is filled with the largest blocks that fit and
    the rest goes, largest first, to the shard with the most room left.
    """
    total = sum(b for *_, b in blocks)
    old = defaultdict(list)
    for o, k, b in blocks:
        old[o].append((b, k))
    sources = sorted(old)
    # old shards beyond the new ones have no home: give them an index of their own
    index = {o: o if 0 <= o < shards else shards + n for n, o in enumerate(sources)}
    supply = [0] * (max([shards - 1, *index.values()]) + 1)
    for o in sources:
        supply[index[o]] = sum(b for b, _ in old[o])
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    flow = min_cost_flow(supply, capacity)
    where, room, rest = {}, list(capacity), []
    for o in sources:
        i, mine = index[o], sorted(old[o], reverse=True)
        # what stays is filled first, then the other transfers
        targets = sorted((j for (a, j) in flow if a == i), key=lambda j: (j != i, j))
        want = {j: flow[i, j] for j in targets}
        for b, k in mine:
            j = next((j for j in targets if want[j] >= b), None)
            if j is None:
                rest.append((b, o, k))
            else:
                want[j] -= b
                room[j] -= b
                where[o, k] = j
    heap = [(-r, j) for j, r in enumerate(room)]
    heapq.heapify(heap)
    for b, o, k in sorted(rest, key=lambda x: (-x[0], x[1:])):
        r, j = heapq.heappop(heap)
        where[o, k] = j
        heapq.heappush(heap, (r + b, j))
    return where


def reshard(docs: DataFrame, *, text: str = "text", old_shard: Column, doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """The columns ``keep``, and for each row its size, old shard, new shard and slot; the sizes of new shards are near equal.

    old_shard gives small integers: at most ``shards`` x 16 of them, else it raises. Size is UTF-8 bytes + 1 (null text: 1).
    Slots count from 0 without gaps in each shard. Equal rows are dealt to all blocks of their old shard by their place in the input, so
    that a text or row that repeats fills no block by itself; reruns over the same files agree. Null ids are
    allowed. An empty table gives an empty result. A kept column whose name is a result's gets underscores at its end.
    """
    spark = docs.sparkSession
    body = F.coalesce(docs[text], F.lit(""))
    out = clear_of(list(keep), ["size", "text_crc32", "old_shard", "shard", "slot"])
    kept = {c: f"__k{i}" for i, c in enumerate(keep)}
    rows = docs.select(
        *(docs[c].alias(k) for c, k in kept.items()),
        docs[doc_id].alias("__id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = save(rows)  # the texts are read once, and a row keeps its number
    rows = rows.withColumn("block", F.pmod(F.xxhash64("__id", "text_crc32", "__row"), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    got = sizes.limit(shards * 16 * blocks + 1).collect()  # bounded by the two parameters
    if len(got) > shards * 16 * blocks:
        raise ValueError(f"more than {shards * 16} old shards")
    where = plan_transfers(sorted((r.old_shard, r.block, r.bytes) for r in got), shards)
    counts = {(r.old_shard, r.block): r.rows for r in got}
    offset, at = [], defaultdict(int)
    for (o, k), j in sorted(where.items()):
        offset.append((o, k, j, at[j]))
        at[j] += counts[o, k]
    plan = spark.createDataFrame(offset, "old_shard int, block int, shard int, __before long")
    placed = rows.join(F.broadcast(plan), ["old_shard", "block"])
    inside = Window.partitionBy("old_shard", "block").orderBy("__id", "text_crc32", "size", "__row")
    placed = placed.withColumn("slot", F.col("__before") + F.row_number().over(inside) - 1)
    return placed.select(*(F.col(k).alias(out[c]) for c, k in kept.items()), "size", "text_crc32", "old_shard", "shard", "slot")


def rewrite(spark: SparkSession, old: str, new: str, placed: DataFrame, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", schema: StructType | None = None) -> list[int]:
    """Write the new layout of a table stored as old/shard=N. Returns the shards that had to be rewritten.

    A shard that neither gains nor loses rows keeps its files: they are not read here, and the caller goes on using them.
    The others are written to new/shard=N, sorted by slot. Every row is written once: rows find their place by id, size, CRC and old
    shard, nulls included, and rows that agree in all of these are numbered, since any of their places does for any of them.
    An empty table, for which ``schema`` must be given (its files have none), and a layout that stays make a new layout without files.
    """
    moved = placed.where("old_shard <> shard").agg(F.collect_set("old_shard").alias("a"), F.collect_set("shard").alias("b")).first()
    touched = sorted({*moved.a, *moved.b} & set(range(shards)))
    lost = sorted({*moved.a, *touched})
    reader = spark.read.schema(schema) if schema else spark.read
    stored = reader.parquet(old).where(F.col("shard").isin(lost))
    names = [c for c in stored.columns if c != "shard"]
    body = F.coalesce(F.col(text), F.lit(""))
    key = {"__id": F.col(doc_id), "__size": (F.octet_length(body) + 1).cast("long"), "__crc": F.crc32(body.cast("binary")), "__old": F.col("shard").cast("int")}
    own = Window.partitionBy(*key).orderBy(F.xxhash64(*(c for c in names if "map<" not in stored.schema[c].dataType.simpleString())))
    rows = stored.withColumns(key).drop("shard").withColumn("__n", F.row_number().over(own))
    at = {"id": doc_id, "size": "size", "crc": "text_crc32", "old": "old_shard"}
    place = Window.partitionBy(*at.values()).orderBy("shard", "slot")
    to = placed.where(F.col("old_shard").isin(lost)).select(*(F.col(c).alias(f"__to_{k}") for k, c in at.items()), F.row_number().over(place).alias("__to_n"), "shard", F.col("slot").alias("__slot"))
    same = [F.col(f"__{k}").eqNullSafe(F.col(f"__to_{k}")) for k in (*at, "n")]
    out = rows.join(to, same).repartition("shard", F.floor(F.col("__slot") / 1_000_000)).sortWithinPartitions("shard", "__slot").select(*names, "shard")
    out.write.mode("overwrite").partitionBy("shard").parquet(new)
    return touched

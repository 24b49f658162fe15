"""Exact top-k inner-product search with a pivot table.

Every vector has its precomputed distances to a set of pivots. By the triangle inequality the largest difference of two
vectors' pivot distances is a lower bound of their own distance, and with the norms an upper bound of their inner
product. For each query the candidates of a block are evaluated in the order of that bound, until the bound is below the
k-th best score: then no candidate that is left can matter. Pivots are rows of the table too: the k-th best score among
them starts the search of every block. The origin is always a pivot (its bound is Cauchy and Schwarz's).

Plan: candidates are packed into blocks of bounded size, one binary row each, written once; so are the queries. A query
block goes to every candidate block by an equality join on the block number; pairs of blocks stream through the
workers one at a time. Each pair returns k rows a query at most, and a window with a group limit merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import save

K = 5
SCALE = 256
#: Rows in a candidate block, queries in a query block, pivots, candidates evaluated at once.
BLOCK, QUERIES, PIVOTS, CHUNK = 4096, 512, 32, 64
#: Vector lengths that have pivots of their own; vectors of other lengths are searched with the origin alone.
LENGTHS = 16


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has a null or non-finite component."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(pivots + 1, n) distances; the last row is the norm."""
    sq = (v * v).sum(1)
    d = [np.sqrt(np.maximum(sq - 2 * (v @ p) + p @ p, 0)) for p in pivots]
    return np.array([*d, np.sqrt(sq)], np.float64).reshape(len(pivots) + 1, len(v))


def search_block(q: np.ndarray, qd: np.ndarray, own: np.ndarray, least: np.ndarray, x: np.ndarray, xd: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best candidates of a block: (query, places, scores).

    own has the queries' rows, row those of the candidates; least is the k-th best score known for each query.
    """
    qs, xs = qd[-1] ** 2, xd[-1] ** 2
    exact = x.astype(np.int64)
    for i in range(len(q)):
        low = np.abs(xd[0] - qd[0, i])
        for p in range(1, len(xd)):
            np.maximum(low, np.abs(xd[p] - qd[p, i]), out=low)
        # one more for rounding: the bound must never be too small
        bound = (qs[i] + xs - low * low) / 2 * (1 + 1e-9) + 1 + 1e-9 * (qs[i] + xs)
        floor = least[i]
        order = np.flatnonzero(bound >= floor)
        order = order[np.argsort(-bound[order], kind="stable")]
        got, scores = [], []
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            if bound[part[0]] < floor:
                break
            part = part[row[part] != own[i]]
            s = exact[part] @ q[i].astype(np.int64)
            got.append(part)
            scores.append(s)
            both = np.concatenate(scores)
            if len(both) >= k:
                floor = max(floor, np.partition(both, len(both) - k)[len(both) - k])
        if not got:
            continue
        place, score = np.concatenate(got), np.concatenate(scores)
        best = np.lexsort((ids[place], -score))[:k]
        best = best[score[best] >= least[i]]
        yield i, place[best], score[best]


def _packed(rows: DataFrame, pivots: dict[int, list], size: int) -> DataFrame:
    """A row for each (length, block): its ids, rows, vectors and pivot distances as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), n)
        d = pivot_distances(v.astype(np.float64), np.array(own := pivots.get(n, []), np.float64).reshape(len(own), n))
        return pd.DataFrame({"n": [n], "block": [int(pdf["block"].iloc[0])], "rows": [len(pdf)], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "row": [pdf["row"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "distances": [d.tobytes()]})

    return save(rows.groupBy("n", "block").applyInPandas(pack, "n int, block long, rows int, ids binary, row binary, vectors binary, distances binary"))


def topk_search(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row, ties to the smaller id.

    Only vectors of the same length are compared. Vectors that are null or hold null or non-finite components take no part, nor do
    rows with a null id. A row is no candidate of its own, but other rows with its id are; rows with equal ids and scores
    are ranked in any order. Scores are exact 64-bit integers as long as components stay below 2^31 / sqrt(length). Fewer
    than k candidates give as many ranks; an empty table gives an empty result.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector], scale).alias("v"), is_query.alias("query"))
    rows = save(rows.where("id is not null and v is not null").withColumn("n", F.size("v")).withColumn("row", F.monotonically_increasing_id()))
    lengths = rows.groupBy("n").agg(F.count("*").alias("rows"), F.count_if("query").alias("queries"))
    blocks = lengths.select("n", F.ceil(F.col("rows") / BLOCK).alias("blocks"), F.ceil(F.col("queries") / QUERIES).alias("query_blocks"))
    common = [r.n for r in lengths.orderBy(F.desc("rows"), "n").limit(LENGTHS).collect()]
    first = Window.partitionBy("n").orderBy(F.xxhash64("id"), "row")
    chosen = rows.where(F.col("n").isin(common)).select("n", "id", "row", "v", F.row_number().over(first).alias("r")).where(F.col("r") <= PIVOTS).collect()  # LENGTHS x PIVOTS vectors at most
    pivots: dict[int, list] = {}
    pivot_rows: dict[int, list] = {}
    for r in sorted(chosen, key=lambda r: r.r):
        pivots.setdefault(r.n, []).append(r.v)
        pivot_rows.setdefault(r.n, []).append(r.row)
    dealt = rows.join(blocks, "n")
    cands = _packed(dealt.withColumn("block", F.pmod(F.xxhash64("row"), "blocks")), pivots, BLOCK)
    asked = _packed(dealt.where("query").withColumn("block", F.pmod(F.xxhash64("row"), "query_blocks")), pivots, QUERIES)
    spread = asked.join(blocks.select("n", "blocks"), "n").withColumn("cand", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = cands.select("n", "block", "ids", "row", "vectors", "distances")
    right = spread.select(F.col("n").alias("qn"), F.col("cand"), F.col("ids").alias("qids"), F.col("row").alias("qrow"), F.col("vectors").alias("qvectors"), F.col("distances").alias("qdistances"))
    pairs = left.join(right, (F.col("n") == F.col("qn")) & (F.col("block") == F.col("cand"))).drop("qn", "cand", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i8 = lambda x: np.frombuffer(x, np.int64)
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                qids, qrow, ids, row = i8(t.qids), i8(t.qrow), i8(t.ids), i8(t.row)
                q, x = i8(t.qvectors).reshape(len(qids), t.n), i8(t.vectors).reshape(len(ids), t.n)
                least = np.full(len(q), np.iinfo(np.int64).min)
                own = pivots.get(t.n, [])
                if len(own) > k:
                    s = q @ np.array(own, np.int64).T
                    s[qrow[:, None] == np.array(pivot_rows[t.n])[None, :]] = np.iinfo(np.int64).min
                    least = np.partition(s, len(own) - k, axis=1)[:, len(own) - k]
                out = [(qids[i], qrow[i], ids[p], s) for i, ps, ss in search_block(q, np.frombuffer(t.qdistances).reshape(-1, len(q)), qrow, least, x, np.frombuffer(t.distances).reshape(-1, len(x)), row, ids, k) for p, s in zip(ps, ss)]
                yield pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"]).astype("int64")

    found = pairs.mapInPandas(search, "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact dense search over vectors that are stored by cell: partitions that can't hold a result are not read.

Vectors are dealt to the nearest of a number of centroids (by angle), which a few rounds over a bounded sample have placed; a cell's radius is the
largest angle of its vectors. Angles obey the triangle inequality, so no vector of a cell is nearer to a query than the angle to the
centroid less the radius. The nearest cells of each query are searched first; their k-th scores are thresholds, and only cells that may
reach one are read then. Centroids change the work, not the result. Vectors without clusters have radii that rule out little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from quarry.operators.retrieval import BROADCAST_FLOATS, PREFETCH, dense_topk, rows_of, unit

#: Cells, vectors of the sample that places their centroids, and rounds of that.
CELLS, SAMPLE, ROUNDS = 64, 10_000, 8
#: Scores have six places; angles of doubles are this exact.
SLACK = 2e-6
#: The cell of zero vectors, which have no angle: it is always read.
ZERO = -1


@dataclass(frozen=True)
class CellIndex:
    """vectors (doc_id, vector, cell), stored by cell; and for each cell its number, vectors, radius and centroid: CELLS rows, so on the driver."""

    vectors: DataFrame
    cells: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    centroids: np.ndarray


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def place_centroids(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    if not len(x):
        return x
    at = x[np.random.default_rng(0).permutation(len(x))[:n]]
    for _ in range(rounds):
        own = (x @ at.T).argmax(1)
        at = unit(np.stack([x[own == i].sum(0) if (own == i).any() else at[i] for i in range(len(at))]))
    return at


def write_cells(vectors: DataFrame, where: str, *, id_col: str = "vec_id", vector: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> CellIndex:
    """Store the vectors by cell under a folder, and open them. Rows without a vector are left out; all vectors have one length."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    some = v.orderBy(F.xxhash64("doc_id")).limit(sample).select("vector").toArrow().column("vector").combine_chunks()  # ``sample`` rows at most
    x = unit(rows_of(some))
    centroids = place_centroids(x[np.abs(x).sum(1) > 0] if len(x) else x, cells)
    out = StructType([v.schema["doc_id"], StructField("vector", ArrayType(DoubleType())), StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    sent = spark.sparkContext.broadcast(centroids)  # ``cells`` vectors

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = unit(rows_of(b.column(1)))
                to = angles(y, sent.value) if len(sent.value) else np.zeros((len(y), 1))
                none = ~y.any(1)
                cell = np.where(none, ZERO, to.argmin(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(np.where(none, 0, to.min(1)))], ["doc_id", "vector", "cell", "angle"])

    v.mapInArrow(deal, out).repartitionByRange("cell", F.xxhash64("doc_id")).write.partitionBy("cell").parquet(f"{where}/vectors")
    stored = spark.read.schema(out).parquet(f"{where}/vectors")
    found = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect()  # a row for each cell
    number = np.array([r.cell for r in found], np.int64)
    own = centroids[np.maximum(number, 0)] if len(centroids) else np.zeros((len(number), 0))
    return CellIndex(stored.select("doc_id", "vector", "cell"), number, np.array([r.n for r in found], np.int64), np.array([r.radius for r in found]), own)


def cells_topk(index: CellIndex, queries: DataFrame, *, query_id: str = "query_id", query_vector: str = "query_vector", k: int = PREFETCH) -> tuple[DataFrame, list[int]]:
    """((query_id, doc_id, score, rank), the cells that were read): exact cosine top-k, as dense_topk over all vectors.

    More queries than BROADCAST_FLOATS numbers read every cell: their thresholds are not the driver's to hold.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    search = lambda cells: dense_topk(index.vectors.where(F.col("cell").isin([int(c) for c in cells])), queries, id_col="doc_id", vector="vector", query_id=query_id, query_vector=query_vector, k=k)
    floats = q.agg(F.sum(F.size("v"))).first()[0] or 0
    if not index.centroids.size or not floats or floats > BROADCAST_FLOATS:
        return search(index.cells), index.cells.tolist()
    asked = q.toArrow()  # BROADCAST_FLOATS at most
    ids, x = asked.column("query_id").to_pylist(), unit(rows_of(asked.column("v").combine_chunks()))
    to = angles(x, index.centroids)
    near = to.argsort(1)
    # the nearest cells of each query that have k vectors together
    enough = np.cumsum(index.sizes[near], 1)
    first = {int(index.cells[c]) for row, n in zip(near, enough) for c in row[: int(np.searchsorted(n, k)) + 1]}
    kth = {r.query_id: r.score for r in search(first).where(F.col("rank") == k).select("query_id", "score").collect()}  # a row for each query
    least = np.array([kth.get(i, -2.0) for i in ids])
    most = np.cos(np.maximum(to - index.radii[None, :], 0))  # no vector of a cell scores more
    may = (most >= least[:, None] - SLACK) | ~x.any(1)[:, None] | (index.cells == ZERO)[None, :]
    wanted = sorted(first | set(index.cells[may.any(0)].tolist()))
    return search(wanted), wanted

"""Retrieval: BM25 over an inverted index, exact dense top-k, and reciprocal-rank fusion.

All operators take a DataFrame of queries; one query is the case of one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.functions.text import normalize_text, tokens

K1, B = 1.2, 0.75
RRF_K = 60
PREFETCH = 300
#: Numbers by which an index stores its postings.
TERM_BUCKETS = 64
#: Rows of query terms or query vectors that are broadcast at most; above that the plan joins, or takes blocks.
BROADCAST_TERMS = 500_000
BROADCAST_FLOATS = 4_000_000
#: Floats of a block of query vectors that meets blocks of vectors, and scores that a worker holds at once.
BLOCK_FLOATS = 500_000
SCORES = 2_000_000


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k in each group. The bound right above the window lets Spark cut each task's groups first."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def small(df: DataFrame, rows: int = BROADCAST_TERMS) -> bool:
    """Whether df has at most so many rows."""
    return df.count() <= rows


def _tasks(spark: SparkSession) -> int:
    """Tasks of an exchange whose partitioning later steps rely on."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# -- lexical --------------------------------------------------------------------------------------------------


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(normalize_text(text)))).alias("term"))


def term_bucket(term: Column | str, buckets: int = TERM_BUCKETS) -> Column:
    """Where an index has a term: postings are stored by this number, and a query reads those of its own terms."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_postings(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The inverted index: postings (bucket, term, doc_id, tf, dl) and lengths (doc_id, dl). A posting has its document's length."""
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(normalize_text(text)).alias("tokens")).withColumn("dl", F.coalesce(F.size("tokens"), F.lit(0)).cast("long"))
    postings = t.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    return postings.select(term_bucket("term").alias("bucket"), "term", "doc_id", "tf", "dl"), t.select("doc_id", "dl")


def term_counts(df: DataFrame) -> DataFrame:
    """df with the terms of each row's tokens as ``terms``, an array of (term, tf), in place of ``tokens``; of null: null.

    They are counted inside the row, where sorted tokens make a run of each term: no exchange, and no map of every document's terms. Whoever
    explodes them writes them first: Spark puts a filter on what it explodes, which would split the texts again.
    """
    last = F.size("__words")
    t = df.withColumn("__words", F.sort_array("tokens")).drop("tokens")
    t = t.withColumn("__starts", F.array_compact(F.transform("__words", lambda x, i: F.when((i == 0) | (x != F.get(F.col("__words"), i - 1)), i))))
    run = lambda i, at: F.struct(F.get(F.col("__words"), i).alias("term"), (F.coalesce(F.get(F.col("__starts"), at + 1), last) - i).cast("long").alias("tf"))
    return t.withColumn("terms", F.transform("__starts", run)).drop("__words", "__starts")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl): documents, and their mean length."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df). The count reads tf, so that its exchange is the one that the scores read, and is reused."""
    return tf.groupBy("term").agg(F.sum(F.least(F.col("tf"), F.lit(1))).alias("df"))


def bm25_scores(matches: DataFrame, stats: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) from matches (query_id, term, doc_id, tf, dl, df) and stats (n, avgdl: one row)."""
    m = matches.join(F.broadcast(stats))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return m.groupBy("query_id", "doc_id").agg(F.sum(idf * norm).alias("score"))


def bm25_topk(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", k: int = PREFETCH, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank) without an index: one pass over the documents.

    Tokens that no query has are dropped right after the split; what is left is dealt by document and counted there. The empty term stands in every
    document for the document itself, so that its number and mean length come from the same exchange. Scores have six places.
    """
    terms = query_terms(queries, query_id, query)
    few = small(terms)  # the joins below give no more rows than terms has
    near = F.broadcast if few else lambda df: df
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(normalize_text(text)).alias("tokens")).withColumn("dl", F.coalesce(F.size("tokens"), F.lit(0)).cast("long"))
    asked = terms.select("term").unionByName(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    every = F.concat(F.array(F.lit("")), F.coalesce("tokens", F.array().cast("array<string>")))
    # dealt by document: terms are counted there, and the scores of all queries summed, of which there may be one for every document and query
    dealt = t.select("doc_id", "dl", F.explode(every).alias("term")).join(near(asked), "term").select("doc_id", "dl", "term").repartition(_tasks(t.sparkSession), "doc_id")
    tf = dealt.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    itself = F.when(F.col("term") == "", F.col("tf"))  # one for each row of the document's id
    stats = tf.agg(F.sum(itself).alias("n"), (F.sum(F.col("dl") * itself) / F.sum(itself)).alias("avgdl"))
    scores = bm25_scores(tf.join(near(terms.join(document_frequency(tf), "term")), "term"), stats, k1=k1, b=b)
    scores = scores.withColumn("score", F.round("score", 6))
    return top(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def bm25_index_topk(postings: DataFrame, stats: DataFrame, terms: DataFrame, *, k: int = PREFETCH, k1: float = K1, b: float = B, buckets: int = TERM_BUCKETS, frequencies: DataFrame | None = None) -> DataFrame:
    """The same from a stored index: only the buckets of the queries' terms are read, and postings carry all that a score needs.

    stats is the stored row (n, avgdl); frequencies the stored (bucket, term, df), without which the postings are read twice, to count them.
    """
    few = small(terms)
    near = F.broadcast if few else lambda df: df
    wanted = sorted(r.b for r in terms.select(term_bucket("term", buckets).alias("b")).distinct().collect())  # ``buckets`` numbers at most
    hit = postings.where(F.col("bucket").isin(wanted)).select("term", "doc_id", "tf", "dl")
    if frequencies is None:
        hit = hit.join(near(terms.select("term").distinct()), "term", "left_semi")
        df = document_frequency(hit)
    else:
        df = frequencies.where(F.col("bucket").isin(wanted)).select("term", "df")
    if few:
        # dealt by document before each posting meets all queries that have its term: a term that stands everywhere is every task's
        # work, and the scores of a document are summed where they are
        hit = hit.join(near(terms.select("term").distinct()), "term", "left_semi").repartition(_tasks(postings.sparkSession), "doc_id")
    matches = hit.join(near(near(terms).join(df, "term")), "term")
    scores = bm25_scores(matches, stats, k1=k1, b=b).withColumn("score", F.round("score", 6))
    return top(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


# -- dense ----------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", k: int = PREFETCH) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine top-k of each query.

    A bounded number of query floats goes to the workers, and the vectors are read where they lie: a matrix product for each Arrow
    batch, whose k best rows a query leave the worker. More queries stay a table of packed blocks, which meet packed blocks of vectors
    by an equality join; the driver holds none of them. Scores have six places; zero vectors score 0. Rows and queries without a
    vector take no part.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    v = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    out = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("doc_id", v.schema["doc_id"].dataType), StructField("score", DoubleType())])
    floats = q.agg(F.sum(F.size("v"))).first()[0] or 0
    if floats <= BROADCAST_FLOATS:
        asked = q.toArrow()  # BROADCAST_FLOATS at most
        sent = vectors.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), unit(rows_of(asked.column("v").combine_chunks()))))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            for b in batches:
                if b.num_rows and len(names):
                    yield from best_of(names, matrix, b.column(0), unit(rows_of(b.column(1))), k)

        found = v.mapInArrow(score, out)
    else:
        found = _dense_blocks(v, q, floats, out, k)
    return top(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _dense_blocks(v: DataFrame, q: DataFrame, floats: int, out: StructType, k: int) -> DataFrame:
    """The k best rows of each pair of a query block and a vector block. A vector block is one Arrow batch, packed where it lies."""
    blocks, slots = -(-floats // min(BLOCK_FLOATS, BROADCAST_FLOATS)), v.sparkSession.sparkContext.defaultParallelism * 4

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c)
            yield pa.RecordBatch.from_arrays([one(b.column(0)), pa.array([rows_of(b.column(1)).tobytes()])], ["ids", "packed"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    packed = v.mapInArrow(pack, f"ids array<{kind(v, 'doc_id')}>, packed binary").withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)))
    asked = q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "v")).alias("qs"))
    spread = asked.select("qs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    pairs = packed.join(spread, "slot").select("ids", "packed", "qs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, rows, qs in zip(b.column("ids"), b.column("packed"), b.column("qs")):
                names, matrix = qs.values.flatten()
                x = np.frombuffer(rows.as_py(), np.float64).reshape(len(ids.values), -1)
                yield from best_of(names, unit(rows_of(matrix)), ids.values, unit(x), k)

    return pairs.mapInArrow(score, out)


def rows_of(lists: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def best_of(names: pa.Array, matrix: np.ndarray, ids: pa.Array, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each query all rows that reach its k-th best score here: ties are settled later. Queries are taken by so many that SCORES bounds what is held."""
    step = max(1, SCORES // max(1, len(x)))
    for at in range(0, len(matrix), step):
        s = np.round(matrix[at : at + step] @ x.T, 6)
        if s.shape[1] > k:
            q, d = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
        else:
            q, d = (i.ravel() for i in np.indices(s.shape))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(q + at)), ids.take(pa.array(d)), pa.array(s[q, d])], ["query_id", "doc_id", "score"])


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity as an expression, for a few vectors."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


# -- fusion ---------------------------------------------------------------------------------------------------


def rrf(rankings: list[DataFrame], *, k: int = PREFETCH, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, rank) from rankings (query_id, doc_id, rank): the sum of 1 / (rrf_k + rank)."""
    both = None
    for r in rankings:
        one = r.select("query_id", "doc_id", (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("part"))
        both = one if both is None else both.unionByName(one)
    # dealt anew by name: Spark 4.1 may hand on the partitioning of a union's children although AQE gave them different numbers of partitions
    scores = both.repartition("query_id", "doc_id").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def max_normalised(score: Column, by: list[str]) -> Column:
    """score / the group's largest, within [0, 1]; 0 if that isn't positive; null stays null."""
    most = F.max(score).over(Window.partitionBy(*by))
    return F.when(score.isNull(), F.lit(None).cast("double")).when(most <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / most)))

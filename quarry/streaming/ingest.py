"""Incremental lexical index: new documents arrive as a stream, each micro-batch adds postings once.

``upsert_stream`` keeps a live index where a document replaces the one of its id; ``ingest`` adds only. There a batch is written under its number, so a batch that is run again
after a failure overwrites its own files and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import words
from quarry.operators.retrieval import term_bucket, term_counts
from quarry.plans import segments


def add_batch(docs: DataFrame, root: str, batch: int, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """A batch's texts are split once, into forward (doc_id, dl, terms); its postings and lengths are read from there."""
    t = docs.select(F.col(doc_id).alias("doc_id"), words(text).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    forward = term_counts(t)
    at = lambda name: f"{root}/{name}/batch={batch}"
    forward.write.mode("overwrite").parquet(at("forward"))
    stored = docs.sparkSession.read.schema(forward.schema).parquet(at("forward"))
    postings = stored.select("doc_id", "dl", F.explode("terms").alias("t")).select(term_bucket("t.term").alias("bucket"), "t.term", "doc_id", "t.tf", "dl")
    if not stored.groupBy("doc_id", "dl").count().where("count > 1").isEmpty():
        # rows of one id and length are one document's: only then are postings dealt and added
        postings = postings.groupBy("bucket", "term", "doc_id", "dl").agg(F.sum("tf").alias("tf")).select(*postings.columns)
    postings.write.mode("overwrite").parquet(at("postings"))
    stored.select("doc_id", "dl").write.mode("overwrite").parquet(at("lengths"))


def ingest(spark: SparkSession, source: DataFrame, root: str, **columns):
    """Start a query that feeds a streaming DataFrame of documents into the index under root."""
    return source.writeStream.foreachBatch(lambda df, batch: add_batch(df, root, batch, **columns)).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()


def upsert_stream(spark: SparkSession, source: DataFrame, root: str, *, fan: int = segments.FAN, **columns):
    """Start a query that upserts a streaming DataFrame of documents into the live index under root, and merges its segments."""

    def take(df: DataFrame, batch: int) -> None:
        segments.upsert(spark, root, df, batch=batch, **columns)
        segments.merge(spark, root, fan=fan)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()


def ingest_once(spark: SparkSession, path: str, root: str) -> DataFrame:
    """All documents of a Parquet path through the stream; returns (doc_id, dl, terms, tokens) as the index has it: the lengths, and what the postings add up to."""
    schema = spark.read.parquet(path).schema
    # a file source wants a folder; a single file is one through its own name
    source = spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])
    query = ingest(spark, source, root)
    query.awaitTermination()
    lengths, postings = (spark.read.parquet(f"{root}/{t}") for t in ("lengths", "postings"))
    of = postings.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))
    zero = {"terms": 0, "tokens": 0}
    return lengths.select("doc_id", "dl").join(of, "doc_id", "left").fillna(zero)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()

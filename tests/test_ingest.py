"""The streamed index splits a text once, and counts its terms where it lies."""

from collections import Counter

from pyspark.sql import functions as F

from quarry.operators.retrieval import term_counts
from quarry.streaming.ingest import add_batch


def test_terms_are_counted_in_the_row(spark):
    texts = [["b", "a", "b"], [], None, ["x"] * 300 + ["ё"], ["a"]]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    out = term_counts(t)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: None if r.terms is None else {x.term: x.tf for x in r.terms} for r in out.collect()} == {i: None if x is None else dict(Counter(x)) for i, x in enumerate(texts)}


def test_a_batch_reads_its_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "  "), (4, "c"), (4, "c")], "doc_id long, text string").coalesce(1)
    add_batch(docs.withColumn("text", F.udf(look, "string")("text")), str(tmp_path), 0)
    assert seen.value == 5
    got = sorted((r.doc_id, r.term, r.tf, r.dl) for r in spark.read.parquet(f"{tmp_path}/postings").collect())
    assert got == [(1, "a", 2, 3), (1, "b", 1, 3), (4, "c", 2, 1)]  # rows of one id and length are one document's
    assert sorted((r.doc_id, r.dl) for r in spark.read.parquet(f"{tmp_path}/lengths").collect()) == [(1, 3), (2, 0), (3, 0), (4, 1), (4, 1)]

"""The block-max search: the same result as scoring every posting, and fewer blocks read."""

import random

import pytest

from quarry.operators import retrieval
from quarry.operators.blockmax import blockmax_topk, write_blocks
from quarry.queries import stored

SCHEMA = "doc_id long, text string"


def topical(n, seed):
    """Documents of forty topics with their own words, some shared words, and a few long ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.randrange(40)
        own = [f"t{t}w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randint(1, 30))]
        out.append((i, " ".join(own + [f"c{min(int(rng.expovariate(0.3)), 30)}" for _ in range(rng.randint(0, 60))])))
    return [*out, (n, ""), (n + 1, None), (n + 2, "t1w1 " * 300), (n + 3, "t1w1")]


@pytest.mark.parametrize("k", [3, 50])
def test_block_search(spark, tmp_path, k):
    docs = spark.createDataFrame(topical(1500, k), SCHEMA).repartition(3)
    queries = spark.createDataFrame([(0, "t1w1 t1w2 c0"), (1, "t5w0 t6w1 t5w3 c1 c2 c3"), (2, "nothing here"), (3, ""), (4, "c0 c1"), (5, "t9w55")], "query_id long, query string")
    index = write_blocks(docs, f"{tmp_path}/blocks", block_docs=16)
    terms = retrieval.query_terms(queries, "query_id", "query")
    out, read = blockmax_topk(index, terms, k=k, save=stored)
    want = retrieval.bm25_topk(docs, queries, k=k)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    total, n = index.blocks.join(terms, "term").count(), read.count()
    print(f"k = {k}: {n} of {total} blocks read")
    assert n < total * (0.75 if k == 3 else 1)


def test_joins_beyond_the_bound(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(topical(300, 1), SCHEMA)
    queries = spark.createDataFrame([(0, "t1w1 t1w2 c0"), (1, "c1 c2 c3")], "query_id long, query string")
    index = write_blocks(docs, f"{tmp_path}/blocks", block_docs=8)
    terms = retrieval.query_terms(queries, "query_id", "query")
    want = sorted(map(tuple, retrieval.bm25_topk(docs, queries, k=5).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", -1)
    monkeypatch.setattr(retrieval, "small", lambda df, rows=0: False)
    monkeypatch.setattr("quarry.operators.blockmax.small", lambda df, rows=0: False)
    assert sorted(map(tuple, blockmax_topk(index, terms, k=5, save=stored)[0].collect())) == want


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    index = write_blocks(docs, f"{tmp_path}/none")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "a b")], "query_id long, query string"), "query_id", "query")
    assert blockmax_topk(index, terms, k=5)[0].collect() == []


def test_what_leaves_a_task_are_documents(spark, tmp_path):
    """Postings are dealt by block and their scores are summed there: no exchange has a row of each term of each document and query."""
    docs = spark.createDataFrame([(i, f"a b c d{i % 7}") for i in range(400)], SCHEMA)
    queries = spark.createDataFrame([(q, "a b c d1 d2") for q in range(20)], "query_id long, query string")
    index = write_blocks(docs, f"{tmp_path}/blocks", block_docs=16)
    out, _ = blockmax_topk(index, retrieval.query_terms(queries, "query_id", "query"), k=5, save=stored)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "Generate explode" not in plan
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, retrieval.bm25_topk(docs, queries, k=5).collect()))


def test_several_passes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(topical(200, 2), SCHEMA)
    queries = spark.createDataFrame([(q, f"t{q}w1 t{q}w2 c0") for q in range(9)], "query_id long, query string")
    index = write_blocks(docs, f"{tmp_path}/blocks", block_docs=8)
    want = sorted(map(tuple, retrieval.bm25_topk(docs, queries, k=4).collect()))
    monkeypatch.setattr("quarry.operators.blockmax.ASKED", 10)
    assert sorted(map(tuple, blockmax_topk(index, retrieval.query_terms(queries, "query_id", "query"), k=4, save=stored)[0].collect())) == want

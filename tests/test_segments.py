"""The live index: after upserts, deletes, replays and merges a search answers as an index built anew of the live documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.plans import segments
from quarry.streaming.ingest import upsert_stream

SCHEMA = "doc_id long, text string, version long, deleted boolean"
QUERIES = [(0, "w1 w2 w3"), (1, "w7 nothing w0"), (2, ""), (3, "common w4")]


@pytest.fixture(scope="module")
def terms(spark):
    return retrieval.query_terms(spark.createDataFrame(QUERIES, "query_id long, query string"), "query_id", "query")


def rebuilt(spark, state, k=10):
    docs = spark.createDataFrame(sorted(state.items()), "doc_id long, text string")
    return sorted(map(tuple, retrieval.bm25_topk(docs, spark.createDataFrame(QUERIES, "query_id long, query string"), k=k).collect()))


def random_batch(rng, ids, version):
    rows, last = [], {}
    for i in rng.choices(ids, k=rng.randint(1, 25)):
        text = None if rng.random() < 0.05 else " ".join(rng.choices([f"w{j}" for j in range(12)] + ["common"] * 6, k=rng.randint(0, 12)))
        rows.append((i, text, version, rng.random() < 0.2))
        best = last.get(i)
        if best is None or (text or "") >= (best[1] or ""):
            last[i] = rows[-1]
    # of equal texts one says deleted: make them agree
    return [last[i] for i in last] + [r for r in rows if (r[1] or "") < (last[r[0]][1] or "")], last


def test_stream_of_upserts_equals_a_rebuild(spark, terms, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "TIER", 8)
    root, rng, state, seen = str(tmp_path), random.Random(5), {}, []
    for n in range(6):
        rows, last = random_batch(rng, range(30), n)
        for i, (_, text, _, gone) in last.items():
            state.pop(i, None)
            if not gone:
                state[i] = text
        spark.createDataFrame([*rows, (None, "w1 without an id", n, False)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        arrived = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        upsert_stream(spark, arrived, f"{root}/live", fan=3, version="version", deleted="deleted").awaitTermination()  # each run starts from the checkpoint
        live = segments.manifest(spark, f"{root}/live")
        assert live.batch == n and live.docs == len(state)
        seen.append((len(live.segments), sum(s.dead_docs for s in live.segments)))
        if n in (2, 4):
            assert sorted(map(tuple, segments.search(spark, f"{root}/live", terms, k=10).collect())) == rebuilt(spark, state)
    assert max(seen)[0] > 1 and max(d for _, d in seen) > 0 and live.number > 6  # several segments with dead documents, and merges
    assert sorted(map(tuple, segments.search(spark, f"{root}/live", terms, k=10).collect())) == rebuilt(spark, state)
    monkeypatch.setattr(segments, "BROADCAST_IDS", -1)
    assert sorted(map(tuple, segments.search(spark, f"{root}/live", terms, k=10).collect())) == rebuilt(spark, state)
    gone = segments.vacuum(spark, f"{root}/live", keep=1)
    assert gone and sorted(map(tuple, segments.search(spark, f"{root}/live", terms, k=10).collect())) == rebuilt(spark, state)


def test_replays_and_second_writers(spark, terms, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "w1 w1 w2"), (2, "w2"), (2, "w3"), (3, "")], "doc_id long, text string")
    first = segments.upsert(spark, root, df, batch=0)
    assert (first.docs, first.tokens) == (3, 4)  # of the two rows of id 2 the greater text
    assert segments.upsert(spark, root, df, batch=0) == first == segments.manifest(spark, root)
    second = segments.upsert(spark, root, df.where("doc_id = 1"), batch=1)
    assert (second.docs, second.tokens, len(second.segments)) == (3, 4, 2)
    with pytest.raises(RuntimeError, match="another writer"):
        segments._commit(spark, root, first, 1, "bigint", list(first.segments), [])
    with pytest.raises(ValueError, match="ids of type"):
        segments.upsert(spark, root, df.withColumn("doc_id", F.col("doc_id").cast("string")))
    old = sorted(map(tuple, segments.search(spark, root, terms, live=first).collect()))
    assert old == sorted(map(tuple, segments.search(spark, root, terms).collect())) == rebuilt(spark, {1: "w1 w1 w2", 2: "w3", 3: ""})


def test_a_writer_that_fails_leaves_nothing(spark, terms, tmp_path, monkeypatch):
    root = str(tmp_path)
    segments.upsert(spark, root, spark.createDataFrame([(1, "w1 w1"), (2, "w2")], "doc_id long, text string"))
    before = sorted(map(tuple, segments.search(spark, root, terms).collect()))
    commit = segments._commit

    def lost(*a):
        raise OSError("the driver is gone")

    monkeypatch.setattr(segments, "_commit", lost)
    with pytest.raises(OSError):
        segments.upsert(spark, root, spark.createDataFrame([(1, "w3")], "doc_id long, text string"), batch=1)
    monkeypatch.setattr(segments, "_commit", commit)
    assert sorted(map(tuple, segments.search(spark, root, terms).collect())) == before
    assert segments.upsert(spark, root, spark.createDataFrame([(1, "w3")], "doc_id long, text string"), batch=1).docs == 2
    assert sorted(map(tuple, segments.search(spark, root, terms).collect())) == rebuilt(spark, {1: "w3", 2: "w2"})


def test_everything_deleted(spark, terms, tmp_path):
    root = str(tmp_path)
    segments.upsert(spark, root, spark.createDataFrame([(1, "w1"), (2, "w2")], "doc_id long, text string"))
    gone = spark.createDataFrame([(1, None, 1, True), (2, None, 1, True), (9, None, 1, True)], SCHEMA)
    live = segments.upsert(spark, root, gone, version="version", deleted="deleted")
    assert live.docs == 0 and live.segments == () and segments.search(spark, root, terms).collect() == []
    live = segments.upsert(spark, root, spark.createDataFrame([(1, "w1 w1")], "doc_id long, text string"))
    assert [(r.query_id, r.doc_id) for r in segments.search(spark, root, terms).collect()] == [(0, 1)]
    assert segments.upsert(spark, root, gone.limit(0), version="version", deleted="deleted").docs == 1


def test_a_batch_reads_its_own_range_of_ids(spark, tmp_path):
    root = str(tmp_path)
    segments.upsert(spark, root, spark.range(500).selectExpr("id AS doc_id", "concat('w', id) AS text"))
    of = segments.manifest(spark, root)
    plan = segments.table(spark, root, "forward", of).where(F.col("doc_id").between(3, 5))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,3), LessThanOrEqual(doc_id,5)]" in plan


def test_texts_and_postings_travel_once(spark, terms, tmp_path):
    """A segment's terms are counted and sorted where its documents lie; a search deals each posting by document before it meets the queries."""
    latest = spark.createDataFrame([(1, "w1 w1 w2", False), (2, "w3", True), (3, None, False)], "doc_id long, text string, gone boolean")
    forward = segments.forward_of(latest)
    assert "Exchange" not in forward._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.dl, None if r.terms is None else sorted(map(tuple, r.terms))) for r in forward.collect()) == [(1, 3, [("w1", 2), ("w2", 1)]), (2, None, None), (3, 0, [])]
    segments.upsert(spark, str(tmp_path), latest.select("doc_id", "text"))
    plan = segments.search(spark, str(tmp_path), terms)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)

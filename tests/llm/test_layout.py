"""Mixing, sharding, token counts and chat formatting."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.llm import queries as q
from quarry.llm.chat_format import chat_format, loss_spans, loss_text
from quarry.llm.mixing import cube_mix, flight, mixed_documents, source_targets, taken_rows
from quarry.llm.sharding import min_cost_flow, plan_transfers, reshard, rewrite
from quarry.llm.token_counts import at_limit, length_histogram, quantiles, token_lengths


def targets(rows):
    size = defaultdict(int)
    for s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, total = set(), sum(size.values())
    while True:
        left = total - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        t = {s: 3 * size[s] if s in full else left * weight[s] / w for s in names}
        more = {s for s in names if s not in full and t[s] > 3 * size[s]}
        if not more:
            return size, t
        full |= more


def test_mix(docs, edge, none):
    for df in (docs, edge):
        rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect()]
        size, want = targets((s, n) for _, s, n in rows)
        mix = cube_mix(df)
        got = taken_rows(mix).collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n) for i, _, n in rows)
        assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got)
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, taken_rows(cube_mix(df)).collect()), key=str)
        for r in mix.groupBy("source").agg(F.max("source_size").alias("s"), F.max("target").alias("t"), F.sum(F.col("size") * (F.col("c") * F.col("copies") + F.col("more"))).alias("taken"), F.max("size").alias("top")).collect():
            assert r.s == size[r.source] and r.t == pytest.approx(want[r.source])
            assert abs(r.taken - r.t) <= r.top + 1e-6
        out = mixed_documents(df, mix)
        assert out.columns == df.columns and out.count() == sum(n for (n,) in mix.select(F.col("c") * F.col("copies") + F.col("more")).collect())
    assert taken_rows(cube_mix(none)).count() == 0


def test_mix_levels(docs, monkeypatch):
    from quarry.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    mix = cube_mix(docs)
    assert mix.agg(F.sum("c")).first()[0] == docs.count()
    for r in mix.groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * (F.col("copies") * F.col("c") + F.col("more"))).alias("n"), F.max("size").alias("top")).collect():
        assert abs(r.n - r.t) <= r.top


def test_flight_is_balanced_and_unbiased():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 1000, 300).astype(float)
    pi = np.full(300, 0.37)
    mean = np.zeros(300)
    for k in range(300):
        x = flight(pi, size, np.random.default_rng(k), False)
        assert ((x > 0) & (x < 1)).sum() <= 2
        assert x.sum() == pytest.approx(pi.sum()) and (x * size).sum() == pytest.approx((pi * size).sum())
        mean += flight(pi, size, np.random.default_rng(k), True)
    assert set(flight(pi, size, rng, True)) <= {0.0, 1.0}
    assert abs(mean / 300 - 0.37).max() < 0.15 and abs(mean.mean() / 300 - 0.37) < 0.01


def brute_moved(supply, capacity):
    return sum(max(0, s - c) for s, c in zip(supply, capacity))


def test_min_cost_flow():
    rng = np.random.default_rng(5)
    for _ in range(30):
        supply = rng.integers(0, 100, 6).tolist()
        total = sum(supply)
        capacity = [total * (j + 1) // 6 - total * j // 6 for j in range(6)]
        flow = min_cost_flow(supply, capacity)
        assert all(sum(v for (i, _), v in flow.items() if i == s) == supply[s] for s in range(6))
        assert all(sum(v for (_, j), v in flow.items() if j == t) <= capacity[t] for t in range(6))
        assert sum(v for (i, j), v in flow.items() if i != j) == brute_moved(supply, capacity)
    with pytest.raises(ValueError):
        min_cost_flow([5], [4])


def test_reshard(docs, edge, none):
    for df in (docs, edge):
        got = reshard(df, old_shard=F.pmod(F.xxhash64("source"), F.lit(12))).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    sizes = [n for _, n in reshard(docs, old_shard=F.pmod(F.xxhash64("source"), F.lit(12))).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.02 * max(sizes)
    assert reshard(none, old_shard=F.lit(0)).count() == 0


def test_reshard_with_a_hot_row(spark):
    """Half of all rows are one and the same: the law holds, no shard is empty, and little more moves than the flow says."""
    rows = [(7, "the same text again")] * 3000 + [(i, f"text {i} " * (i % 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.when(F.col("doc_id") == 7, 3).otherwise(F.pmod("doc_id", F.lit(12))))
    got = reshard(df, old_shard=F.col("old")).collect()
    sizes, old = Counter(), Counter()
    for r in got:
        sizes[r.shard] += r["size"]
        old[r.old_shard] += r["size"]
    assert len(got) == 6000 and len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 0.02 * max(sizes.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = sum(sizes.values())
    least = brute_moved([old[j] for j in range(16)], [total * (j + 1) // 16 - total * j // 16 for j in range(16)])
    assert sum(r["size"] for r in got if r.shard != r.old_shard) <= 1.05 * least


def test_rewrite_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter((r.doc_id, r.text_crc32) for r in q.reshard_rewrite(spark, sf).collect())
    assert got == Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in docs.collect())


def test_rewrite_of_nothing(spark, tmp_path):
    """An empty table, and one that has its layout already."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert q.reshard_rewrite(spark, str(tmp_path)).collect() == []
    even = docs.limit(100).withColumns({"text": F.lit("same"), "shard": (F.row_number().over(Window.orderBy("doc_id")) % 2).cast("int")})
    even.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    stored = spark.read.parquet(f"{tmp_path}/old")
    assert rewrite(spark, f"{tmp_path}/old", f"{tmp_path}/new", reshard(stored, old_shard=F.col("shard"), shards=2), shards=2) == []
    assert spark.read.schema(stored.schema).parquet(f"{tmp_path}/new").collect() == []


def test_mix_without_broadcast(docs, edge, monkeypatch):
    from quarry.llm import mixing

    want = [sorted(map(str, cube_mix(x).collect())) for x in (docs, edge)]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert [sorted(map(str, cube_mix(x).collect())) for x in (docs, edge)] == want


def test_places_over_many_partitions(spark):
    """Sources over 1500 ranges keep their places in the order of their code points."""
    rows = spark.range(3000).selectExpr("concat(char(97 + id % 26), id) AS source", "id + 1 AS size").unionByName(spark.createDataFrame([(None, 5)], "source string, size long"))
    conf = {"spark.sql.shuffle.partitions": "1500", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = source_targets(rows)
        for k, v in before.items():  # the sources lie in their ranges by now
            spark.conf.set(k, v)
        got = {r.source: r for r in got.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = sorted(got, key=lambda s: (s is None, s or ""))
    assert [got[s].place for s in order] == list(range(3001))
    assert sum(r.target for r in got.values()) == pytest.approx(sum(r.source_size for r in got.values()))


def test_transfers_keep_what_fits():
    blocks = [(o, k, 10) for o in range(4) for k in range(10 + o)]
    where = plan_transfers(blocks, 4)
    moved = sum(b for o, k, b in blocks if where[o, k] != o)
    assert moved <= brute_moved([100, 110, 120, 130], [115] * 4) + 4 * 10


def test_rewrite(spark, docs, tmp_path):
    old = docs.withColumn("shard", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("doc_id") % 3).cast("int"))
    old.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    placed = reshard(old, old_shard=F.col("shard"), shards=3).cache()
    touched = rewrite(spark, f"{tmp_path}/old", f"{tmp_path}/new", placed, shards=3)
    new = spark.read.parquet(f"{tmp_path}/new")
    kept = spark.read.parquet(f"{tmp_path}/old").where(~F.col("shard").isin(touched))
    assert new.unionByName(kept).select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert new.count() + kept.count() == docs.count()


def test_rewrite_writes_every_row_once(spark, edge, tmp_path):
    """Null ids, repeated rows, an id of many rows, and rows that differ in other columns only."""
    more = [(None, f"no id {i}", "en", "a", i, "1", "y", 1) for i in range(40)] + [(9, f"text {i % 30}", "en", "b", i % 7, "1", "y", 1) for i in range(300)]
    old = edge.unionByName(spark.createDataFrame(more + [(None, None, "fr", "a", 1, "1", "y", 1)] * 5, edge.schema)).withColumn("shard", F.when(F.xxhash64("text", "n_chars") % 4 == 0, 2).otherwise(0))
    old.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    placed = reshard(old, old_shard=F.col("shard"), shards=3).cache()
    touched = rewrite(spark, f"{tmp_path}/old", f"{tmp_path}/new", placed, shards=3)
    new = spark.read.parquet(f"{tmp_path}/new")
    kept = spark.read.parquet(f"{tmp_path}/old").where(~F.col("shard").isin(touched))
    assert touched and Counter(tuple(r)[:-1] for r in new.unionByName(kept).collect()) == Counter(tuple(r)[:-1] for r in old.collect())
    count = lambda df: {r.shard: r["count"] for r in df.groupBy("shard").count().collect()}
    assert count(new) == count(placed.where(F.col("shard").isin(touched)))


def test_token_counts(docs, edge, none):
    import base64

    import tiktoken

    from quarry.llm.token_counts import PATTERN, TOKENIZER

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    own = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, edge):
        n = [len(own.encode_ordinary(r.text or "")) for r in df.collect()]
        hist = length_histogram(token_lengths(df), block=100).cache()
        rows = hist.collect()
        assert {r.n_tokens: r.n_docs for r in rows} == Counter(n)
        for r in rows:
            L = r.n_tokens
            assert (r.docs_ge, r.tokens_ge) == (sum(x >= L for x in n), sum(x for x in n if x >= L))
            assert (r.truncated_total, r.n_truncated) == (sum(min(x, L) for x in n), sum(x > L for x in n))
        a = at_limit(hist, 300).first()
        assert (a.n_docs, a.total_tokens, a.truncated_total, a.n_truncated) == (len(n), sum(n), sum(min(x, 300) for x in n), sum(x > 300 for x in n))
        assert quantiles(hist, [0.5]).first().p0 == sorted(n)[-(-len(n) // 2) - 1]
    assert length_histogram(token_lengths(none)).count() == 0


NASTY = [None, "", "\\", "\\l", "\\b\\l", "### ", "###e ", "</turn>", "</turn>\n", "### user: x</turn>\n### ", "a: b", "é\n漢 #", "##", "###", "</turn", "###e"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text, 1, "f") for c, role in enumerate(["user", "assistant", "a: b", "### ", "x\ny", None, "", "a:", "</turn>"]) for t, text in enumerate(NASTY)]
    rows += [(None, 1, "user", "x", 1, "f"), (50, None, "assistant", "x", 1, "f"), (50, None, "assistant", "x", 1, "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int, formatted string")
    got = {r.conv_id: r for r in chat_format(df).withColumn("loss", loss_text(F.col("turns"))).withColumn("spans", loss_spans(F.col("formatted"), F.col("turns"))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        un = lambda s: s.replace("\\c", ":").replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\")
        texts = [got[c].formatted[s.start : s.end] for s in got[c].spans]
        assert [x in (t, x) and (x == t or un(x) == t) for x, t in zip(texts, [r[3] or "" for r in own if r[2] == "assistant"], strict=True)].count(False) == 0
    assert chat_format(df.limit(0)).count() == 0


def test_chat_query(spark, sf):
    got = {r.conv_id: r for r in q.op7_chat_format(spark, sf).collect()}
    text = r"\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-7].loss_chars == len(text) and got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()

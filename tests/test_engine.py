"""Grouping, queries, ranking, the index and the whole search on small worked examples."""

import hashlib
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.encode import HashingEncoder, checked, encode
from quarry.operators import catalog, evaluation, profile, ranking, retrieval
from quarry.operators.query_parse import parse_queries
from quarry.plans import engine, index
from quarry.sources import mapping

BASE = dict(
    ld_name="LD valve", ld_article="11100800162MULD000003000", ld_url=None, ld_dn="80", ld_pn_mpa="16", ld_connection="фланцевое", ld_medium="жидкость", ld_control="ручное", ld_temp=None, ld_length="300",
    steel_name="Temper Ду80 Ру16", steel_article="КШ.П.П.015.40-01", steel_url=None, steel_dn="80", steel_pn_bar="16", steel_connection="фланцевый", steel_medium="жидкость", steel_control="ручное",
    steel_temp="до +80", steel_length="300 мм", match_score=8, match_max=7, price_ld=12130.0,
)


def mapping_rows(spark, changes):
    kinds = ", ".join(f"{c} {mapping.NUMERIC.get(c, 'string')}" for c in mapping.COLUMNS)
    return spark.createDataFrame([tuple((BASE | x)[c] for c in mapping.COLUMNS) for x in changes], kinds)


GROUPED = [{}, {}, {"steel_name": "temper Ду80 Ру16", "ld_article": "11100800162MULD000004000"}, {"steel_dn": "50"}, {"steel_article": "a0486", "steel_name": "Broen DN50 PN10"}]


def test_grouping(spark):
    rows = mapping_rows(spark, GROUPED)
    docs = {r.steel_id: r for r in catalog.source_documents(rows).collect()}
    assert len(docs) == 3
    first = next(r for r in docs.values() if len(r.name_variants) == 2)
    assert first.name == "Temper Ду80 Ру16" and first.name_variants == ["Temper Ду80 Ру16", "temper Ду80 Ру16"]
    assert [c.article_norm for c in first.ld_candidates] == ["11100800162muld000003000", "11100800162muld000004000"]
    assert first.steel_id == hashlib.sha1("кшпп0154001temper ду80 ру168016фланцевоеручное".encode()).hexdigest()
    assert first.brand == "Temper" and "Ду 80" in first.lexical_text.split("\n") and first.semantic_text.startswith("Название: Temper Ду80 Ру16\nБренд: Temper\n")
    mixed = list(range(5))
    random.Random(1).shuffle(mixed)
    again = {r.steel_id: r for r in catalog.source_documents(mapping_rows(spark, [GROUPED[i] for i in mixed]).repartition(3)).collect()}
    assert again == docs
    prefix = "quarry:"
    got = catalog.source_documents(rows).select("steel_id", catalog.point_id(F.col("steel_id"), prefix).alias("p")).collect()
    assert all(r.p == str(uuid.uuid5(uuid.NAMESPACE_URL, prefix + r.steel_id)) for r in got)


def test_catalogue_combines_rows_before_they_travel(spark):
    """Copies of a row, of which a group may have any number, are combined in each task; distinct rows of one group are many tasks."""
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = mapping_rows(spark, [{"steel_article": None, "steel_name": None, "steel_dn": None, "steel_connection": None, "steel_control": None, "ld_article": f"L{i % 300}"} for i in range(900)]).repartition(6)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = rows.distinct()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate") == 2 and plan.rindex("HashAggregate") > plan.index("Exchange hashpartitioning")
        src = catalog.source_rows(rows)
        assert src.count() == 300 and src.select(*catalog.GROUP).distinct().count() == 1
        assert src.select(F.input_file_name()).distinct().count() == 8
        assert len(catalog.source_documents(rows).first().ld_candidates) == 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_catalogue_rows_travel_once(spark):
    """Source rows are stored as they were dealt, so a candidate's values are counted where they lie; copies are counted once."""
    src = catalog.source_rows(mapping_rows(spark, GROUPED))
    assert "Exchange" not in catalog.ld_candidates(src)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.copies for r in src.select("copies").collect()) == [1, 1, 1, 2]


def test_document_heads(spark):
    """Documents without their candidates are the same, and rows are counted before Python sees them; candidates are added to some of them."""
    odd = [{"steel_article": None, "steel_name": None, "steel_url": "u", "ld_article": None}, {"steel_name": "  TEMPER Ду80 Ру16", "steel_url": "v", "ld_article": "11100800162mULD000003000", "steel_length": "30 cm"}, {"steel_temp": None, "price_ld": None}]
    rows = mapping_rows(spark, [*GROUPED, *odd])
    whole = {r.steel_id: r for r in catalog.source_documents(rows).collect()}
    heads = catalog.document_heads(rows, counted=True)
    got = {r.steel_id: r for r in heads.collect()}
    shared = [c for c in heads.columns if c not in (*catalog.GROUP, "spellings", "n_candidates")]
    assert {k: [r[c] for c in shared] for k, r in got.items()} == {k: [r[c] for c in shared] for k, r in whole.items()}
    assert {k: r.n_candidates for k, r in got.items()} == {k: len(r.ld_candidates) for k, r in whole.items()} and max(r.n_candidates for r in got.values()) == 2
    plan = catalog.document_heads(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.rindex("Exchange hashpartitioning") > plan.rindex("MapInArrow")
    some = catalog.document_heads(rows).where("size(name_variants) > 1")
    assert {r.steel_id: r.ld_candidates for r in catalog.with_candidates(some, rows).collect()} == {k: r.ld_candidates for k, r in whole.items() if len(r.name_variants) > 1}


def test_candidates_need_no_documents(spark, tmp_path):
    """Candidates straight from the rows are those of the documents, and their rows travel once and are stored nowhere."""
    odd = [{"steel_article": None, "steel_name": None, "ld_article": "Q"}, {"ld_article": None}, {"ld_article": " "}, {"ld_article": "q 1", "price_ld": None}, {"ld_article": "Q  1", "ld_dn": None}, {"ld_article": "Ｑ 1", "ld_name": "z"}]
    rows = mapping_rows(spark, [*GROUPED, *GROUPED, *odd, *({"ld_article": "T", "price_ld": p} for p in (9.0, 10.0, 10.5, 9.0)), {"ld_article": "N", "ld_name": None, "ld_url": None}])
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    whole = {(r.steel_id, c.article_norm): tuple(c)[1:] for r in catalog.source_documents(rows).collect() for c in r.ld_candidates}
    found = catalog.candidates(rows)
    own = [f"ld_{n}" for n in catalog.CANDIDATE_FIELDS]
    got = found.select("steel_id", "ld_article_norm", *own).collect()
    assert len(got) == len(whole) >= 7 and {(r[0], r[1]): tuple(r)[2:] for r in got} == whole
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("ReusedExchange") == 1 and final.count("MapInArrow") == 1 and "stored" not in final


def test_evaluation_nests_candidates_of_chosen_documents(spark, monkeypatch):
    """The query set is the same, and only rows of the documents that it is made of are normalised as candidates."""
    rows = mapping_rows(spark, [{**x, "steel_medium": "water", "steel_name": f"Temper Ду{i}"} for i in range(6) for x in ({}, {"ld_article": f"L{i}"})])
    want = evaluation.eval_dataset(catalog.source_documents(rows), documents=2).collect()
    seen, whole = [], catalog.source_rows
    monkeypatch.setattr(catalog, "source_rows", lambda r: seen.append(r.count()) or whole(r))
    assert sorted(evaluation.eval_rows(rows, documents=2).collect()) == sorted(want) and len(want) == 16 and seen == [4]


def test_index_keeps_no_source_rows(spark, tmp_path, monkeypatch):
    """Documents of an index are those of stored rows, with the same counts, and its build stores no rows."""
    odd = [{"steel_article": None, "steel_name": None, "ld_article": None}, {"ld_article": " "}, {"price_ld": None}]
    rows = mapping_rows(spark, [*GROUPED, *GROUPED, *odd])
    want = {r.steel_id: r for r in catalog.source_documents(rows).collect()}
    monkeypatch.setattr(catalog, "stored_by", None)
    meta = index.build_index(rows, str(tmp_path), HashingEncoder(32), model="hashing-32", smoke=(), recreate=True)
    got = {r.steel_id: r for r in index.open_index(spark, str(tmp_path)).docs.drop("doc_id").collect()}
    assert got == want and len(got) == 4 and (meta.document_count, meta.source_row_count, meta.deduplicated_row_count) == (4, 13, 7)


def test_dense_scores_are_bounded():
    """What a worker holds doesn't grow with the number of queries; the results are those of one product."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    q, x = (retrieval.unit(rng.normal(size=(n, 4))) for n in (12_000, 3_000))
    tracemalloc.start()
    got = [b for b in retrieval.best_of(pa.array(range(len(q))), q, pa.array(range(len(x))), x, 2)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # one product of all is 288 MB, and its copies as much again
    table = pa.Table.from_batches(got).to_pylist()
    for i in (0, 700, 11_999):
        s = np.round(q[i] @ x.T, 6)
        assert {r["doc_id"] for r in table if r["query_id"] == i} == set(np.nonzero(s >= np.sort(s)[-2])[0])


def test_canonical(spark):
    rows = [("a", 50.0)] * 2 + [("a", 100.0)] * 2 + [("a", 9.0), ("b", None), ("c", 9.0), ("c", None), ("c", None)]
    got = {r.k: r.v for r in catalog.canonical(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", numeric=True).collect()}
    assert got == {"a": 100.0, "b": None, "c": 9.0}  # as text '100.0' comes before '50.0'


def test_profile(spark):
    rows = mapping_rows(spark, [{"match_score": 7}, {"match_score": 8}, {"match_score": 8}, {"ld_article": "X", "match_score": 8}])
    p = profile.profile(rows)
    assert (p["rows"], p["full_duplicates"], p["unique_steel_ld_pairs"], p["conflicting_steel_articles_count"]) == (4, 1, 2, 1)
    assert p["match_score_distribution"] == {"7": 1, "8": 3} and p["null_counts"]["ld_url"] == 4
    assert p["conflicting_steel_articles_examples"][0]["ld_articles"] == ["11100800162MULD000003000", "X"]
    with pytest.raises(ValueError, match="Missing required columns: ld_name, price_ld"):
        profile.profile(rows.drop("ld_name", "price_ld"))


def test_profile_rows_travel_as_hashes(spark):
    plan = profile.counts(mapping_rows(spark, [{}, {}, {"ld_url": ""}]))._jdf.queryExecution().executedPlan().toString()
    assert not any("steel_control" in line for line in plan.split("\n") if "Exchange" in line or "HashAggregate" in line)
    rows = [{}, {}, {"ld_url": ""}, {"ld_url": "", "ld_temp": None}, {"ld_url": None, "ld_temp": ""}, {"price_ld": -0.0}, {"price_ld": 0.0}]
    assert profile.counts(mapping_rows(spark, rows)).first().full_duplicates == 3


def test_bm25_scores_are_summed_where_documents_lie(spark):
    """Of the exchanges above the one by document none holds a row for each query and document."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a c"), (1, "b")], "query_id long, query string")
    hits = retrieval.bm25_topk(docs, q, k=5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and not any("hashpartitioning(query_id" in line and "doc_id" in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.split("\n"))
    assert [(r.query_id, r.doc_id) for r in hits.orderBy("query_id", "rank").collect()] == [(0, 1), (0, 2), (1, 2), (1, 1)]


def test_csv(spark, tmp_path):
    import csv

    with open(tmp_path / "m.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow([*mapping.COLUMNS, "extra"])
        w.writerow(["007" if c == "ld_article" else "NaN" if c == "ld_url" else "say \"x\",\ny" if c == "ld_name" else 7 if c in mapping.NUMERIC else "v" for c in mapping.COLUMNS] + [""])
    r = mapping.read_csv(spark, str(tmp_path / "m.csv")).first()
    assert (r.ld_article, r.ld_url, r.ld_name, r.match_score, r.price_ld, r.extra) == ("007", None, 'say "x",\ny', 7, 7.0, None)
    (tmp_path / "parts").mkdir()
    for name in ("b", "a", "_SUCCESS"):
        (tmp_path / "parts" / name).write_text(name)
    of = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert mapping.checksum(spark, str(tmp_path / "parts")) == of(of("a") + of("b"))
    with pytest.raises(FileNotFoundError):
        mapping.checksum(spark, str(tmp_path / "none"))
    assert mapping.checksum(spark, str(tmp_path / "m.csv")) == hashlib.sha256((tmp_path / "m.csv").read_bytes()).hexdigest()


def parse(spark, q):
    return parse_queries(spark.createDataFrame([(0, q)], "query_id long, query string")).first()


def test_query_parse(spark):
    p = parse(spark, "Temper 1184399 DN80 PN16")
    assert (p.brand, p.dn, p.pn_bar, p.connection, p.medium, p.control) == ("Temper", 80.0, 16.0, None, None, None)
    assert p.semantic_text == "Temper 1184399, DN 80, PN 16" and p.possible_article_tokens == ["1184399"]
    assert {"dn80", "pn16"} <= set(p.lexical_text.split())
    p = parse(spark, "KSH.P.P.015.40-01")
    assert p.semantic_text == "KSH.P.P.015.40-01" and p.possible_article_tokens[-1] == "kshpp0154001"
    p = parse(spark, "фланцевый кран Ду50 Ру40 вода")
    assert (p.dn, p.pn_bar, p.connection, p.medium) == (50.0, 40.0, "фланцевое", "жидкость")
    assert parse(spark, None).semantic_text == ""


def candidate(article, dn):
    return (article.lower(), article, f"LD {dn}", None, dn, 16.0, "фланцевое", "жидкость", "ручное", None, None, 9800.0)


def example(spark):
    docs = [
        ("doc-1", 0.91, "1184399", "1184399", "1184399", "Temper DN80 PN16", "Temper", 80.0, 16.0, "фланцевое", "жидкость", "ручное", [candidate("11100800162MULD000003000", 80.0), candidate("11100800162MULD000004000", 50.0)]),
        ("doc-2", 0.97, "a0486", "a0486", "a0486", "Broen DN50 PN10", "Broen", 50.0, 10.0, "резьбовое", "газ", "электропривод", [candidate("11100800162MULD000003000", 80.0), candidate("11100800162MULD000005000", 50.0)]),
    ]
    schema = f"steel_id string, raw_score double, article string, article_norm string, article_compact string, name string, brand string, dn double, pn_bar double, connection string, medium string, control string, ld_candidates array<{catalog.CANDIDATE}>"
    parsed = parse_queries(spark.createDataFrame([(0, "Temper 1184399 Ду80 Ру16")], "query_id long, query string"))
    hits = spark.createDataFrame(docs, schema).withColumns({"doc_id": F.col("steel_id"), "query_id": F.lit(0).cast("long")})
    return hits.join(ranking.query_columns(parsed), "query_id")


def test_worked_example(spark):
    sources = ranking.rank_sources(example(spark))
    got = {r.doc_id: r for r in sources.collect()}
    assert got["doc-1"].source_rank == 1 and got["doc-1"].text_exactness == 1.0 and got["doc-1"].source_field_score == 1.0
    assert got["doc-1"].source_score == pytest.approx(0.55 * 0.91 / 0.97 + 0.25 + 0.20)
    out = ranking.rank_candidates(sources).orderBy("rank").collect()
    assert [r.id for r in out] == ["11100800162muld000003000", "11100800162muld000004000", "11100800162muld000005000"]
    top = out[0]
    assert top.score == pytest.approx(top.score_breakdown["source_score"] * 0.7 + 0.3) and top.score_breakdown["ld_field_score"] == 1.0
    assert [(e.source_article, e.source_rank) for e in top.source_evidence] == [("1184399", 1), ("a0486", 2)]
    assert {"Совпадает DN 80", "Совпадает PN 16"} <= set(top.match_reasons) and top.mismatches == []
    assert out[1].mismatches == ["DN: ожидался 80, найден 50"]
    assert len(ranking.rank_candidates(sources, limit=1).collect()) == 1


def test_evidence_has_three_at_most(spark):
    rows = [(0, "k", f"a{i}", "n", 1.0 - i / 10, i + 1) for i in range(5)] + [(0, "k", "a0", "n", 0.1, 9)]
    df = spark.createDataFrame(rows, "query_id long, ld_key string, article string, name string, source_score double, source_rank int")
    assert [e.source_rank for e in ranking.evidence(df).first().source_evidence] == [1, 2, 3]


def test_retrieval_against_brute_force(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(120)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, "w1 W2 w1"), (1, "w3 nothing"), (2, "")], "query_id long, query string")
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)

    def bm25(terms, d):
        s = 0.0
        for t in terms:
            tf, df = toks[d].count(t), sum(t in x for x in toks)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[d]) / avg))
        return round(s, 6)

    want = []
    for q, terms in ((0, {"w1", "w2"}), (1, {"w3", "nothing"})):
        scores = sorted(((-bm25(terms, d), d) for d in range(n) if terms & set(toks[d])))[:10]
        want += [(q, d, -s, r) for r, (s, d) in enumerate(scores, 1)]
    got = sorted((r.query_id, r.doc_id, r.score, r.rank) for r in retrieval.bm25_topk(docs, queries, k=10).collect())
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted(want)] and [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], abs=2e-6)
    postings, lengths = retrieval.build_postings(docs, "doc_id", "text")
    stats, terms = retrieval.corpus_stats(lengths), retrieval.query_terms(queries, "query_id", "query")
    stored = retrieval.bm25_index_topk(postings, stats, terms, k=10)
    assert sorted((r.query_id, r.doc_id, r.score, r.rank) for r in stored.collect()) == got
    before, retrieval.BROADCAST_TERMS = retrieval.BROADCAST_TERMS, -1
    try:  # more terms than are broadcast
        monkey = [retrieval.bm25_index_topk(postings, stats, terms, k=10), retrieval.bm25_topk(docs, queries, k=10)]
    finally:
        retrieval.BROADCAST_TERMS = before
    monkey.append(retrieval.bm25_index_topk(postings, stats, terms, k=10, frequencies=postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))))
    for df in monkey:
        assert sorted((r.query_id, r.doc_id, r.score, r.rank) for r in df.collect()) == got
    x = rng.normal(size=(200, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(3, 6)))], "query_id long, query_vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in q.collect():
        s = np.round(u @ (np.array(r.query_vector) / np.linalg.norm(r.query_vector)), 6)
        best = sorted(range(200), key=lambda i: (-s[i], i))[:7]
        assert [y.doc_id for y in retrieval.dense_topk(v, q, k=7).where(F.col("query_id") == r.query_id).orderBy("rank").collect()] == best
    fused = retrieval.rrf([spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, doc_id long, rank int"), spark.createDataFrame([(0, 2, 1)], "query_id long, doc_id long, rank int")]).collect()
    assert [(r.doc_id, r.score) for r in sorted(fused, key=lambda r: r.rank)] == [(2, round(1 / 62 + 1 / 61, 9)), (1, round(1 / 61, 9))]


def test_stored_postings_are_pruned(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} common") for i in range(200)], "doc_id long, text string")
    postings, lengths = retrieval.build_postings(docs, "doc_id", "text")
    postings.write.partitionBy("bucket").parquet(f"{tmp_path}/postings")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "w5 nothing")], "query_id long, query string"), "query_id", "query")
    out = retrieval.bm25_index_topk(spark.read.parquet(f"{tmp_path}/postings"), retrieval.corpus_stats(lengths), terms)
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert sorted(r.doc_id for r in out.collect()) == [4, 5]


def test_dense_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one = sorted(map(tuple, retrieval.dense_topk(v, q, k=4).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_FLOATS", 9)  # three blocks
    blocks = retrieval.dense_topk(v.repartition(3), q, k=4)
    assert "collect" not in blocks._jdf.queryExecution().logical().toString().replace("collect_list", "")
    assert sorted(map(tuple, blocks.collect())) == one
    more = q.unionByName(spark.createDataFrame([(99, None)], q.schema))
    assert sorted(map(tuple, retrieval.dense_topk(v, more, k=4).collect())) == one
    names = q.select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query_id"), "query_vector")
    assert sorted((int(r.query_id[1:]), r.doc_id, r.score, r["rank"]) for r in retrieval.dense_topk(v, names, k=4).collect()) == one
    assert retrieval.dense_topk(v, q.limit(0), k=4).count() == 0 == retrieval.dense_topk(v.limit(0), q, k=4).count()


def test_dense_blocks_spread_over_slots(spark):
    v = spark.range(640, numPartitions=8).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).alias("slot"))
    assert v.distinct().count() == 16
    first = spark.range(8, numPartitions=8).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).alias("slot"))
    assert first.distinct().count() > 3  # one block a partition: their numbers agree in all low bits


def test_a_search_reads_postings_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} common") for i in range(50)], "doc_id long, text string")
    postings, lengths = retrieval.build_postings(docs, "doc_id", "text")
    postings.write.parquet(f"{tmp_path}/postings")
    postings.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.parquet(f"{tmp_path}/terms")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "w5 common")], "query_id long, query string"), "query_id", "query")
    of = [spark.read.parquet(f"{tmp_path}/{t}") for t in ("postings", "terms")]
    out = retrieval.bm25_index_topk(of[0], spark.createDataFrame([(50, 2.0)], "n long, avgdl double"), terms, frequencies=of[1])
    assert out._jdf.queryExecution().executedPlan().toString().count("tf:bigint,dl:bigint>") == 1  # one scan has these columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, retrieval.bm25_topk(docs, spark.createDataFrame([(0, "w5 common")], "query_id long, query string")).collect()))


def test_models_without_files_are_refused():
    from quarry.functions.encode import encoder_for

    assert encoder_for("hashing-64").dimension == 64 == encoder_for("hashing-64", 64).dimension
    for name, n in (("BAAI/bge-m3", 1024), ("hashing-x", 0), ("hashing-0", 0), ("hashing-64", 32)):
        with pytest.raises(ValueError):
            encoder_for(name, n)


def test_metrics(spark):
    gold = spark.createDataFrame([(0, "x", ["a"]), (1, "x", ["a", "b"]), (2, "no_match", []), (3, "y", ["q"])], "query_id long, category string, expected array<string>")
    found = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (1, "a", 1), (2, "z", 1)], "query_id long, article string, rank int")
    q = {r.query_id: r for r in evaluation.query_metrics(gold, found).collect()}
    assert q[0].ndcg == pytest.approx(1 / math.log2(3)) and q[0].rr == 0.5 and q[0].recall == 1.0 and q[0].precision == pytest.approx(0.05)
    assert q[1].recall == 0.5 and q[1].ndcg == pytest.approx(1 / (1 + 1 / math.log2(3))) and q[3].recall == 0.0 and q[3].rr == 0.0
    s = evaluation.summary(evaluation.query_metrics(gold, found)).first()
    assert (s.query_count, s.evaluated_retrieval_queries, s.no_match_fp_rate) == (4, 3, 1.0) and s.mrr == pytest.approx(0.5, abs=1e-9)
    assert {r.category: r.recall for r in evaluation.category_recall(evaluation.query_metrics(gold, found)).collect()} == {"x": 0.75, "y": 0.0}
    lat = spark.createDataFrame([(0, "m", 9.0), (1, "m", 1.0), (2, "m", 3.0), (3, "m", 5.0)], "i long, m string, v double")
    r = evaluation.latencies(lat, F.col("v"), ["m"], F.col("i")).first()
    assert (r.cold, r.warm_mean, r.p50, r.p95) == (9.0, 3.0, 3.0, 5.0)
    assert evaluation.duplicates(found).count() == 0
    twice = found.unionByName(spark.createDataFrame([(0, "a", 3)], "query_id long, article string, rank int"))
    assert evaluation.duplicates(twice).count() == 1 and sorted(map(str, evaluation.query_metrics(gold, twice).collect())) == sorted(map(str, evaluation.query_metrics(gold, found).collect()))


def test_index_and_search(spark, tmp_path):
    root, enc = str(tmp_path), HashingEncoder(64)
    rows = mapping_rows(spark, GROUPED)
    with pytest.raises(index.Missing):
        index.open_index(spark, root)
    first = index.build_index(rows, root, enc, smoke=("Temper DN80",), recreate=True)
    second = index.build_index(rows, root, enc, smoke=(), now=None)
    assert first.document_count == 3 and first.source_row_count == 5 and first.deduplicated_row_count == 4
    assert index.open_index(spark, root).meta.collection_name == first.collection_name != second.collection_name
    assert index.publish(spark, root, second.collection_name) and not index.publish(spark, root, second.collection_name)
    idx = index.open_index(spark, root, name="gone")
    assert idx.meta.collection_name == second.collection_name
    assert index.readiness(idx, enc, model="hashing-256") == []
    assert index.readiness(idx, HashingEncoder(32), model="other") == ["model_mismatch", "index_dimension_mismatch", "vector_dimension_mismatch"]
    out = engine.search_one(spark, "Temper КШ.П.П.015.40-01 Ду80 Ру16", idx, enc, limit=5)
    assert out[0]["id"].startswith("11100800162muld") and [r["rank"] for r in out] == list(range(1, len(out) + 1)) and len({r["id"] for r in out}) == len(out)
    for bad in (("", 5), ("x" * 513, 5), ("x", 101)):
        with pytest.raises(ValueError):
            engine.search_one(spark, bad[0], idx, enc, limit=bad[1])


def test_encoder_checks(spark):
    with pytest.raises(ValueError):
        checked(np.zeros((2, 3)), 2, 4)
    with pytest.raises(ValueError):
        checked([[np.nan]], 1, 1)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in encode(df, HashingEncoder(16), text="text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0) and not any(got[2])


def test_stream(spark, tmp_path):
    from quarry.streaming.ingest import ingest_once

    spark.createDataFrame([(1, "a b a"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    assert {r.doc_id: (r.dl, r.terms, r.tokens) for r in ingest_once(spark, f"{tmp_path}/in", f"{tmp_path}/index").collect()} == {1: (3, 2, 3), 2: (0, 0, 0)}
    spark.createDataFrame([(3, "c")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/in")
    assert ingest_once(spark, f"{tmp_path}/in", f"{tmp_path}/index").count() == 3
    assert spark.read.parquet(f"{tmp_path}/index/postings").count() == 3


def test_command_line(spark, tmp_path, monkeypatch):
    import csv
    import json

    from quarry.__main__ import main

    with open(tmp_path / "m.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(mapping.COLUMNS)
        w.writerows([(BASE | x)[c] for c in mapping.COLUMNS] for x in GROUPED)
    where = str(tmp_path)
    assert main(["profile", "--csv", f"{where}/m.csv", "--output", f"{where}/profile.json"]) == 0
    assert json.loads((tmp_path / "profile.json").read_text())["rows"] == 5
    assert main(["eval-set", "--csv", f"{where}/m.csv", "--output", f"{where}/queries"]) == 0
    assert mapping.read_queries(spark, f"{where}/queries").count() == 24
    assert main(["evaluate", "--csv", f"{where}/m.csv", "--queries", f"{where}/queries", "--root", f"{where}/root", "--output", f"{where}", "--dimension", "32", "0", "--timed", "3"]) == 0
    results = json.loads((tmp_path / "results.json").read_text())
    assert results["selected_model"] == "hashing-32" and [r["status"] for r in results["results"]] == ["completed", "failed"]
    assert results["results"][0]["recall"] > 0.5 and results["results"][0]["per_category_recall"]["exact_article"] == 1.0
    first = results["results"][0]
    assert first["cold_query_latency_ms"] > 0 and 0 < first["latency_p50_ms"] <= first["latency_p95_ms"] and first["ram_peak_mb"] > 0
    assert "Winner: hashing-32" in (tmp_path / "comparison.md").read_text()

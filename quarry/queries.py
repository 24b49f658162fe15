"""The engine's own queries over the supplied tables, and what they compute said in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import sql as S
from quarry.functions import sql_functions
from quarry.functions import text as T
from quarry.operators import catalog, evaluation, grouping, intervals, ordered, profile, ranking, retrieval
from quarry.operators.query_parse import parse_queries
from quarry.plans import engine, index
from quarry.session import shared_dir, spread
from quarry.sources.mapping import COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
# Texts, and what compatibility and case folding make of them.
COMPATIBLE = (
    ("№ 12½ Ｄn80", "no 121⁄2 dn80"),
    ("ﬁtting Ⅳ ㎜", "fitting iv mm"),
    ("x²+Å", "x2+å"),
    ("Ёлка ẞ", "елка ss"),
    ("Ａ－０４８６／２", "a-0486/2"),
    ("\u1e9b\u0323 Ǆ", "ṩ dž"),
    ("ﷺ", "صلى الله عليه وسلم"),
    ("e\u0301 é", "é é"),
    ("plain", "plain"),
    ("  \u3000wide  space ", "wide space"),
    ("ΣΑΣ", "σασ"),
    ("\u212a\u2126", "kω"),
)
LEXICAL_QUERY = "the and of there with inging tionly"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic mapping rows."""
    return spark.sql(S.CATALOG, **{t: table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier")}).select(*COLUMNS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.source_documents(cat(spark, sf_dir))


def heads(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return catalog.document_heads(cat(spark, sf_dir), **how)


def inline_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(S.QUERIES)), "query_id long, query string")


# -- profile --------------------------------------------------------------------------------------------------


def profile_counts(spark, sf_dir):
    return profile.counts(cat(spark, sf_dir))


def profile_nulls(spark, sf_dir):
    return profile.null_counts(cat(spark, sf_dir))


def profile_distribution(spark, sf_dir):
    return profile.distribution(cat(spark, sf_dir), ["match_score", "match_max"])


def profile_conflicts(spark, sf_dir):
    return profile.conflicts(cat(spark, sf_dir)).withColumns({c: F.array_join(c, "|") for c in ("ld_articles", "ld_names")})


def profile_conflict_count(spark, sf_dir):
    return profile.conflict_count(cat(spark, sf_dir))


# -- normalisation --------------------------------------------------------------------------------------------


def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.normalize_text("text")).alias("text_sha1"))


def norm_text_exact(spark, sf_dir):
    return T.exact_text_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), {"norm": "text"}).select("doc_id", F.sha1("norm").alias("text_sha1"))


def norm_article(spark, sf_dir):
    return cat(spark, sf_dir).select("steel_article").distinct().select(T.normalize_article("steel_article").alias("a")).select("a.*")


def norm_alias(column: str, dimension: str) -> Query:
    return lambda spark, sf_dir: cat(spark, sf_dir).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("canonical", T.normalize_alias("value", dimension))


def norm_numeric(spark, sf_dir):
    c = cat(spark, sf_dir).select("steel_dn", "steel_pn_bar", "ld_length").distinct()
    c = c.select("*", T.normalize_dn("steel_dn").alias("dn"), T.normalize_pn_bar("steel_pn_bar").alias("pn_bar"), T.normalize_length("ld_length").alias("length_mm"))
    return c.withColumns({"dn_text": T.number_text("dn"), "length_text": T.number_text(F.col("length_mm") / 16)})


NORM_SQL = """
SELECT DISTINCT steel_article, steel_dn, steel_pn_bar, ld_length, steel_connection, steel_medium, quarry_normalize_text(steel_article) AS norm, quarry_compact(steel_article) AS compact, quarry_dn(steel_dn) AS dn, quarry_pn_bar(steel_pn_bar) AS pn_bar,
  quarry_length_mm(ld_length) AS length_mm, quarry_number_text(quarry_length_mm(ld_length) / 16) AS length_text, quarry_connection(steel_connection) AS connection, quarry_medium(steel_medium) AS medium
FROM {cat}
"""


def norm_sql(spark, sf_dir):
    """The normalisers as plain SQL, over the distinct texts: they are in the result, so its own DISTINCT finds nothing more and needs no exchange."""
    sql_functions.register(spark)
    texts = cat(spark, sf_dir).select("steel_article", "steel_dn", "steel_pn_bar", "ld_length", "steel_connection", "steel_medium")
    return spark.sql(NORM_SQL, cat=texts.distinct())


def number_texts(spark, sf_dir):
    """Numbers of all sizes as text."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice").cast("double") * F.pow(F.lit(10.0), F.pmod("p_partkey", F.lit(16)) - 8)).alias("v"))
    return p.select("p_partkey", T.number_text("v").alias("text"))


def norm_compatible(spark, sf_dir):
    """Documents behind texts with compatibility characters, as articles and names have them."""
    before = F.element_at(F.array(*(F.lit(t) for t, _ in COMPATIBLE)), (F.col("doc_id") % len(COMPATIBLE) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(before, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    return T.exact_text_columns(rows, {"norm": "text"}).select("doc_id", F.sha1("norm").alias("norm_sha1"))


def title_brand(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.title_brand(F.col("p_name")).alias("title"), T.model_slug("p_brand").alias("slug"), T.encoder_text("p_name", "intfloat/multilingual-e5-base", "passage").alias("passage"))


# -- documents ------------------------------------------------------------------------------------------------


def source_documents(spark, sf_dir):
    d = heads(spark, sf_dir, counted=True)
    return d.select("steel_id", "article", "article_norm", "article_compact", "name", F.array_join("name_variants", "|").alias("name_variants"), "brand", "dn", "pn_bar", "connection", "medium", "control", "temperature", "length_mm", "url", "n_candidates")


def ld_candidates(spark, sf_dir):
    own = (F.col(f"ld_{n}").alias(n) for n in catalog.CANDIDATE_FIELDS)
    return catalog.candidates(cat(spark, sf_dir)).select("steel_id", F.col("ld_article_norm").alias("article_norm"), *own)


def canonical_value(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double"))
    return catalog.canonical(p, ["p_brand"], "size", numeric=True)


def semantic_text(spark, sf_dir):
    return heads(spark, sf_dir).select("steel_id", "semantic_text")


def lexical_text(spark, sf_dir):
    return heads(spark, sf_dir).select("steel_id", "lexical_text")


def point_ids(spark, sf_dir):
    return heads(spark, sf_dir).select("steel_id", catalog.point_id(F.col("steel_id")).alias("point_id"))


# -- retrieval ------------------------------------------------------------------------------------------------


def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.dense_topk(v, q, k=20)


def dense_topk_batch(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.dense_topk(v, q, k=20)


def bm25_topk(spark, sf_dir):
    q = spark.createDataFrame([(0, LEXICAL_QUERY)], "query_id long, query string")
    return retrieval.bm25_topk(table(spark, sf_dir, "documents"), q, k=50)


def bm25_topk_batch(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25_topk(table(spark, sf_dir, "documents"), q, k=20)


def _hybrid(spark, sf_dir):
    """Benchmark items as queries: their text against the documents, the vector of the same number against the embeddings."""
    b, v = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    lexical = retrieval.bm25_topk(table(spark, sf_dir, "documents"), b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    q = v.join(b.select("item_id"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.rrf([lexical, retrieval.dense_topk(v, q)])


def rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir)


def hybrid_normalise(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "doc_id", F.round(retrieval.max_normalised(F.col("score"), ["query_id"]), 6).alias("hybrid_score"))


# -- ranking over the catalogue -------------------------------------------------------------------------------


def query_parse(spark, sf_dir):
    p = parse_queries(spark.sql(S.ASKED.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")))
    return p.select("query_id", "normalized", "compact", "semantic_text", "lexical_text", F.array_join("possible_article_tokens", "|").alias("tokens"), "brand", "dn", "pn_bar", "connection", "medium", "control")


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, as an index has it."""
    path = _shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hits(spark, sf_dir, *, candidates: bool = False) -> DataFrame:
    """The documents that the inline queries find; only those need their candidates."""
    rows = cat(spark, sf_dir)
    docs = stored(catalog.document_heads(rows))
    parsed = stored(parse_queries(inline_queries(spark)))
    hits = retrieval.bm25_topk(docs.select("steel_id", "lexical_text"), parsed.select("query_id", "lexical_text"), doc_id="steel_id", text="lexical_text", query="lexical_text")
    if candidates:
        hits = stored(hits)
        found = hits.select(F.col("doc_id").alias("steel_id")).distinct()
        docs = stored(catalog.with_candidates(stored(docs.join(F.broadcast(found) if retrieval.small(found) else found, "steel_id", "left_semi")), rows))
    return engine.attach(hits, parsed, docs, doc_id="steel_id")


def _sources(spark, sf_dir, **how) -> DataFrame:
    return ranking.rank_sources(_hits(spark, sf_dir, **how))


def text_exactness(spark, sf_dir):
    return ranking.with_exactness(_hits(spark, sf_dir)).select("query_id", "doc_id", "text_exactness")


def field_score(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "doc_id", F.round(ranking.source_field_score(), 9).alias("source_field_score"))


def weighted_source_score(spark, sf_dir):
    return _sources(spark, sf_dir).select("query_id", "source_rank", "doc_id", "source_score", F.round("hybrid_score", 9).alias("hybrid_score"), "text_exactness")


def source_reasons(spark, sf_dir):
    reasons, mismatches = ranking.source_messages()
    return _sources(spark, sf_dir).select("query_id", "doc_id", F.array_join(reasons, "; ").alias("reasons"), F.array_join(mismatches, "; ").alias("mismatches"))


def ld_rank(spark, sf_dir):
    out = ranking.rank_candidates(_sources(spark, sf_dir, candidates=True), limit=20)
    return out.select("query_id", "rank", F.col("id").alias("ld_key"), "score", F.element_at("score_breakdown", "source_score").alias("source_score"))


def ld_evidence(spark, sf_dir):
    ev = ranking.evidence(ranking.expand_candidates(_sources(spark, sf_dir, candidates=True))).select("query_id", "ld_key", F.explode("source_evidence").alias("e"))
    return ev.select("query_id", "ld_key", "e.source_rank", "e.source_article", "e.source_score")


def match_reasons(spark, sf_dir):
    out = ranking.rank_candidates(_sources(spark, sf_dir, candidates=True))
    return out.select("query_id", F.col("id").alias("ld_key"), F.array_join("match_reasons", "; ").alias("reasons"), F.array_join("mismatches", "; ").alias("mismatches"))


# -- evaluation -----------------------------------------------------------------------------------------------


def eval_dataset(spark, sf_dir):
    return evaluation.eval_rows(cat(spark, sf_dir)).withColumn("expected_ld_articles", F.array_join("expected_ld_articles", "|"))


def _judged(spark, sf_dir) -> DataFrame:
    """Documents of the same source and good quality are relevant to a benchmark item."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    b = table(spark, sf_dir, "benchmark")
    good = docs.join(labels.where("quality = 1"), "doc_id").groupBy(F.pmod("doc_id", F.lit(37)).alias("bucket")).agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("expected"))
    gold = b.select("item_id", F.pmod("item_id", F.lit(40)).alias("bucket")).join(good, "bucket", "left")
    gold = gold.select(F.col("item_id").alias("query_id"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))
    found = bm25_topk_batch(spark, sf_dir).select("query_id", F.col("doc_id").cast("string").alias("article"), "rank")
    return evaluation.query_metrics(gold, found)


def eval_metrics(spark, sf_dir):
    return evaluation.summary(_judged(spark, sf_dir))


def eval_category_recall(spark, sf_dir):
    return evaluation.category_recall(_judged(spark, sf_dir))


def latency_percentiles(spark, sf_dir):
    return evaluation.latencies(table(spark, sf_dir, "events").select("event_type", "value", "event_id"), F.col("value"), ["event_type"], F.col("event_id"))


def model_leaderboard(spark, sf_dir):
    """Labels of the embeddings as stand-ins for models."""
    e = table(spark, sf_dir, "embeddings").withColumn("x", F.get("embedding", F.lit(0)).cast("double"))
    m = e.groupBy("label").agg(F.round(F.avg("x"), 6).alias("ndcg"), F.round(F.max("x"), 6).alias("recall"), F.round(F.min("x"), 6).alias("latency_p95"), F.count("*").alias("points"))
    m = m.select(F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model_name"), F.when(F.col("label") % 4 == 3, "failed").otherwise("completed").alias("status"), "ndcg", "recall", "latency_p95", F.when(F.col("label") % 2 == 0, F.col("points").cast("double")).alias("ram_mb"), "points")
    return evaluation.leaderboard(m).select("place", "model_name", "status", "ndcg", "recall")


# -- whole engine ---------------------------------------------------------------------------------------------


class LetterEncoder:
    """How often a text has each letter and digit. Its vectors are whole numbers, so SQL gives the same scores."""

    dimension = len(S.LETTERS)

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(c) for c in S.LETTERS] for t in texts], np.float32).reshape(len(texts), self.dimension)


def _index(spark: SparkSession, sf_dir: str, encoder=None) -> index.Index:
    """A new index of the synthetic rows, published and opened."""
    root = _shared(spark)
    index.build_index(cat(spark, sf_dir), root, encoder or LetterEncoder(), model="letters", smoke=("hot gear DN 25 PN16",), recreate=True)
    return index.open_index(spark, root)


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


def search_full(spark, sf_dir):
    """The whole program from a stored index: parse, both retrievers, fusion, ranking, candidates, evidence."""
    out = engine.search(inline_queries(spark), _index(spark, sf_dir), LetterEncoder(), engine.Settings(model="letters"))
    part = lambda c: F.element_at("score_breakdown", c)
    return out.select(
        "query_id", "rank", F.col("id").alias("ld_key"), "score", "relevance_rating", F.round("hybrid_score", 9).alias("hybrid_score"), part("source_score").alias("source_score"), part("text_exactness").alias("text_exactness"),
        F.col("product.name").alias("ld_name"), F.col("product.dn").alias("ld_dn"), F.col("product.price").alias("ld_price"),
        F.array_join(F.transform("source_evidence", lambda e: F.concat_ws(":", e.source_rank, e.source_article)), "|").alias("evidence"),
        F.array_join("match_reasons", "; ").alias("reasons"), F.array_join("mismatches", "; ").alias("mismatches"),
    )


def index_build(spark, sf_dir):
    """What a new index holds: its documents, vectors, postings and counts, and whether it can serve."""
    idx = _index(spark, sf_dir)
    problems = index.readiness(idx, LetterEncoder(), model="letters")
    m = idx.meta
    counts = idx.postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens")).join(idx.vectors.agg(F.count("*").alias("vectors"))).join(idx.stats.select("n", F.round("avgdl", 6).alias("avgdl")))
    kept = {"documents": m.document_count, "source_rows": m.source_row_count, "distinct_rows": m.deduplicated_row_count, "dimension": m.embedding_dimension, "readiness": ",".join(problems) or "ready"}
    return counts.select("*", *(F.lit(v).cast("long" if isinstance(v, int) else "string").alias(k) for k, v in kept.items()))


def stream_index(spark, sf_dir):
    from quarry.streaming.ingest import ingest_once

    return ingest_once(spark, f"{sf_dir}/documents.parquet", _shared(spark))


def bm25_blockmax(spark, sf_dir):
    """The same as bm25_topk_batch, from blocks with their highest impacts."""
    from quarry.operators import blockmax

    index_ = blockmax.write_blocks(table(spark, sf_dir, "documents"), _shared(spark))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return blockmax.blockmax_topk(index_, retrieval.query_terms(q, "query_id", "query"), k=20, save=stored)[0]


def dense_cells(spark, sf_dir):
    """The same as dense_topk_batch, from vectors stored by cell."""
    from quarry.operators import cells

    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return cells.cells_topk(cells.write_cells(v, _shared(spark)), q, k=20)[0]


REVISED = " hot gear revised edition"


def upsert_search(spark, sf_dir):
    """A live index after three runs of a stream: all documents, new texts for every third id, and every seventh id deleted."""
    from quarry.operators.retrieval import query_terms
    from quarry.plans import segments
    from quarry.streaming.ingest import upsert_stream

    root, docs = _shared(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    steps = (
        docs.select("*", F.lit(0).alias("version"), F.lit(False).alias("deleted")),
        docs.where("doc_id % 3 = 0").select("doc_id", F.concat("text", F.lit(REVISED)).alias("text"), F.lit(1).alias("version"), F.lit(False).alias("deleted")),
        docs.where("doc_id % 7 = 0").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("version"), F.lit(True).alias("deleted")),
    )
    for rows in steps:
        rows.write.mode("append").option("compression", segments.CODEC).parquet(f"{root}/in")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        upsert_stream(spark, arrived, f"{root}/live", fan=2, version="version", deleted="deleted").awaitTermination()
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return segments.search(spark, f"{root}/live", query_terms(q, "query_id", "query"), k=20)


# -- events and orders ----------------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("who"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value")


def _orders(spark, sf_dir) -> DataFrame:
    """Orders as events of the same month and users: a time in microseconds and a length that both follow from the key."""
    o = table(spark, sf_dir, "orders")
    at = F.lit(S.MONTH) + F.pmod(F.col("o_orderkey") * 7919, F.lit(2_592_000)) * 1_000_000
    return o.select("o_orderkey", F.pmod("o_custkey", F.lit(150)).alias("who"), at.alias("t"), (at + (1 + F.col("o_orderkey") % 9) * 40 * 60_000_000).alias("until"), "o_totalprice")


def asof_orders(spark, sf_dir):
    """Each event with the last order of its user before it, no older than two days."""
    take = ["o_orderkey", "o_totalprice"]
    out = ordered.asof_join(_events(spark, sf_dir), _orders(spark, sf_dir), by=["who"], left_time="t", right_time="t", take=take, ties=["o_orderkey"], tolerance=F.lit(2 * 86_400_000_000))
    return out.select("event_id", "who", "asof_t", "asof_o_orderkey", "asof_o_totalprice")


def overlap_orders(spark, sf_dir):
    """Windows of up to an hour after events against the windows of the same user's orders."""
    e = _events(spark, sf_dir).select("event_id", "who", "t", (F.col("t") + (1 + F.col("event_id") % 6) * 600_000_000).alias("until"))
    out = intervals.overlap_join(e, _orders(spark, sf_dir), by=["who"], left_span=("t", "until"), right_span=("t", "until"), least=600_000_000)
    return out.select("event_id", "other_o_orderkey", F.least("until", "other_until").alias("until"), F.greatest("t", "other_t").alias("since"))


def range_orders(spark, sf_dir):
    """Events inside the windows of the same user's orders."""
    out = intervals.range_join(_events(spark, sf_dir), _orders(spark, sf_dir), by=["who"], point="t", span=("t", "until"), least=600_000_000)
    return out.select("event_id", "value", "other_o_orderkey", "other_o_totalprice")


def event_frames(spark, sf_dir):
    """Lag, lead and row frames of each type's events."""
    values = {"before": ("value", "value", -1, -1), "after": ("value", "value", 1, 1), "last_ten": ("sum", "value", -9, 0), "around": ("avg", "value", -2, 2), "highest": ("max", "value", -50, 50), "rows": ("count", "value", -9, 0)}
    out = ordered.framed(_events(spark, sf_dir), ["event_type"], [F.col("t"), F.col("event_id")], values)
    return out.select("event_id", "place", "n", "before", "after", F.round("last_ten", 6).alias("last_ten"), F.round("around", 6).alias("around"), "highest", "rows")


def event_running(spark, sf_dir):
    """Running totals, places and sevenths of each type's events."""
    out = ordered.running(_events(spark, sf_dir), ["event_type"], [F.col("t"), F.col("event_id")], {"total": "value"}, tiles=7)
    return out.select("event_id", "place", "n", F.round("total", 6).alias("total"), "tile")


def stream_windows(spark, sf_dir):
    """Tumbling and sliding windows of each type's events and sessions of each user, kept by streams that two runs have fed."""
    from quarry.streaming import windows

    root = _shared(spark)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("who"), "event_type", "value")
    kinds = {
        "tumbling": (windows.Windows("ts", ("event_type",), size="6 hours"), "40 days"),
        "sliding": (windows.Windows("ts", ("event_type",), size="24 hours", slide="8 hours"), "40 days"),
        "session": (windows.Windows("ts", ("who",), gap="3 hours"), "1 hour"),
    }
    values = [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")]
    cut = F.timestamp_seconds(F.lit(S.MONTH // 1_000_000 + 15 * 86_400))
    for part in (rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)):
        part.write.mode("append").parquet(f"{root}/in")
        for kind, (w, delay) in kinds.items():
            windows.start(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), w, values, f"{root}/{kind}", watermark=delay).awaitTermination()
    out = None
    for kind, (w, _) in kinds.items():
        of = windows.result(spark, f"{root}/{kind}", w)
        of = of.select(F.lit(kind).alias("kind"), F.col(w.by[0]).alias("key"), F.unix_micros("start").alias("since"), F.unix_micros("end").alias("until"), "n", F.col("total").cast("double").alias("total"))
        out = of if out is None else out.unionByName(of)
    return out


def order_cube(spark, sf_dir):
    """Counts and prices of orders by status, priority and year, over every set of the three."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    out = grouping.cube(o, ["o_orderstatus", "o_orderpriority", "y"], {"orders": ("count", None), "total": ("sum", "price"), "least": ("min", "price"), "most": ("max", "price")})
    return out.withColumns({c: F.col(c).cast("double") for c in ("total", "least", "most")}).withColumn("mean", F.col("total") / F.col("orders"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        profile_counts, profile_nulls, profile_distribution, profile_conflicts, profile_conflict_count, norm_text, norm_text_exact, norm_compatible, norm_article, norm_numeric, number_texts, norm_sql, title_brand,
        source_documents, ld_candidates, canonical_value, semantic_text, lexical_text, point_ids, dense_topk, dense_topk_batch, bm25_topk, bm25_topk_batch, rrf_hybrid,
        hybrid_normalise, query_parse, text_exactness, field_score, weighted_source_score, source_reasons, ld_rank, ld_evidence, match_reasons, eval_dataset, eval_metrics,
        eval_category_recall, latency_percentiles, model_leaderboard, search_full, index_build, stream_index, upsert_search, bm25_blockmax, dense_cells, asof_orders, overlap_orders, range_orders, event_frames, event_running, order_cube, stream_windows,
    )
}
QUERIES |= {f"norm_{d}": norm_alias(c, d) for c, d in (("steel_name", "brand"), ("steel_connection", "connection"), ("steel_medium", "medium"), ("steel_control", "control"))}

_N = S.norm("steel_article")
_EVAL = f"""WITH {S.CAT}, {S.DOCS}, {S.LDS},
gold AS (SELECT k, string_agg(ld_article_norm, '|' ORDER BY ld_article_norm) AS expected FROM lk GROUP BY k),
el AS (SELECT docs.*, gold.expected, row_number() OVER (ORDER BY steel_id) AS place, coalesce({S.bare('article_norm')}, '') AS b FROM docs JOIN gold USING (k)
  WHERE brand <> '' AND connection <> '' AND medium <> '' AND control <> '' AND dn IS NOT NULL AND pn_bar IS NOT NULL),
e0 AS (SELECT *, place - 1 AS i, {S.g('dn')} AS d, {S.g('pn_bar')} AS p, greatest(1, length(b) // 2) AS h, least(length(b), greatest(3, length(b) // 2)) AS n FROM el WHERE place <= 70),
e1 AS (SELECT *, b[:h] || ' ' || b[h + 1:] AS split FROM e0),
e2 AS (SELECT *, [lower(article), upper(article), article_norm, b, trim(regexp_replace(article, '[./_-]+', ' ', 'g')), split][(i % 6)::INTEGER + 1] AS form FROM e1)
SELECT query, category, expected AS expected_ld_articles FROM (
  SELECT article AS query, 'exact_article' AS category, expected FROM e2
  UNION ALL SELECT CASE WHEN form = article THEN split ELSE form END, 'modified_article', expected FROM e2
  UNION ALL SELECT CASE WHEN i % 2 = 0 THEN b[:n] ELSE trim(b[:n] || ' ' || b[n + 1:]) END, 'partial_article', expected FROM e2
  UNION ALL SELECT name, 'full_name', expected FROM e2
  UNION ALL SELECT concat_ws(' ', brand, 'DN' || d, 'PN' || p), 'brand_dn_pn', expected FROM e2
  UNION ALL SELECT concat_ws(' ', 'Нужен аналог', name, 'для DN ' || d, 'PN ' || p, connection, medium), 'natural_language', expected FROM e2
  UNION ALL SELECT concat_ws(' ', brand, article, name, 'DN' || d, 'PN' || p, connection), 'mixed', expected FROM e2
  UNION ALL SELECT 'no_match_' || lpad(i::VARCHAR, 4, '0') || '_zxqv', 'no_match', '' FROM e2)"""
_BATCH = "bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_HYBRID = f"WITH {_BATCH}, {S.bm25('documents', 'doc_id', 'text', 'bq', 'query')}, vv AS (SELECT vec_id AS doc_id, embedding AS v FROM embeddings), vq AS (SELECT item_id AS query_id, embedding AS qv FROM embeddings JOIN benchmark ON vec_id = item_id), {S.dense('vv', 'vq', 300)}, {S.rrf(['bm', 'dn'])}"
_JUDGED = f"""WITH {_BATCH}, {S.bm25('documents', 'doc_id', 'text', 'bq', 'query', 20)},
good AS (SELECT DISTINCT doc_id % 37 AS bucket, d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE quality = 1),
gold AS (SELECT item_id AS query_id, 'c' || (item_id % 3)::VARCHAR AS category, good.doc_id FROM benchmark LEFT JOIN good ON item_id % 40 = bucket),
sz AS (SELECT query_id, any_value(category) AS category, count(doc_id) AS size FROM gold GROUP BY 1),
hit AS (SELECT query_id, count(*) AS hits, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg, min(rank) AS first FROM bm JOIN gold USING (query_id, doc_id) GROUP BY 1),
ide AS (SELECT i AS size, sum(1.0::DOUBLE / log2(i + 1)) OVER (ORDER BY i) AS ideal FROM range(1, 21) t(i)),
pq AS (SELECT sz.query_id, category, sz.size, coalesce(hits, 0) / sz.size::DOUBLE AS recall, coalesce(hits, 0) / 20.0::DOUBLE AS precision, coalesce(dcg, 0) / ideal AS ndcg, coalesce(1.0::DOUBLE / first, 0) AS rr, EXISTS (SELECT 1 FROM bm WHERE bm.query_id = sz.query_id) AS answered
  FROM sz LEFT JOIN hit USING (query_id) LEFT JOIN ide ON ide.size = least(sz.size, 20))"""
_reasons, _wrong = S.messages()
_source_reasons, _source_wrong = S.source_messages()
_ALIAS = lambda c, d: f"WITH {S.CAT} SELECT {c} AS value, count(*)::BIGINT AS n, {S.alias(S.norm(c), d)} AS canonical FROM cat GROUP BY 1"

ORACLE: dict[str, str] = {
    "profile_counts": f"""WITH {S.CAT}, c AS (SELECT * EXCLUDE (l_orderkey, l_linenumber) FROM cat)
SELECT count(*)::BIGINT AS rows, {len(COLUMNS)}::INTEGER AS columns, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)))::BIGINT AS full_duplicates, count(DISTINCT steel_article)::BIGINT AS unique_steel_articles,
  count(DISTINCT ld_article)::BIGINT AS unique_ld_articles, (SELECT count(*) FROM (SELECT DISTINCT steel_article, ld_article FROM c))::BIGINT AS unique_steel_ld_pairs FROM c""",
    "profile_nulls": f"WITH {S.CAT} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL)::BIGINT AS nulls FROM cat" for c in COLUMNS),
    "profile_distribution": f"WITH {S.CAT} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, coalesce({c}::VARCHAR, 'null') AS value, count(*)::BIGINT AS n FROM cat GROUP BY 2" for c in ("match_score", "match_max")),
    "profile_conflicts": f"""WITH {S.CAT}, t AS (SELECT steel_article, count(*)::BIGINT AS row_count, count(DISTINCT ld_article)::BIGINT AS distinct_ld_articles, array_to_string(list_sort(list(DISTINCT ld_article))[:5], '|') AS ld_articles,
  array_to_string(list_sort(list(DISTINCT ld_name))[:5], '|') AS ld_names FROM cat GROUP BY 1) SELECT * FROM t WHERE distinct_ld_articles > 1 ORDER BY steel_article LIMIT 20""",
    "profile_conflict_count": f"WITH {S.CAT} SELECT count(*)::BIGINT AS conflicting_steel_articles FROM (SELECT steel_article FROM cat GROUP BY 1 HAVING count(DISTINCT ld_article) > 1)",
    "norm_text": f"SELECT doc_id, sha1({S.norm('text')}) AS text_sha1 FROM documents",
    "norm_text_exact": f"SELECT doc_id, sha1({S.norm('text')}) AS text_sha1 FROM documents",
    "norm_compatible": f"SELECT doc_id, sha1(trim([{', '.join(repr(t) for _, t in COMPATIBLE)}][(doc_id % {len(COMPATIBLE)} + 1)::INTEGER] || ' ' || coalesce({S.norm('text')}, ''))) AS norm_sha1 FROM documents",
    "number_texts": f"SELECT p_partkey, {S.g('p_retailprice::DOUBLE * power(10.0::DOUBLE, p_partkey % 16 - 8)')} AS text FROM part",
    "norm_article": f"WITH {S.CAT} SELECT DISTINCT steel_article AS raw, {_N} AS norm, {S.bare(_N)} AS compact FROM cat",
    "norm_brand": _ALIAS("steel_name", "brand"),
    "norm_connection": _ALIAS("steel_connection", "connection"),
    "norm_medium": _ALIAS("steel_medium", "medium"),
    "norm_control": _ALIAS("steel_control", "control"),
    "norm_numeric": f"""WITH {S.CAT}, n AS (SELECT DISTINCT steel_dn, steel_pn_bar, ld_length, {S.number(S.norm('steel_dn'))} AS dn, {S.pn(S.norm('steel_pn_bar'))} AS pn_bar, {S.length(S.norm('ld_length'))} AS length_mm FROM cat)
SELECT *, {S.g('dn')} AS dn_text, {S.g('length_mm / 16')} AS length_text FROM n""",
    "norm_sql": f"""WITH {S.CAT}, n AS (SELECT DISTINCT steel_article, steel_dn, steel_pn_bar, ld_length, steel_connection, steel_medium FROM cat)
SELECT *, {_N} AS norm, {S.bare(_N)} AS compact, {S.number(S.norm('steel_dn'))} AS dn, {S.pn(S.norm('steel_pn_bar'))} AS pn_bar, {S.length(S.norm('ld_length'))} AS length_mm, {S.g(S.length(S.norm('ld_length')) + ' / 16')} AS length_text,
  {S.alias(S.norm('steel_connection'), 'connection')} AS connection, {S.alias(S.norm('steel_medium'), 'medium')} AS medium FROM n""",
    "title_brand": "SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS title, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS slug, 'passage: ' || p_name AS passage FROM part",
    "source_documents": f"""WITH {S.CAT}, {S.DOCS}, lk AS (SELECT k, count(DISTINCT ld_article_norm) AS c FROM src WHERE ld_article_norm <> '' GROUP BY 1)
SELECT steel_id, article, article_norm, article_compact, name, array_to_string(name_variants, '|') AS name_variants, brand, dn, pn_bar, connection, medium, control, temperature, length_mm, url, coalesce(lk.c, 0)::INTEGER AS n_candidates FROM docs LEFT JOIN lk USING (k)""",
    "ld_candidates": f"""WITH {S.CAT}, {S.DOCS}, {S.LDS} SELECT steel_id, ld_article_norm AS article_norm, ld_article AS article, ld_name AS name, ld_url AS url, ld_dn AS dn, ld_pn_bar AS pn_bar, ld_connection AS connection, ld_medium AS medium, ld_control AS control,
  NULL::VARCHAR AS temperature, ld_length_mm AS length_mm, ld_price AS price FROM docs JOIN lds USING (k)""",
    "canonical_value": f"WITH t AS (SELECT p_brand, p_size::DOUBLE AS size FROM part), {S.canon('c', 'p_brand', 'size', 't')} SELECT * FROM c",
    "semantic_text": f"WITH {S.CAT}, {S.DOCS} SELECT steel_id, {S.SEMANTIC} AS semantic_text FROM docs",
    "lexical_text": f"WITH {S.CAT}, {S.DOCS} SELECT steel_id, lexical_text FROM lex",
    "point_ids": f"""WITH {S.CAT}, {S.DOCS}, h AS (SELECT steel_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('quarry:' || steel_id)) AS h FROM docs)
SELECT steel_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + ('0x' || h[17])::INTEGER % 4, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
    "stream_index": f"WITH t AS (SELECT doc_id, {S.TOKENS.format(S.norm('text'))} AS toks FROM documents) SELECT doc_id, coalesce(len(toks), 0)::BIGINT AS dl, coalesce(len(list_distinct(toks)), 0)::BIGINT AS terms, coalesce(len(toks), 0)::BIGINT AS tokens FROM t",
    "index_build": f"""WITH {S.CAT}, {S.DOCS}, {S.bm25('lex', 'steel_id', 'lexical_text', "(SELECT 0 AS query_id, 'x' AS query)", 'query')}
SELECT (SELECT count(*) FROM bm_f)::BIGINT AS postings, (SELECT sum(tf) FROM bm_f)::BIGINT AS tokens, (SELECT count(*) FROM docs)::BIGINT AS vectors, n::BIGINT AS n, round(avgdl, 6) AS avgdl,
  (SELECT count(*) FROM docs)::BIGINT AS documents, (SELECT count(*) FROM cat)::BIGINT AS source_rows, (SELECT count(*) FROM src0)::BIGINT AS distinct_rows, {LetterEncoder.dimension}::BIGINT AS dimension, 'ready' AS readiness FROM bm_s""",
    "search_full": f"""WITH {S.FUSED_HITS}, {S.SOURCES}, {S.CANDS}, {S.EVIDENCE},
evs AS (SELECT query_id, ld_key, string_agg(source_rank::VARCHAR || ':' || article, '|' ORDER BY source_rank) AS evidence FROM ev WHERE place <= 3 GROUP BY 1, 2)
SELECT query_id, rank, ld_key, final_score AS score, round(final_score * 100, 1) AS relevance_rating, round(hybrid_score, 9) AS hybrid_score, source_score, text_exactness, ld_name, ld_dn, ld_price::DOUBLE AS ld_price, evidence, {_reasons} AS reasons, {_wrong} AS mismatches
FROM best JOIN evs USING (query_id, ld_key) WHERE rank <= 20""",
    "dense_topk": f"WITH vv AS (SELECT vec_id AS doc_id, embedding AS v FROM embeddings), vq AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id = 0), {S.dense('vv', 'vq', 20)} SELECT * FROM dn",
    "dense_topk_batch": f"WITH vv AS (SELECT vec_id AS doc_id, embedding AS v FROM embeddings), vq AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), {S.dense('vv', 'vq', 20)} SELECT * FROM dn",
    "bm25_topk": f"WITH bq AS (SELECT 0::BIGINT AS query_id, '{LEXICAL_QUERY}' AS query), {S.bm25('documents', 'doc_id', 'text', 'bq', 'query', 50)} SELECT * FROM bm",
    "bm25_topk_batch": f"WITH {_BATCH}, {S.bm25('documents', 'doc_id', 'text', 'bq', 'query', 20)} SELECT * FROM bm",
    "asof_orders": f"""WITH {S.EVENTS}, o1 AS (SELECT who, t, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM o GROUP BY 1, 2),
j AS (SELECT e.event_id, e.who, e.t AS now, o1.t, o1.o_orderkey, o1.o_totalprice FROM e ASOF LEFT JOIN o1 ON e.who = o1.who AND e.t >= o1.t)
SELECT event_id, who, CASE WHEN t + 172800000000 >= now THEN t END AS asof_t, CASE WHEN t + 172800000000 >= now THEN o_orderkey END AS asof_o_orderkey, CASE WHEN t + 172800000000 >= now THEN o_totalprice END AS asof_o_totalprice FROM j""",
    "overlap_orders": f"""WITH {S.EVENTS}, w AS (SELECT *, t + (1 + event_id % 6) * 600000000 AS until FROM e)
SELECT event_id, o_orderkey AS other_o_orderkey, least(w.until, o.until) AS until, greatest(w.t, o.t) AS since FROM w JOIN o ON w.who = o.who AND w.t < o.until AND o.t < w.until""",
    "range_orders": f"WITH {S.EVENTS} SELECT event_id, value, o_orderkey AS other_o_orderkey, o_totalprice AS other_o_totalprice FROM e JOIN o ON e.who = o.who AND e.t >= o.t AND e.t < o.until",
    "event_frames": f"""WITH {S.EVENTS} SELECT event_id, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n, lag(value) OVER w AS before, lead(value) OVER w AS after, round(sum(value) OVER (w ROWS 9 PRECEDING), 6) AS last_ten,
  round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS around, max(value) OVER (w ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS highest, count(value) OVER (w ROWS 9 PRECEDING) AS rows FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)""",
    "event_running": f"""WITH {S.EVENTS} SELECT event_id, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS total, (ntile(7) OVER w)::INTEGER AS tile FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)""",
    "stream_windows": f"""WITH ev AS (SELECT event_id, user_id::VARCHAR AS who, event_type, epoch_us(ts) AS t, value::DECIMAL(18, 2) AS v FROM events),
h AS (SELECT 3600000000::BIGINT AS h),
tu AS (SELECT 'tumbling' AS kind, event_type AS key, t - t % (6 * h) AS since, t - t % (6 * h) + 6 * h AS until, v FROM ev, h),
sl AS (SELECT 'sliding' AS kind, event_type AS key, t - t % (8 * h) - i * 8 * h AS since, t - t % (8 * h) - i * 8 * h + 24 * h AS until, v FROM ev, h, range(3) r(i)),
g AS (SELECT who, t, v, CASE WHEN t < lag(t) OVER (PARTITION BY who ORDER BY t, event_id) + 3 * h THEN 0 ELSE 1 END AS fresh, event_id FROM ev, h),
se AS (SELECT who, t, v, sum(fresh) OVER (PARTITION BY who ORDER BY t, event_id) AS s FROM g),
ss AS (SELECT 'session' AS kind, who AS key, min(t) AS since, max(t) + 3 * any_value(h) AS until, count(*) AS n, sum(v) AS total FROM se, h GROUP BY who, s HAVING max(t) + 3 * any_value(h) <= (SELECT max(t) - any_value(h) FROM ev, h) // 1000 * 1000)
SELECT kind, key, since::BIGINT AS since, until::BIGINT AS until, count(*)::BIGINT AS n, sum(v)::DOUBLE AS total FROM (SELECT * FROM tu UNION ALL SELECT * FROM sl) GROUP BY ALL
UNION ALL SELECT kind, key, since::BIGINT, until::BIGINT, n::BIGINT, total::DOUBLE FROM ss""",
    "order_cube": """WITH t AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INTEGER AS y, o_totalprice::DECIMAL(18, 2) AS price FROM orders)
SELECT o_orderstatus, o_orderpriority, y, grouping(o_orderstatus, o_orderpriority, y)::BIGINT AS grouping_id, count(*)::BIGINT AS orders, sum(price)::DOUBLE AS total, min(price)::DOUBLE AS least, max(price)::DOUBLE AS most, sum(price)::DOUBLE / count(*) AS mean
FROM t GROUP BY CUBE (o_orderstatus, o_orderpriority, y)""",
    "dense_cells": f"WITH vv AS (SELECT vec_id AS doc_id, embedding AS v FROM embeddings), vq AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), {S.dense('vv', 'vq', 20)} SELECT * FROM dn",
    "bm25_blockmax": f"WITH {_BATCH}, {S.bm25('documents', 'doc_id', 'text', 'bq', 'query', 20)} SELECT * FROM bm",
    "upsert_search": f"""WITH {_BATCH}, now AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN max(text) || '{REVISED}' ELSE max(text) END AS text FROM documents WHERE doc_id % 7 <> 0 GROUP BY doc_id),
{S.bm25('now', 'doc_id', 'text', 'bq', 'query', 20)} SELECT * FROM bm""",
    "rrf_hybrid": f"{_HYBRID} SELECT * FROM rf",
    "hybrid_normalise": f"{_HYBRID} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS hybrid_score FROM rf",
    "query_parse": f"WITH asked AS ({S.ASKED}), {S.parsed(table='asked')} SELECT query_id, normalized, compact, semantic_text, lexical_text, array_to_string(toks, '|') AS tokens, brand, dn, pn_bar, connection, medium, control FROM q",
    "text_exactness": f"WITH {S.HITS}, {S.EXACT} SELECT query_id, doc_id, text_exactness FROM hits LEFT JOIN ex USING (query_id, doc_id)",
    "field_score": f"WITH {S.HITS}, {S.SOURCES} SELECT query_id, doc_id, round(source_field_score, 9) AS source_field_score FROM sources",
    "weighted_source_score": f"WITH {S.HITS}, {S.SOURCES} SELECT query_id, source_rank, doc_id, source_score, round(hybrid_score, 9) AS hybrid_score, text_exactness FROM sources",
    "ld_rank": f"WITH {S.HITS}, {S.SOURCES}, {S.CANDS} SELECT query_id, rank, ld_key, final_score AS score, source_score FROM best WHERE rank <= 20",
    "ld_evidence": f"WITH {S.HITS}, {S.SOURCES}, {S.CANDS}, {S.EVIDENCE} SELECT query_id, ld_key, source_rank, article AS source_article, source_score FROM ev WHERE place <= 3",
    "match_reasons": f"WITH {S.HITS}, {S.SOURCES}, {S.CANDS} SELECT query_id, ld_key, {_reasons} AS reasons, {_wrong} AS mismatches FROM best",
    "source_reasons": f"WITH {S.HITS}, {S.SOURCES} SELECT query_id, doc_id, {_source_reasons} AS reasons, {_source_wrong} AS mismatches FROM sources",
    "eval_dataset": _EVAL,
    "eval_metrics": f"""{_JUDGED} SELECT count(*)::BIGINT AS query_count, count(*) FILTER (size > 0)::BIGINT AS evaluated_retrieval_queries, round(coalesce(avg(recall) FILTER (size > 0), 0), 9) AS recall, round(coalesce(avg(precision) FILTER (size > 0), 0), 9) AS precision,
  round(coalesce(avg(ndcg) FILTER (size > 0), 0), 9) AS ndcg, round(coalesce(avg(rr) FILTER (size > 0), 0), 9) AS mrr, round(coalesce(avg(answered::INTEGER::DOUBLE) FILTER (size = 0), 0), 9) AS no_match_fp_rate FROM pq""",
    "eval_category_recall": f"{_JUDGED} SELECT category, round(avg(recall), 9) AS recall FROM pq WHERE size > 0 GROUP BY 1",
    "latency_percentiles": """WITH f AS (SELECT event_type, min(event_id) AS first, arg_min(value, event_id) AS cold FROM events GROUP BY 1)
SELECT event_type, any_value(cold) AS cold, count(*) FILTER (event_id <> first)::BIGINT AS warm_queries, round(avg(value) FILTER (event_id <> first), 6) AS warm_mean, coalesce(quantile_disc(value, 0.5) FILTER (event_id <> first), 0) AS p50, coalesce(quantile_disc(value, 0.95) FILTER (event_id <> first), 0) AS p95
FROM events JOIN f USING (event_type) GROUP BY 1""",
    "model_leaderboard": """WITH m AS (SELECT 'model-' || label::VARCHAR AS model_name, CASE WHEN label % 4 = 3 THEN 'failed' ELSE 'completed' END AS status, round(avg(embedding[1]::DOUBLE), 6) AS ndcg, round(max(embedding[1]::DOUBLE), 6) AS recall, round(min(embedding[1]::DOUBLE), 6) AS p95,
  CASE WHEN label % 2 = 0 THEN count(*)::DOUBLE END AS ram, count(*) AS points FROM embeddings GROUP BY label)
SELECT row_number() OVER (ORDER BY status <> 'completed', ndcg DESC, recall DESC, p95, ram NULLS LAST, points, model_name)::INTEGER AS place, model_name, status, ndcg, recall FROM m""",
}

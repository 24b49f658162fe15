"""The search: queries in, ranked candidates with evidence and explanations out, as one DataFrame program over many queries."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import encoder_text
from quarry.functions.encode import Encoder, checked, encode, encoding
from quarry.operators.query_parse import PARSED, parse_queries
from quarry.operators.ranking import query_columns, rank_candidates, rank_sources
from quarry.operators.retrieval import bm25_index_topk, dense_topk, query_terms, rrf
from quarry.settings import Settings


def validate(query: str, limit: int, s: Settings = Settings()) -> None:
    """The request rules of the service: 1 to 512 characters, limit 1 to 100."""
    if not isinstance(query, str) or not 1 <= len(query) <= s.query_chars:
        raise ValueError(f"query must have 1 to {s.query_chars} characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= s.limit_max:
        raise ValueError(f"limit must be from 1 to {s.limit_max}")


def retrieve(parsed: DataFrame, index, encoder: Encoder, s: Settings = Settings(), *, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the fused candidates of both retrievers. vectors: (query_id, query_vector), if they are known."""
    if vectors is None:
        texts = parsed.select("query_id", encoder_text("semantic_text", s.model, "query").alias("text"))
        vectors = encode(texts, encoder, text="text", out="query_vector", batch=s.dense_batch_size, role="query")
    dense = dense_topk(index.vectors, vectors, id_col="doc_id", vector="vector", k=s.prefetch)
    sparse = bm25_index_topk(index.postings, index.stats, query_terms(parsed, "query_id", "lexical_text"), k=s.prefetch, frequencies=index.terms)
    return rrf([dense, sparse], k=s.prefetch, rrf_k=s.rrf_k)


def attach(hits: DataFrame, parsed: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Hits with their documents and parsed queries. Hits are at most prefetch rows a query; only ids travel before this."""
    h = hits.select("query_id", "doc_id", F.col("score").alias("raw_score"))
    d = docs if doc_id == "doc_id" else docs.withColumn("doc_id", F.col(doc_id))
    return h.join(d, "doc_id").join(query_columns(parsed), "query_id")


def search(queries: DataFrame, index, encoder: Encoder, s: Settings = Settings(), *, limit: int | None = None) -> DataFrame:
    """Ranked candidates of all queries (query_id, query)."""
    parsed = parse_queries(queries)
    hits = retrieve(parsed, index, encoder, s)
    sources = rank_sources(attach(hits, parsed, index.docs), s.weights)
    out = rank_candidates(sources, s.weights, limit=s.limit if limit is None else limit)
    return out if s.min_score is None else out.where(F.col("score") >= s.min_score)


def response(result: DataFrame) -> DataFrame:
    """The public fields of a result, nulls left out of the JSON."""
    return result.select("query_id", "rank", F.to_json(F.struct("rank", "relevance_rating", "product", "source_evidence", "match_reasons", "mismatches", "score_breakdown")).alias("result"))


@dataclass
class Answer:
    """What the service answers a query with."""

    query: str
    processed: dict
    results: list[dict]
    timing_ms: dict[str, float] = field(default_factory=dict)


def answer(spark, query: str, index, encoder: Encoder, s: Settings = Settings(), *, limit: int | None = None) -> Answer:
    """One query, stage by stage, each timed: normalize, embedding, retrieval, ranking, and their total.

    What lies between two stages is small: the parsed query, its vector, and prefetch ids with their scores.
    """
    n = s.limit if limit is None else limit
    validate(query, n, s)
    timing: dict[str, float] = {}
    began = time.perf_counter()

    def lap(stage: str) -> None:
        nonlocal began
        now = time.perf_counter()
        timing[stage] = (now - began) * 1000
        began = now

    one = parse_queries(spark.createDataFrame([(0, query)], "query_id long, query string"))
    row = one.withColumn("__text", encoder_text("semantic_text", s.model, "query")).first()
    parsed = spark.createDataFrame([tuple(row[c] for c in one.columns)], one.schema)
    lap("normalize")
    vector = checked(encoding(encoder, "query")([row["__text"]]), 1, encoder.dimension)[0]
    vectors = spark.createDataFrame([(0, vector.tolist())], "query_id long, query_vector array<float>")
    lap("embedding")
    found = retrieve(parsed, index, encoder, s, vectors=vectors)
    hits = spark.createDataFrame(found.collect(), found.schema)  # prefetch rows at most
    lap("retrieval")
    sources = rank_sources(attach(hits, parsed, index.docs), s.weights)
    out = rank_candidates(sources, s.weights, limit=n)
    out = out if s.min_score is None else out.where(F.col("score") >= s.min_score)
    results = [r.asDict(recursive=True) for r in out.orderBy("rank").collect()]
    lap("ranking")
    timing["total"] = sum(timing.values())
    return Answer(query, {c: row[c] for c in PARSED}, results, timing)


def search_one(spark, query: str, index, encoder: Encoder, s: Settings = Settings(), *, limit: int | None = None, top_k: int | None = None) -> list[dict]:
    """The results of a single query; top_k is the older name of limit and comes first."""
    return answer(spark, query, index, encoder, s, limit=top_k or limit or s.limit).results

"""Model evaluation: an index for each model, the query set as one batch, metrics, a ranked comparison and its reports."""

from __future__ import annotations

import json
import math
import time
import tracemalloc
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.encode import Encoder
from quarry.functions.text import normalize_text
from quarry.operators import evaluation
from quarry.plans import engine, index

#: Queries that are also sent one after another, for the latency of one; None: all of them.
TIMED = None


@dataclass
class Result:
    model_name: str
    status: str = "completed"
    error: str | None = None
    collection_name: str | None = None
    document_count: int = 0
    embedding_dimension: int = 0
    indexing_time_ms: float = 0.0
    query_count: int = 0
    evaluated_retrieval_queries: int = 0
    recall: float = 0.0
    precision: float = 0.0
    ndcg: float = 0.0
    mrr: float = 0.0
    no_match_fp_rate: float = 0.0
    batch_ms: float = 0.0
    queries_per_second: float = 0.0
    cold_query_latency_ms: float | None = None
    warm_query_latency_ms: float | None = None
    latency_p50_ms: float = 0.0
    latency_p95_ms: float = 0.0
    ram_peak_mb: float | None = None
    per_category_recall: dict[str, float] = field(default_factory=dict)


def gold_of(dataset: DataFrame) -> DataFrame:
    """(query_id, query, category, expected) with normalised articles."""
    d = dataset.withColumn("query_id", F.monotonically_increasing_id())
    norm = lambda a: F.coalesce(normalize_text(a), F.lower(F.trim(a)))
    return d.select("query_id", "query", "category", F.array_distinct(F.transform("expected_ld_articles", norm)).alias("expected"))


def nearest_rank(values: list[float], percent: float) -> float:
    """The smallest value that so many percent of all don't exceed; 0 without any."""
    return sorted(values)[max(0, math.ceil(percent / 100 * len(values)) - 1)] if values else 0.0


def latencies(queries: list[str], idx, encoder: Encoder, settings: engine.Settings, spark) -> dict:
    """Cold (first) and warm latency of queries that are sent one after another, and the peak of Python's memory meanwhile."""
    tracemalloc.start()
    try:
        took = [engine.answer(spark, q, idx, encoder, settings).timing_ms["total"] for q in queries if 1 <= len(q) <= settings.query_chars]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    warm = took[1:]
    return {
        "cold_query_latency_ms": took[0] if took else None,
        "warm_query_latency_ms": sum(warm) / len(warm) if warm else None,
        "latency_p50_ms": nearest_rank(warm, 50),
        "latency_p95_ms": nearest_rank(warm, 95),
        "ram_peak_mb": peak / 2**20 if peak else None,
    }


def evaluate_model(name: str, make: Callable[[], Encoder], rows: DataFrame, gold: DataFrame, root: str, *, limit: int = evaluation.LIMIT, timed: int | None = TIMED) -> Result:
    """Build the model's own version, search all queries at once, and measure. gold is read more than once: give it stored.

    Quality and throughput come from all queries, as one batch; the latency of a query alone from all, or the first ``timed`` of them.
    """
    spark = rows.sparkSession
    encoder = make()
    settings = engine.Settings(model=name, dimension=encoder.dimension, limit=limit)
    began = time.perf_counter()
    meta = index.build_index(rows, root, encoder, model=name, smoke=())
    built = time.perf_counter()
    idx = index.open_version(spark, root, meta.collection_name)
    where = f"{root}/{meta.collection_name}/results"
    engine.search(gold.select("query_id", "query"), idx, encoder, settings).select("query_id", F.col("id").alias("article"), "rank").write.parquet(where)
    searched = time.perf_counter()
    found = spark.read.parquet(where)
    if evaluation.duplicates(found).limit(1).count():
        raise RuntimeError("a ranked list holds an article twice")
    per_query = evaluation.query_metrics(gold, found, limit=limit)
    s = evaluation.summary(per_query).first().asDict()
    by = {r.category: r.recall for r in evaluation.category_recall(per_query).orderBy("category").collect()}
    took = searched - built
    alone = [r["query"] for r in (gold.orderBy("query_id") if timed is None else gold.orderBy("query_id").limit(timed)).collect()]
    return Result(name, collection_name=meta.collection_name, document_count=meta.document_count, embedding_dimension=encoder.dimension, indexing_time_ms=(built - began) * 1000, batch_ms=took * 1000, queries_per_second=s["query_count"] / took, per_category_recall=by, **s, **latencies(alone, idx, encoder, settings, spark))


def compare(models: dict[str, Callable[[], Encoder]], rows: DataFrame, gold: DataFrame, root: str, *, limit: int = evaluation.LIMIT, timed: int | None = TIMED) -> list[Result]:
    """All models, best first; one that fails is reported, and stops nothing."""
    out = []
    for name, make in models.items():
        try:
            out.append(evaluate_model(name, make, rows, gold, root, limit=limit, timed=timed))
        except Exception as e:  # noqa: BLE001
            out.append(Result(name, status="failed", error=f"{type(e).__name__}: {e}"[:500]))
    unknown = float("inf")
    return sorted(out, key=lambda r: (r.status != "completed", -r.ndcg, -r.recall, r.latency_p95_ms, unknown if r.ram_peak_mb is None else r.ram_peak_mb, r.document_count))


def write_results(results: list[Result], path: str | Path, run_id: str = "") -> Path:
    best = next((r.model_name for r in results if r.status == "completed"), None)
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"run_id": run_id or index.utc_stamp(), "models": [r.model_name for r in results], "selected_model": best, "results": [asdict(r) for r in results]}, ensure_ascii=False, indent=2), encoding="utf-8")
    return path


def markdown(results: list[Result]) -> str:
    """A ranked table, the winner, and what failed."""
    lines = ["# Model comparison", "", "| place | model | nDCG | recall | MRR | precision | no-match FP | p50 ms | p95 ms | RAM MiB | queries/s | index ms | documents |", "|" + "---|" * 13]
    done = [r for r in results if r.status == "completed"]
    lines += [f"| {i} | {r.model_name} | {r.ndcg:.4f} | {r.recall:.4f} | {r.mrr:.4f} | {r.precision:.4f} | {r.no_match_fp_rate:.4f} | {r.latency_p50_ms:.1f} | {r.latency_p95_ms:.1f} | {'-' if r.ram_peak_mb is None else f'{r.ram_peak_mb:.1f}'} | {r.queries_per_second:.1f} | {r.indexing_time_ms:.1f} | {r.document_count} |" for i, r in enumerate(done, 1)]
    lines += ["", f"Winner: {done[0].model_name}" if done else "No model completed."]
    failed = [r for r in results if r.status != "completed"]
    return "\n".join([*lines, *(["", "Failed:", *(f"- {r.model_name}: {r.error}" for r in failed)] if failed else [])]) + "\n"

"""Evaluation: the generated query set, retrieval metrics, latencies, and the ranking of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import compact, normalize_text, number_text
from quarry.operators.catalog import document_heads, with_candidates
from quarry.session import stored

DOCUMENTS = 70
LIMIT = 20


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def _given(prefix: str, v: Column) -> Column:
    return F.when(v != "", F.concat(F.lit(prefix), v))


def eligible(docs: DataFrame) -> DataFrame:
    """Documents with candidates and every trait. Candidates are nested, or only counted."""
    ok = (F.size("ld_candidates") if "ld_candidates" in docs.columns else F.col("n_candidates")) > 0
    for c in ("brand", "connection", "medium", "control"):
        ok = ok & (F.col(c) != "")
    return docs.where(ok & F.col("dn").isNotNull() & F.col("pn_bar").isNotNull())


def eval_rows(rows: DataFrame, *, documents: int = DOCUMENTS) -> DataFrame:
    """``eval_dataset`` of mapping rows: documents are chosen without their candidates, which only the chosen ones get."""
    chosen = stored(eligible(document_heads(rows, counted=True)).orderBy("steel_id").limit(documents))
    return eval_dataset(with_candidates(chosen, rows), documents=documents)


def eval_dataset(docs: DataFrame, *, documents: int = DOCUMENTS) -> DataFrame:
    """(query, category, expected_ld_articles): eight queries for each of the first documents by id."""
    chosen = eligible(docs).orderBy("steel_id").limit(documents)
    d = chosen.withColumn("i", F.row_number().over(Window.orderBy("steel_id")) - 1)  # the chosen few
    a, norm = F.col("article"), normalize_text("article")
    bare = F.coalesce(compact(norm), F.regexp_replace(a, r"(?U)\s+", ""))
    half = F.greatest(F.lit(1), F.floor(F.length(bare) / 2).cast("int"))
    rest = lambda n: F.substring(bare, n + 1, F.length(bare))
    split = F.concat_ws(" ", F.substring(bare, F.lit(1), half), rest(half))
    forms = F.array(F.lower(a), F.upper(a), F.coalesce(norm, F.lower(a)), bare, F.trim(F.regexp_replace(a, "[./_-]+", " ")), split)
    form = F.get(forms, (F.col("i") % 6).cast("int"))
    modified = F.when(bare == "", a).when(form == a, split).otherwise(form)
    n = F.least(F.length(bare), F.greatest(F.lit(3), F.floor(F.length(bare) / 2).cast("int")))
    prefix = F.substring(bare, F.lit(1), n)
    partial = F.when(F.col("i") % 2 == 0, prefix).otherwise(F.trim(F.concat_ws(" ", prefix, rest(n))))
    dn, pn = number_text("dn"), number_text("pn_bar")
    # The categories and the words of their queries.
    queries = [
        ("exact_article", a),
        ("modified_article", modified),
        ("partial_article", partial),
        ("full_name", F.col("name")),
        ("brand_dn_pn", _joined(F.col("brand"), _given("DN", dn), _given("PN", pn))),
        ("natural_language", _joined(F.lit("Нужен аналог"), F.col("name"), _given("для DN ", dn), _given("PN ", pn), F.col("connection"), F.col("medium"))),
        ("mixed", _joined(F.col("brand"), a, F.col("name"), _given("DN", dn), _given("PN", pn), F.col("connection"))),
        ("no_match", F.concat(F.lit("no_match_"), F.lpad(F.col("i").cast("string"), 4, "0"), F.lit("_zxqv"))),
    ]
    gold = F.array_sort(F.array_distinct(F.filter(F.transform("ld_candidates", lambda c: c.article_norm), lambda x: x != "")))
    records = [F.struct(q.alias("query"), F.lit(c).alias("category"), (F.array().cast("array<string>") if c == "no_match" else gold).alias("expected_ld_articles")) for c, q in queries]
    return d.select(F.explode(F.array(*records)).alias("r")).select("r.*")


def query_metrics(gold: DataFrame, results: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """A row for each query. gold: query_id, category, expected array; results: query_id, article, rank.

    Of an article that a list holds more than once the best rank counts.
    """
    asked = gold.select("query_id", "category", F.array_distinct("expected").alias("expected"))
    found = results.where(F.col("rank") <= limit).groupBy("query_id", "article").agg(F.min("rank").alias("rank"))
    hits = found.join(asked.select("query_id", F.explode("expected").alias("article")), ["query_id", "article"]).groupBy("query_id")
    hits = hits.agg(F.count("*").alias("hits"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"), F.min("rank").alias("first"))
    n = found.groupBy("query_id").agg(F.count("*").alias("results"))
    q = asked.join(hits, "query_id", "left").join(n, "query_id", "left")
    size = F.size("expected")
    ideal = F.array(*(F.lit(x) for x in _ideal(limit)))
    hit, any_gold = F.coalesce("hits", F.lit(0)), size > 0
    return q.select(
        "query_id",
        "category",
        any_gold.alias("has_gold"),
        F.when(any_gold, hit / size).alias("recall"),
        F.when(any_gold, hit / F.lit(float(limit))).alias("precision"),
        F.when(any_gold, F.coalesce("dcg", F.lit(0.0)) / F.get(ideal, F.least(size, F.lit(limit)) - 1)).alias("ndcg"),
        F.when(any_gold, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("rr"),
        (F.coalesce("results", F.lit(0)) > 0).alias("answered"),
    )


def _ideal(limit: int) -> list[float]:
    import math

    out, total = [], 0.0
    for i in range(limit):
        total += 1 / math.log2(i + 2)
        out.append(total)
    return out


def summary(per_query: DataFrame) -> DataFrame:
    """One row: means over queries with gold, and the share of the others that got an answer."""
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(name)
    none = ~F.col("has_gold")
    return per_query.agg(
        F.count("*").alias("query_count"),
        F.count_if("has_gold").alias("evaluated_retrieval_queries"),
        mean("recall", "recall"),
        mean("precision", "precision"),
        mean("ndcg", "ndcg"),
        mean("rr", "mrr"),
        F.round(F.coalesce(F.avg(F.when(none, F.col("answered").cast("double"))), F.lit(0.0)), 9).alias("no_match_fp_rate"),
    )


def category_recall(per_query: DataFrame) -> DataFrame:
    """(category, recall) without no_match."""
    return per_query.where("has_gold and category <> 'no_match'").groupBy("category").agg(F.round(F.avg("recall"), 9).alias("recall"))


def duplicates(results: DataFrame) -> DataFrame:
    """(query_id, article) pairs that a ranked list holds more than once: an integrity failure."""
    return results.groupBy("query_id", "article").agg(F.count("*").alias("n")).where("n > 1")


def latencies(df: DataFrame, value: Column, by: list[str], order: Column) -> DataFrame:
    """Cold (first) and warm (the others) latency, and nearest-rank percentiles of the warm ones."""
    first = df.groupBy(*by).agg(F.min_by(value, order).alias("cold"), F.min(order).alias("__first"))
    warm = df.join(first, by).where(order != F.col("__first"))
    rank = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY __v)").alias(name)
    w = warm.withColumn("__v", value).groupBy(*by).agg(F.count("*").alias("warm_queries"), F.round(F.avg("__v"), 6).alias("warm_mean"), rank(0.5, "p50"), rank(0.95, "p95"))
    return first.join(w, by, "left").select(*by, "cold", F.coalesce("warm_queries", F.lit(0)).alias("warm_queries"), "warm_mean", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"))


def leaderboard(models: DataFrame) -> DataFrame:
    """Models in order: completed before failed, then nDCG, recall, p95, memory (unknown last), points."""
    order = [F.col("status") != "completed", F.desc("ndcg"), F.desc("recall"), F.asc("latency_p95"), F.asc_nulls_last("ram_mb"), F.asc("points"), F.asc("model_name")]
    return models.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row for each model

"""Re-ranking: exactness, field scores, weighted source scores, and the ranking of nested candidates with evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import best_similarity, forms, normalize_alias, normalize_text, number_text
from quarry.operators.query_parse import PARSED
from quarry.operators.retrieval import max_normalised


@dataclass(frozen=True)
class Weights:
    hybrid: float = 0.55
    exactness: float = 0.25
    fields: float = 0.20
    source: float = 0.70
    candidate: float = 0.30
    higher_pn: float = 0.85


#: Columns of a hit besides query_id, the parsed query (q_...) and the document's.
EVIDENCE = 3
FIELDS = ("dn", "pn_bar", "connection", "medium", "control")


def query_columns(parsed: DataFrame) -> DataFrame:
    """The parsed queries with their columns named q_..., to stand beside a document's."""
    return parsed.select("query_id", *(F.col(c).alias(f"q_{c}") for c in PARSED))


def with_exactness(df: DataFrame) -> DataFrame:
    """df with text_exactness: the best similarity of the query's forms (text, compact, brand, article tokens) and the
    document's (article forms, name, brand); null if there is nothing to compare."""
    q = forms(F.concat(F.array("q_normalized", "q_compact", "q_brand"), F.col("q_possible_article_tokens")))
    s = forms(F.array("article", "article_norm", "article_compact", "name", "brand"))
    return df.withColumns({"__q": q, "__s": s}).withColumn("text_exactness", best_similarity(F.col("__q"), F.col("__s"))).drop("__q", "__s")


def mean_of_asked(checks: list[tuple[Column, Column]]) -> Column:
    """The mean score over the fields that the query asks for; null if it asks for none."""
    total = sum((F.when(asked.isNotNull(), F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0)) for asked, score in checks[1:]), F.when(checks[0][0].isNotNull(), F.coalesce(checks[0][1], F.lit(0.0))).otherwise(F.lit(0.0)))
    n = sum((asked.isNotNull().cast("int") for asked, _ in checks[1:]), checks[0][0].isNotNull().cast("int"))
    return F.when(n > 0, total / n)


def equal(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def source_field_score() -> Column:
    """Exact matches of brand, DN, PN, connection, medium and control. Stored fields are normalised already, brand excepted."""
    return mean_of_asked([(F.col(f"q_{f}"), equal(F.col(f"q_{f}"), normalize_alias("brand", "brand") if f == "brand" else F.col(f))) for f in ("brand", *FIELDS)])


def weighted(values: list[tuple[Column, float]]) -> Column:
    """The weighted mean of what isn't null; 0 if all is."""
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in values[1:]), F.coalesce(values[0][0] * values[0][1], F.lit(0.0)))
    weight = sum((F.when(v.isNull(), F.lit(0.0)).otherwise(F.lit(w)) for v, w in values[1:]), F.when(values[0][0].isNull(), F.lit(0.0)).otherwise(F.lit(values[0][1])))
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def rank_sources(hits: DataFrame, w: Weights = Weights(), *, unit_id: str = "doc_id") -> DataFrame:
    """Score and rank documents of each query. hits: query_id, q_..., doc_id, raw_score, and the document's columns.

    Of rows with the same steel_id the best counts, the first by hit id among equals.
    """
    df = hits.withColumn("hybrid_score", max_normalised(F.col("raw_score"), ["query_id"]))
    df = with_exactness(df).withColumn("source_field_score", source_field_score())
    df = df.withColumn("source_score", F.round(weighted([(F.col("hybrid_score"), w.hybrid), (F.col("text_exactness"), w.exactness), (F.col("source_field_score"), w.fields)]), 9))
    key = F.coalesce(F.nullif("steel_id", F.lit("")), F.nullif(F.col(unit_id).cast("string"), F.lit("")), F.col("article"))
    best = Window.partitionBy("query_id", "__key").orderBy(F.desc("source_score"), F.desc_nulls_last("raw_score"), F.col(unit_id))
    df = df.withColumn("__key", key).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__key")
    order = Window.partitionBy("query_id").orderBy(F.desc("source_score"), F.desc(F.coalesce("hybrid_score", F.lit(0.0))), F.desc(F.coalesce("text_exactness", F.lit(0.0))), F.coalesce(F.col(unit_id).cast("string"), F.lit("")))
    return df.withColumn("source_rank", F.row_number().over(order))




def candidate_field_score(w: Weights = Weights()) -> Column:
    """DN, PN (higher is nearly as good), connection, medium and control of a candidate."""
    pn = F.when(F.col("ld.pn_bar") == F.col("q_pn_bar"), F.lit(1.0)).when(F.col("ld.pn_bar") > F.col("q_pn_bar"), F.lit(w.higher_pn)).otherwise(F.lit(0.0))
    return mean_of_asked([(F.col(f"q_{f}"), pn if f == "pn_bar" else equal(F.col(f"q_{f}"), F.col(f"ld.{f}"))) for f in FIELDS])


# The words of the messages below, which answers show.
def _messages(found: dict[str, Column], *, higher_pn: bool) -> tuple[list[Column], list[Column]]:
    """(reasons, mismatches) for the asked fields."""
    g = number_text
    reasons, mismatches = [], []
    for f, label in (("dn", "DN"), ("pn_bar", "PN")):
        q, v = F.col(f"q_{f}"), found[f]
        same = F.when(v == q, F.concat(F.lit(f"Совпадает {label} "), g(q)))
        above = F.when(v > q, F.concat(F.lit(f"{label} "), g(v), F.lit(" выше запрошенного "), g(q)))
        high = higher_pn and f == "pn_bar"
        reasons.append(F.coalesce(same, above) if high else same)
        wrong = F.when(v.isNull(), F.concat(F.lit(f"{label}: ожидался "), g(q), F.lit(", но поле не указано"))).when((v < q) if high else (v != q), F.concat(F.lit(f"{label}: ожидался "), g(q), F.lit(", найден "), g(v)))
        mismatches.append(F.when(q.isNotNull(), wrong))
    for f, label, start, found_word, none in (
        ("connection", "присоединение", "Присоединение: ожидалось ", "найден", "не указано"),
        ("medium", "среда", "Среда: ожидалась ", "найден", "не указана"),
        ("control", "управление", "Управление: ожидалось ", "найдено", "не указано"),
    ):
        q, v = F.col(f"q_{f}"), found[f]
        reasons.append(F.when(v == q, F.concat(F.lit(f"Совпадает {label} "), q)))
        mismatches.append(F.when(q.isNotNull() & ~v.eqNullSafe(q), F.concat(F.lit(start), q, F.lit(f", {found_word} "), F.coalesce(v, F.lit(none)))))
    return reasons, mismatches


def _said(parts: list[Column]) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def source_messages() -> tuple[Column, Column]:
    """Reasons and mismatches of a ranked document."""
    e, article, name = F.col("text_exactness"), normalize_text("article"), normalize_text("name")
    brand = normalize_alias("brand", "brand")
    reasons, mismatches = _messages({f: F.col(f) for f in FIELDS}, higher_pn=False)
    text = (
        F.when((e >= 1.0) & article.isNotNull(), F.concat(F.lit("Найден товар с артикулом "), article))
        .when((e >= 0.85) & article.isNotNull(), F.concat(F.lit("Есть сильное текстовое совпадение с артикулом "), article))
        .when((e >= 0.75) & name.isNotNull(), F.concat(F.lit("Есть текстовое совпадение с наименованием "), name))
    )
    q = F.col("q_brand")
    reasons = [text, F.when(brand == q, F.concat(F.lit("Совпадает бренд "), q)), *reasons]
    mismatches = [F.when(q.isNotNull() & ~brand.eqNullSafe(q), F.concat(F.lit("Бренд: ожидался "), q, F.lit(", найден "), F.coalesce(brand, F.lit("не указан")))), *mismatches]
    said = _said(mismatches)
    part = F.when((F.col("source_field_score") < 1.0) & (F.size(said) == 0), F.array(F.lit("Часть структурных полей не совпадает")))
    return _said(reasons), F.coalesce(part, said)


def candidate_messages() -> tuple[Column, Column]:
    """Reasons and mismatches of a candidate: what a search returns."""
    reasons, mismatches = _messages({f: F.col(f"ld.{f}") for f in FIELDS}, higher_pn=True)
    said = _said(reasons)
    article = F.coalesce(normalize_text("ld.article"), normalize_text("ld.article_norm"))
    only = F.when(F.col("ld_field_score").isNull() & (F.size(said) == 0) & article.isNotNull(), F.array(F.concat(F.lit("LD-кандидат "), article)))
    return F.coalesce(only, said), _said(mismatches)


def expand_candidates(sources: DataFrame, w: Weights = Weights()) -> DataFrame:
    """A row for each candidate of each ranked document: ld_key, ld_field_score, final_score."""
    df = sources.select("*", F.posexplode("ld_candidates").alias("cand_pos", "ld")).drop("ld_candidates")
    df = df.withColumn("ld_field_score", candidate_field_score(w))
    final = F.when(F.col("ld_field_score").isNull(), F.col("source_score")).otherwise(F.col("source_score") * w.source + F.col("ld_field_score") * w.candidate)
    key = F.coalesce(F.nullif("ld.article_norm", F.lit("")), F.nullif("ld.article", F.lit("")))
    return df.withColumns({"ld_key": key, "final_score": F.round(final, 9)}).where("ld_key is not null")


def evidence(expanded: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(query_id, ld_key, source_evidence): the best ranked of each supporting article, in order of rank."""
    key = F.coalesce(F.nullif("article", F.lit("")), F.nullif("name", F.lit("")), F.col("source_rank").cast("string"))
    one = expanded.select("query_id", "ld_key", "article", "name", "source_score", "source_rank", key.alias("ev"))
    first = Window.partitionBy("query_id", "ld_key", "ev").orderBy(F.desc("source_score"), "source_rank")
    one = one.withColumn("r", F.row_number().over(first)).where("r = 1")
    few = one.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "ld_key").orderBy("source_rank"))).where(F.col("r") <= most)
    entry = F.struct("source_rank", F.col("article").alias("source_article"), F.col("name").alias("source_name"), "source_score")
    return few.groupBy("query_id", "ld_key").agg(F.array_sort(F.collect_list(entry)).alias("source_evidence"))


def rank_candidates(sources: DataFrame, w: Weights = Weights(), *, limit: int | None = None) -> DataFrame:
    """The answer: candidates of each query, each once with its best score, ranked, with evidence and explanations."""
    expanded = expand_candidates(sources, w)
    best = Window.partitionBy("query_id", "ld_key").orderBy(F.desc("final_score"), "source_rank", "cand_pos")
    df = expanded.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("source_score"), "ld_key")
    df = df.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        df = df.where(F.col("rank") <= max(0, limit))
    reasons, mismatches = candidate_messages()
    parts = F.map_from_entries(
        _said([
            F.struct(F.lit("hybrid_score").alias("k"), F.coalesce("hybrid_score", F.lit(0.0)).alias("v")),
            *(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))) for c in ("text_exactness", "source_field_score", "source_score", "ld_field_score", "final_score")),
        ])
    )
    df = df.withColumns({"relevance_rating": F.round(F.col("final_score") * 100, 1), "match_reasons": reasons, "mismatches": mismatches, "score_breakdown": parts})
    ev = evidence(expanded)
    out = df.join(ev, ["query_id", "ld_key"])
    return out.select("query_id", "rank", "relevance_rating", F.col("ld_key").alias("id"), F.col("final_score").alias("score"), F.coalesce("hybrid_score", F.lit(0.0)).alias("hybrid_score"), F.col("ld").alias("product"), "source_evidence", "match_reasons", "mismatches", "score_breakdown")

"""The SQL functions give what the column expressions give, and bring no Python into a plan."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import sql_functions
from quarry.functions import text as T
from quarry.functions.vocabulary import DIMENSIONS
from quarry.operators import retrieval

TEXTS = [None, "", "  ", "Ёлка\t\nß ς\xa0x", "КШ.П.П.015.40-01", "A\\b/c_d-e", "DN 80,5 mm", "1.6 МПа", "16 mpa", "-3,25 см", "12 cm", "2 м", "2 m", "7 mm", "7 мм", "300", "x1e5", "temper КРАН", "Фланцевое", "flanged welded", "вода и газ", "gear", "a\x1cb\x1fc", "scm 5"]


@pytest.fixture(scope="module")
def texts(spark):
    assert "quarry_normalize_text" in sql_functions.register(spark) == sql_functions.register(spark)
    return spark.createDataFrame([(t,) for t in TEXTS], "x string")


def same(df, name, column):
    rows = df.select("x", F.expr(f"quarry_{name}(x)").alias("a"), column.alias("b")).collect()
    assert [(r.x, r.a) for r in rows] == [(r.x, r.b) for r in rows], name


def test_normalisers(texts):
    norm = T.normalize_text("x")
    same(texts, "normalize_text", norm)
    same(texts, "compact", T.compact(norm))
    same(texts, "tokens", T.tokens(norm))
    same(texts, "dn", T.normalize_dn("x"))
    same(texts, "pn_bar", T.normalize_pn_bar("x"))
    same(texts, "length_mm", T.normalize_length("x"))
    for d in DIMENSIONS:
        same(texts, d, T.normalize_alias("x", d))


def test_numbers_and_scores(spark, texts):
    v = spark.createDataFrame([(x,) for x in (None, 0.0, 80.0, 1.6, -2.5, 1e6, 1234567.0, 0.00001, 100000.0, 1 / 3)], "x double")
    same(v, "number_text", T.number_text("x"))
    a, b = "array(1.0D, 2.0D)", "array(3.0D, -1.0D)"
    r = spark.sql(f"SELECT quarry_rrf(2, 60) AS r, quarry_cosine({a}, {b}) AS c, quarry_cosine({a}, array(0D, 0D)) AS z, quarry_bm25(2, 10, 3, 100, 8.0D) AS s").first()
    want = spark.range(1).select(retrieval.cosine(F.expr(a), F.expr(b)).alias("c")).first()
    assert r.r == 1 / 62 and r.c == want.c and r.z == 0
    m = spark.createDataFrame([(0, 1, 2, 10, 3)], "query_id long, doc_id long, tf long, dl long, df long")
    assert retrieval.bm25_scores(m, spark.createDataFrame([(100, 8.0)], "n long, avgdl double")).first().score == pytest.approx(r.s, abs=1e-12)


def test_no_python(texts):
    plan = texts.selectExpr("quarry_brand(x)", "quarry_length_mm(x)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_norm_sql_normalises_distinct_texts(spark, sf):
    """The functions stand above the exchange of the texts, and the statement's own DISTINCT adds none."""
    from quarry import queries

    plan = queries.norm_sql(spark, sf)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(" in line and "steel_article" in line]
    assert len(at) == 1 and any("regexp_replace" in line for line in lines[: at[0]]) and not any("regexp_replace" in line for line in lines[at[0] :])

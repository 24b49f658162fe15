"""Fill-in-the-middle against a literal reading, on hostile texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm.fill_middle import DELIMITER, ESCAPE, escaped, fill_in_middle, restored, unescaped

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def literal(doc_id, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return len(u), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


HOSTILE = ["", " ", "a", "<P>", "x <S> y", "<", "<P", "<<P", "P><S", "a\x1e\x1fb", "\x1e", "\x1f", "\x1f0\x1f1\x1e", "\x1f" * 7, "0\x1e1", "\r\n\t\x00", "é漢😀éZz", "$0 \\ $1", "𝐀a𝐁", "word " * 3000, "a" * 200_000, "\x1e" * 3000, "<" * 50, "<S<M<P"]


def check(rows, spark):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_in_middle(df, keep=("doc_id", "text")).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.prefix, r.middle, r.output) == literal(r.doc_id, r.text), (r.doc_id, r.text)
        assert r.back == (r.text or "")
    return out


def test_against_a_literal_reading(spark):
    rows = [(i * 100 + k, t) for i in range(12) for k, t in enumerate(HOSTILE)] + [(None, None), (None, "no id"), (-7, "twice"), (-7, "twice"), (2**62, "big id"), (5, None)]
    out = check(rows, spark)
    assert {r.form for r in out} == {"plain", "spm", "psm"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aZ<>PSM \n\x1e\x1f01é😀", max_size=40), min_size=30, max_size=60))
def test_any_text(spark, texts):
    check(list(enumerate(texts)), spark)


def test_escapes(spark):
    df = spark.createDataFrame([(t,) for t in HOSTILE], "t string")
    for r in df.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("b")).collect():
        assert r.b == r.t and DELIMITER not in r.e and len(r.e) == len(r.t) + r.t.count(DELIMITER) + r.t.count(ESCAPE)


def test_edges(edge, none):
    assert fill_in_middle(none).collect() == []
    d = edge.withColumn("form", F.lit("x")).withColumn("body", F.lit("y"))
    out = fill_in_middle(d, keep=tuple(d.columns))
    assert "form_" in out.columns and len(set(out.columns)) == len(out.columns) and out.count() == edge.count()
    assert all(r.form_ == "x" and r.body == "y" for r in out.collect())


def test_shares(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'some text to cut' AS text")
    n = {r.form: r["count"] for r in fill_in_middle(df).groupBy("form").count().collect()}
    assert n["plain"] == pytest.approx(400, abs=80) and n["spm"] == pytest.approx(720, abs=110)
    assert fill_in_middle(df, transformed=0).where("form <> 'plain'").count() == 0


def test_plan_has_one_pass(spark):
    df = spark.range(10).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    plan = fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_replace(") == 1

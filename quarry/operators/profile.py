"""The profile of mapping rows: counts, nulls, distributions and conflicting articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.mapping import require_columns

CONFLICTS, EXAMPLES = 20, 5


def counts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, rows beyond the first of equal ones, distinct articles (nulls dropped) and pairs (nulls kept)."""
    simple = df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.countDistinct("steel_article").alias("unique_steel_articles"),
        F.countDistinct("ld_article").alias("unique_ld_articles"),
    )
    pairs = df.groupBy("steel_article", "ld_article").agg(F.lit(1).alias("one")).agg(F.count("*").alias("unique_steel_ld_pairs"))
    # rows travel as 128 bits; a hash skips nulls, so each column says whether it is there
    parts = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    whole = df.select(F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit("row"), *parts).alias("r2")).groupBy("r1", "r2").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("full_duplicates"))
    one = F.lit(1)  # single rows side by side
    return simple.withColumn("k", one).join(pairs.withColumn("k", one), "k").join(whole.withColumn("k", one), "k").drop("k").select("rows", "columns", "full_duplicates", "unique_steel_articles", "unique_ld_articles", "unique_steel_ld_pairs")


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for every column; NaN counts as null."""
    kinds = dict(df.dtypes)
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
    one = df.agg(*(F.count_if(missing(c)).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns))).alias("x")).select("x.*")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): how often each value occurs; null is 'null'."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def conflict_count(df: DataFrame) -> DataFrame:
    """One row: articles (null is one) with more than one distinct non-null candidate article."""
    return df.groupBy("steel_article").agg(F.countDistinct("ld_article").alias("n")).agg(F.count_if(F.col("n") > 1).alias("conflicting_steel_articles"))


def _first_values(df: DataFrame, value: str, examples: int) -> DataFrame:
    """(steel_article, value array): the smallest distinct values of each article."""
    once = df.where(F.col(value).isNotNull()).groupBy("steel_article", value).agg(F.lit(1).alias("one"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("steel_article").orderBy(value))).where(F.col("r") <= examples)
    return ranked.groupBy("steel_article").agg(F.array_sort(F.collect_list(value)).alias(value))


def conflicts(df: DataFrame, *, limit: int = CONFLICTS, examples: int = EXAMPLES) -> DataFrame:
    """The first conflicting articles in key order, null last: row count, distinct candidates, and some of them.

    Examples are the smallest values, so they don't depend on row order.
    """
    grouped = df.groupBy("steel_article").agg(F.count("*").alias("row_count"), F.countDistinct("ld_article").alias("distinct_ld_articles"))
    top = grouped.where("distinct_ld_articles > 1").orderBy(F.col("steel_article").asc_nulls_last()).limit(limit)
    rows = df.join(F.broadcast(top.select(F.col("steel_article").alias("k"))), F.col("steel_article").eqNullSafe(F.col("k")), "left_semi").select("steel_article", "ld_article", "ld_name")
    out = top
    for value in ("ld_article", "ld_name"):
        v = _first_values(rows, value, examples).withColumnRenamed("steel_article", f"k_{value}")
        out = out.join(v, out["steel_article"].eqNullSafe(v[f"k_{value}"]), "left")
    empty = F.array().cast("array<string>")
    return out.select("steel_article", "row_count", "distinct_ld_articles", F.coalesce("ld_article", empty).alias("ld_articles"), F.coalesce("ld_name", empty).alias("ld_names"))


def profile(df: DataFrame, source_path: str = "") -> dict:
    """The whole profile as a report record."""
    require_columns(df.columns)
    maps: dict[str, dict[str, int]] = {"match_score": {}, "match_max": {}}
    for r in sorted(distribution(df, list(maps)).collect(), key=lambda r: (r.value == "null", float(r.value) if r.value != "null" else 0)):
        maps[r.column_name][r.value] = r.n
    return {
        "source_path": source_path,
        **counts(df).first().asDict(),
        "null_counts": {r.column_name: r.nulls for r in null_counts(df).collect()},
        "match_score_distribution": maps["match_score"],
        "match_max_distribution": maps["match_max"],
        "conflicting_steel_articles_count": conflict_count(df).first()[0],
        "conflicting_steel_articles_examples": [r.asDict() for r in conflicts(df).orderBy(F.col("steel_article").asc_nulls_last()).collect()],
    }

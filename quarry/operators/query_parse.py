"""Queries: from a string to search-ready features, for a whole DataFrame of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import blank_to_null, compact, distinct_parts, fold_texts, from_alias, labelled, normalize_text, number_text, title_brand
from quarry.functions.vocabulary import DIMENSIONS

# The patterns that find a diameter and a pressure.
DN = r"(?iu)(?U)\b(?:dn|ду|диаметр)\s*([0-9]+(?:[.,][0-9]+)?)"
PN = r"(?iu)(?U)\b(?:pn|ru|ру|mpa|бар)\s*([0-9]+(?:[.,][0-9]+)?)"
PARSED = ("raw", "normalized", "compact", "semantic_text", "lexical_text", "possible_article_tokens", "brand", "dn", "pn_bar", "connection", "medium", "control")


def _number(text: Column, pattern: str) -> Column:
    return blank_to_null(F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("."))).cast("double")


def _trait(words: Column, dimension: str) -> Column:
    """The value of the first plain word that the dictionary knows."""
    values = F.transform(words, lambda w: title_brand(from_alias(w, dimension)) if dimension == "brand" else from_alias(w, dimension))
    return F.get(F.filter(values, lambda v: v.isin(*sorted(set(DIMENSIONS[dimension].values())))), F.lit(0))


def article_words(raw: Column) -> Column:
    """Words shaped like articles: a separator, or five characters with a digit."""
    return F.filter(F.split(raw, r"(?U)[\s\x1c-\x1f]+"), lambda w: (w != "") & (w.rlike("[./_-]") | ((F.length(w) >= 5) & w.rlike(r"(?U)\d"))))


def article_tokens(words: Column, folded: Column) -> Column:
    """Such words as written, normalised, and compact; folded has the same words with their compatibility characters and case folded."""
    forms = F.flatten(F.zip_with(words, folded, lambda w, f: F.array(w, normalize_text(f), compact(normalize_text(f)))))
    return distinct_parts(forms)


def parse_queries(df: DataFrame, query: str = "query") -> DataFrame:
    """df with the parsed form of each query; null queries count as empty."""
    raw = F.coalesce(F.col(query), F.lit(""))
    df = df.withColumn("raw", raw).withColumn("__shaped", article_words(F.col("raw")))
    df = df.withColumn("__folded", fold_texts(F.concat(F.array("raw"), F.col("__shaped"))))
    df = df.withColumn("normalized", F.coalesce(normalize_text(F.get("__folded", F.lit(0))), F.lit("")))
    n = F.col("normalized")
    words = F.filter(F.split(n, " "), lambda w: (w != "") & ~w.rlike(r"(?U)[\d./_-]"))
    df = df.withColumns({"__words": words, "possible_article_tokens": article_tokens(F.col("__shaped"), F.slice("__folded", 2, 2**30)), "dn": _number(n, DN), "pn_bar": _number(n, PN)})
    df = df.withColumns({d: _trait(F.col("__words"), d) for d in DIMENSIONS}).drop("__words", "__shaped", "__folded")
    dn, pn = number_text("dn"), number_text("pn_bar")
    main = blank_to_null(F.concat_ws(" ", title_brand(F.col("brand")), F.get("possible_article_tokens", F.lit(0))))
    main = F.coalesce(main, blank_to_null(F.trim("raw")), n)
    tail = distinct_parts([labelled("DN ", dn), labelled("PN ", pn), labelled("Соединение: ", F.col("connection")), labelled("Среда: ", F.col("medium")), labelled("Управление: ", F.col("control"))])
    lexical = distinct_parts(
        F.concat(
            F.array(n),
            F.col("possible_article_tokens"),
            F.array("brand"),
            F.array(*(labelled(p, dn) for p in ("dn", "dn ", "ду", "ду "))),
            F.array(*(labelled(p, pn) for p in ("pn", "pn ", "ру", "ру ")), labelled("", pn, " бар")),
            F.array("connection", "medium", "control"),
        )
    )
    return df.withColumns({"compact": F.replace(n, F.lit(" "), F.lit("")), "semantic_text": F.array_join(F.concat(F.array(main), tail), ", "), "lexical_text": F.array_join(lexical, " ")})

"""Source documents: mapping rows grouped by their normalised key, with canonical values and nested candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import PLAIN, coded_texts, distinct_parts, from_alias, labelled, normalised, number_text, typed_texts
from quarry.operators.retrieval import small
from quarry.session import stored_by

KEY = ("article_compact", "name_norm", "dn", "pn_bar", "connection", "control")
CANDIDATE = "struct<article_norm:string,article:string,name:string,url:string,dn:double,pn_bar:double,connection:string,medium:string,control:string,temperature:string,length_mm:double,price:double>"


#: The group of a row: 128 bits of its key. Groups travel and are compared by these, not by the key's texts.
GROUP = ("k1", "k2")
#: In how many parts a group's candidates are dealt, and by what stored rows are dealt.
CANDIDATE_PARTS = 16
DEAL = (*GROUP, "part")


#: What the texts of a mapping row become: column -> (text, kind).
TYPED = {
    "article_compact": ("steel_article", "compact"),
    "name_norm": ("steel_name", "text"),
    "dn": ("steel_dn", "number"),
    "pn_bar": ("steel_pn_bar", "pn"),
    **{d: (f"steel_{d}", d) for d in ("connection", "medium", "control")},
    "temperature": ("steel_temp", "text"),
    "length_mm": ("steel_length", "length"),
    "ld_article_norm": ("ld_article", "text"),
    "typed_dn": ("ld_dn", "number"),
    "typed_pn_bar": ("ld_pn_mpa", "pn"),
    **{f"typed_{d}": (f"ld_{d}", d) for d in ("connection", "medium", "control")},
    "typed_temperature": ("ld_temp", "text"),
    "typed_length_mm": ("ld_length", "length"),
}
#: Columns of a stored row that are a mapping row's own, and of a candidate.
RAW = {"article": "steel_article", "name": "steel_name", "url": "steel_url", "ld_article": "ld_article", "ld_name": "ld_name", "ld_url": "ld_url", "ld_price": "price"}
#: The texts that a group's key follows from, and the other fields of a document: (column of a mapping row, kind of its text, if it has one).
SPELLING = {k: TYPED[k] for k in KEY}
SPELLED = tuple(c for c, _ in SPELLING.values())
#: 128 bits of those texts.
RAW_GROUP = ("g1", "g2")
VALUES = {"c_url": ("steel_url", None), "c_medium": TYPED["medium"], "c_temperature": TYPED["temperature"], "c_length": TYPED["length_mm"]}
#: In how many parts a spelling's rows are dealt, whatever their number.
PARTS = 8
CANDIDATE_FIELDS = ("article", "name", "url", "dn", "pn_bar", "connection", "medium", "control", "temperature", "length_mm", "price")


def _hashes(columns: list[str], first: str, second: str) -> list[Column]:
    """128 bits of these columns. Null and empty are apart; a hash of columns skips nulls, so each says whether it is there."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias(first), F.xxhash64(F.lit("group"), *parts).alias(second)]


def source_rows(rows: DataFrame) -> DataFrame:
    """One typed, normalised row for each distinct mapping row, with its group and how many ``copies`` it has, stored: the plans of a catalogue read it.

    Rows travel once, dealt by group and part, of which a candidate is in one, so a group of any size is many tasks. There equal ones (by 128 bits of the
    whole row) are combined, and they are stored as they lie, so that the values of a candidate, or of a part, are counted without another exchange.
    """
    marked = rows.select(*rows.columns, F.col("price_ld").cast("double").alias("price"), *_hashes(rows.columns, "r1", "r2"))
    typed = normalised(marked, TYPED, [*RAW.values(), "r1", "r2"])
    c = F.col
    typed = typed.withColumns({k: F.coalesce(k, F.lit("")) for k in ("article_compact", "name_norm", "ld_article_norm")})
    own = ("dn", "pn_bar", "connection", "medium", "control", "temperature", "length_mm")
    kept = [*(c(f"{old}").alias(new) for new, old in RAW.items()), *own, "ld_article_norm", *(c(f"typed_{k}").alias(f"ld_{k}") for k in own), "r1", "r2"]
    typed = typed.select(*kept, *_hashes(list(KEY), *GROUP), F.pmod(F.xxhash64("ld_article_norm"), F.lit(CANDIDATE_PARTS)).cast("int").alias("part"))
    dealt = typed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DEAL)
    return stored_by(dealt.groupBy(*dealt.columns).agg(F.count("*").alias("copies")).drop("r1", "r2"), *DEAL)


def python_text(v: Column, numeric: bool) -> Column:
    """How str() writes a value; numbers of everyday size."""
    return F.when(v == F.floor(v), F.concat(F.floor(v).cast("string"), F.lit(".0"))).otherwise(v.cast("string")) if numeric else v


def canonical(df: DataFrame, by: list[str], value: str, *, numeric: bool = False) -> DataFrame:
    """(by..., value): the most frequent non-null value, ties to the smallest text; null where there is none.

    Two aggregations with map-side combine: a group of any size is a few counts.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(_pick(F.col(value), F.col("__n"), numeric).alias(value))


def _pick(v: Column, n: Column, numeric: bool) -> Column:
    return F.min_by(v, F.when(v.isNotNull(), F.struct(-n, python_text(v, numeric))))


def _counts(df: DataFrame, by: list[str], fields: dict[str, tuple[Column, bool]]) -> DataFrame:
    """(by..., f, v, d, n): how often a group has each non-null value (v as text, d as number) of the field numbered f.

    A last field is in every row, so that groups whose fields are all null are there.
    """
    none = F.lit(None).cast("double")
    entries = [F.struct(F.lit(i).alias("f"), python_text(c, numeric).cast("string").alias("v"), (c if numeric else none).cast("double").alias("d")) for i, (c, numeric) in enumerate([*fields.values(), (F.lit(""), False)])]
    long = df.select(*by, F.explode(F.array(*entries)).alias("e")).where("e.v is not null").select(*by, "e.*")
    return long.groupBy(*by, "f", "v", "d").agg(F.count("*").alias("n"))


def _picks(fields: dict[str, tuple[Column, bool]]) -> list[Column]:
    """The most frequent value of each field, from counts."""
    return [F.min_by("d" if numeric else "v", F.when(F.col("f") == i, F.struct(-F.col("n"), "v"))).alias(name) for i, (name, (_, numeric)) in enumerate(fields.items())]


def ld_candidates(src: DataFrame, *also: str) -> DataFrame:
    """(group, also..., ld_article_norm, canonical fields): the candidates of each document; those without an article are left out. also: what is the same in all of a group."""
    by = [*DEAL, *also, "ld_article_norm"]
    numbers = {"dn", "pn_bar", "length_mm", "price"}
    fields = {f"ld_{n}": (F.col(f"ld_{n}"), n in numbers) for n in CANDIDATE_FIELDS}
    return _counts(src.where(F.col("ld_article_norm") != ""), by, fields).groupBy(*by).agg(*_picks(fields)).drop("part")


def candidates(rows: DataFrame, *, ids: bool = True) -> DataFrame:
    """(group, steel_id, ld_article_norm, canonical fields): the candidates of all documents, straight from the mapping rows. Without ``ids`` no steel_id.

    A document's id follows from its key, so its candidates need nothing else of it. Rows travel once, dealt by group and part, with what a candidate is made of and
    128 bits of the whole row, by which copies go. Where they then lie, a candidate of one row is that row; values are counted for the others alone.
    """
    typed = {k: v for k, v in TYPED.items() if k in KEY or k.startswith("typed_") or k == "ld_article_norm"}
    raw = {new: old for new, old in RAW.items() if new.startswith("ld_")}
    marked = rows.select(*rows.columns, F.col("price_ld").cast("double").alias("price"), *_hashes(rows.columns, "r1", "r2"))
    t = normalised(marked, typed, [*raw.values(), "r1", "r2"]).withColumns({k: F.coalesce(k, F.lit("")) for k in ("article_compact", "name_norm")})
    t = t.where(F.col("ld_article_norm") != "")
    own = [*(F.col(old) if old == new else F.col(old).alias(new) for new, old in raw.items()), *(F.col(k).alias(f"ld_{k.removeprefix('typed_')}") for k in typed if k.startswith("typed_"))]
    part = F.pmod(F.xxhash64("ld_article_norm"), F.lit(CANDIDATE_PARTS)).cast("int").alias("part")
    also = [F.unhex(steel_id(*map(F.col, KEY))).alias("id")] if ids else []
    t = t.select(*_hashes(list(KEY), *GROUP), part, *also, "ld_article_norm", *own, "r1", "r2")
    dealt = t.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DEAL)
    counted = dealt.withColumn("n_rows", F.count("*").over(Window.partitionBy(*DEAL, "ld_article_norm")))
    several = ld_candidates(counted.where("n_rows > 1").drop("n_rows").distinct(), *(["id"] if ids else []))  # the same exchange, read again
    single = counted.where("n_rows = 1 AND r1 IS NOT NULL AND r2 IS NOT NULL")  # always true: with other columns it would be another exchange
    both = single.select(several.columns).unionAll(several)
    return both.withColumn("steel_id", F.lower(F.hex("id"))).drop("id") if ids else both


# The labels of the two search texts below, which encoders and terms see.
def semantic_text(c: dict[str, Column]) -> Column:
    n = number_text
    return F.array_join(
        distinct_parts([
            labelled("Название: ", c["name"]),
            labelled("Бренд: ", c["brand"]),
            labelled("Тип товара: ", c["name"]),
            labelled("Диаметр DN ", n(c["dn"])),
            labelled("Давление PN ", n(c["pn_bar"]), " бар"),
            labelled("Соединение: ", c["connection"]),
            labelled("Рабочая среда: ", c["medium"]),
            labelled("Управление: ", c["control"]),
            labelled("Температура: ", c["temperature"]),
            labelled("Длина: ", n(c["length_mm"]), " мм"),
            labelled("Артикул: ", c["article"]),
        ]),
        "\n",
    )


def lexical_text(c: dict[str, Column]) -> Column:
    dn, pn = number_text(c["dn"]), number_text(c["pn_bar"])
    parts = F.concat(
        F.array(c["name"]),
        c["name_variants"],
        F.array(c["brand"], c["article"], c["article_norm"], c["article_compact"]),
        F.array(*(labelled(p, dn) for p in ("DN", "DN ", "Ду", "Ду "))),
        F.array(*(labelled(p, pn) for p in ("PN", "PN ", "Ру", "Ру ")), labelled("", pn, " бар")),
        F.array(c["connection"], c["medium"], c["control"]),
    )
    return F.array_join(distinct_parts(parts), "\n")


def steel_id(article_compact: Column, name_norm: Column, dn: Column, pn: Column, connection: Column, control: Column) -> Column:
    """sha1 of the key's texts, without separators (groups that collide are found by the index build)."""
    return F.sha1(F.concat_ws("", article_compact, name_norm, number_text(dn), number_text(pn), connection, control))


def source_documents(rows: DataFrame) -> DataFrame:
    """One row for each document: canonical fields, texts, name variants and candidates sorted by article.

    The document's article forms come from its most frequent spelling, so the result doesn't depend on row order.
    """
    return documents_of(source_rows(rows))


def raw_group() -> list[Column]:
    """Which spelling of a group a mapping row has."""
    return _hashes(list(SPELLED), *RAW_GROUP)


def document_heads(rows: DataFrame, *, counted: bool = False, tallied: bool = False) -> DataFrame:
    """The documents without their candidates, but with their group and the ``spellings`` of its key, with ``n_candidates`` if they are ``counted``, and with
    ``n_rows`` different mapping rows and ``n_copies`` rows in all if they are ``tallied``.

    Rows travel once, dealt by spelling and part, with the columns that a document is made of and 128 bits of the whole row, by which copies go. A part's values
    are counted as they are written and travel as one row; only these are normalised. So a group of any size is PARTS tasks and then a few counts.
    """
    return _documents(_heads(rows, counted), *GROUP, "spellings", *(["n_candidates"] if counted else []), *(["n_rows", "n_copies"] if tallied else []))


def _heads(rows: DataFrame, counted: bool) -> DataFrame:
    fields = VALUES | ({"candidate": TYPED["ld_article_norm"]} if counted else {})
    columns = [c for c, _ in fields.values()]
    marked = rows.select(*raw_group(), *SPELLED, *columns, *_hashes(rows.columns, "r1", "r2")).withColumn("part", F.pmod("r1", F.lit(PARTS)).cast("int"))
    deal = (*RAW_GROUP, "part")
    distinct = marked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *deal).groupBy(*marked.columns).agg(F.count("*").alias("copies"))
    # the last entry stands for the row itself
    spelled = F.struct(*SPELLED)
    entries = [F.struct(F.lit(i).alias("f"), F.col(c).alias("v"), F.lit(None).cast(distinct.select(spelled).schema[0].dataType).alias("k")) for i, c in enumerate(columns)]
    entries.append(F.struct(F.lit(len(columns)).alias("f"), F.lit("").alias("v"), spelled.alias("k")))
    long = distinct.select(*deal, "copies", F.explode(F.array(*entries)).alias("e")).where("e.v is not null").select(*deal, "copies", "e.*")
    counts = long.groupBy(*deal, "f", "v", "k").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    own = F.col("f") < len(columns)
    parts = counts.groupBy(*deal).agg(F.collect_list(F.when(own, F.struct("f", "v", "n"))).alias("es"), F.first("k", True).alias("k"), *(F.max(F.when(~own, F.col(c))).alias(name) for c, name in (("n", "n_rows"), ("copies", "n_copies"))))
    typed = _typed_parts(parts.select(*RAW_GROUP, "n_rows", "n_copies", "k.*", "es"), [kind for _, kind in fields.values()])
    typed = typed.withColumns({k: F.coalesce(k, F.lit("")) for k in ("article_compact", "name_norm")})
    key = F.struct("dn", "pn_bar", "connection", "control", *RAW_GROUP)
    grouped = typed.select(*_hashes(list(KEY), *GROUP), key.alias("key"), "n_rows", "n_copies", "steel_article", "steel_name", "es").repartition(*GROUP)
    # the row's own texts are as frequent as its rows; an entry that is never picked has the key and the rows, and keeps groups that have no other; another one the copies
    names = [*fields, "c_article", "c_name"]
    none = F.lit(None).cast(grouped.schema["key"].dataType)
    entry = lambda f, v, d, n, k: F.struct(f.alias("f"), v.alias("v"), d.alias("d"), n.cast("long").alias("n"), k.alias("key"))
    own_text = lambda name, c: entry(F.lit(names.index(name)), F.col(c), F.lit(None).cast("double"), F.col("n_rows"), none)
    whole = [own_text("c_article", "steel_article"), own_text("c_name", "steel_name"), *(entry(F.lit(len(names) + i), F.lit(""), F.lit(None).cast("double"), F.col(n), F.col("key")) for i, n in enumerate(("n_rows", "n_copies")))]
    each = grouped.select(*GROUP, F.explode(F.concat(F.transform("es", lambda e: entry(e.f, e.v, e.d, e.n, none)), F.array(*whole))).alias("e")).select(*GROUP, "e.*")
    each = each.withColumn("v", F.when(F.col("f") == names.index("c_length"), python_text(F.col("d"), True)).otherwise(F.col("v"))).where("v is not null")
    summed = each.groupBy(*GROUP, "f", "v", "d", "key").agg(F.sum("n").alias("n"))
    best = lambda i, x: F.min_by(x, F.when(F.col("f") == i, F.struct(-F.col("n"), "v"))).alias(names[i])
    picked = [best(i, "d" if name == "c_length" else "v") for i, name in enumerate(names) if name != "candidate"]
    if counted:
        picked.append(F.count_if((F.col("f") == names.index("candidate")) & (F.col("v") != "")).cast("int").alias("n_candidates"))
    picked.extend(F.sum(F.when(F.col("f") == len(names) + i, F.col("n"))).alias(n) for i, n in enumerate(("n_rows", "n_copies")))
    variant = (F.col("f") == names.index("c_name")) & (F.col("v") != "")
    picked.append(F.array_sort(F.collect_set(F.when(variant, F.col("v")))).alias("variants"))
    spelling = F.when(F.col("key").isNotNull(), F.struct("key.g1", "key.g2"))
    head = summed.groupBy(*GROUP).agg(*picked, F.collect_set(spelling).alias("spellings"), F.first("key", True).alias("key"))
    return head.select(*(c for c in head.columns if c != "key"), "key.dn", "key.pn_bar", "key.connection", "key.control")


def _typed_parts(parts: DataFrame, kinds: list[str | None]) -> DataFrame:
    """Parts of spellings with what their key's texts become, and with the values of their entries (f, v, n) normalised by the kind of the field f."""
    kept = [c for c in parts.columns if c != "es" and c not in SPELLED] + ["steel_article", "steel_name"]
    types = dict(parts.dtypes)
    key = ", ".join(f"{k} {'double' if PLAIN[kind][0] == pa.float64() else 'string'}" for k, (_, kind) in SPELLING.items())
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + f", {key}, es array<struct<f: int, v: string, d: double, n: bigint>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = dict(zip(b.schema.names, b.columns))
            f, v, n = c["es"].flatten().flatten()
            coded, d, out = coded_texts(v), pa.nulls(len(v), pa.float64()), v
            for i, kind in enumerate(kinds):
                if kind is not None:
                    own, new = pc.equal(f, i), typed_texts(coded, kind)
                    if new.type == d.type:
                        d = pc.if_else(own, new, d)
                    else:
                        out = pc.if_else(own, new.cast(v.type), out)
            ends = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.list_value_length(c["es"]).cast(pa.int64()))]).cast(pa.int32())
            es = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([f, out, d, n], ["f", "v", "d", "n"]))
            keys = [typed_texts(coded_texts(c[x]), kind) for x, kind in SPELLING.values()]
            yield pa.RecordBatch.from_arrays([*(c[k] for k in kept), *keys, es], [*kept, *SPELLING, "es"])

    return parts.mapInArrow(work, schema)


def documents_of(src: DataFrame) -> DataFrame:
    """The documents of stored source rows."""
    d = _stored_heads(src).join(nested_candidates(src), list(GROUP), "left")
    return _documents(d.withColumn("ld_candidates", F.coalesce("ld_candidates", F.array().cast(f"array<{CANDIDATE}>"))), "ld_candidates")


def _stored_heads(src: DataFrame) -> DataFrame:
    """(group, c_... canonical fields, variants, what is the same in all of a group). A part is counted where it lies and travels as one row, its counts in a list."""
    fields = {f"c_{n}": (F.col(n), False) for n in ("article", "name", "url", "medium", "temperature")} | {"c_length": (F.col("length_mm"), True)}
    same = F.struct("dn", "pn_bar", "connection", "control")
    counts = _counts(src.select("*", same.alias("same")), [*DEAL, "same"], fields)
    parts = counts.groupBy(*DEAL).agg(F.collect_list(F.struct("f", "v", "d", "n")).alias("es"), F.first("same").alias("same"))
    each = parts.repartition(*GROUP).select(*GROUP, "same", F.explode("es").alias("e")).select(*GROUP, "same", "e.*")
    summed = each.groupBy(*GROUP, "same", "f", "v", "d").agg(F.sum("n").alias("n"))
    variant = (F.col("f") == list(fields).index("c_name")) & (F.col("v") != "")
    head = summed.groupBy(*GROUP).agg(*_picks(fields), F.array_sort(F.collect_set(F.when(variant, F.col("v")))).alias("variants"), F.first("same").alias("same"))
    return head.select(*(c for c in head.columns if c != "same"), "same.*")


def with_candidates(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Some of the documents of these rows with their candidates: only rows of their spellings are normalised and travel."""
    wanted = heads.select(F.explode("spellings").alias("s")).select("s.*").distinct()
    near = F.broadcast(wanted) if small(wanted) else wanted
    own = rows.select("*", *raw_group()).join(near, list(RAW_GROUP), "left_semi").select(*rows.columns)
    return nested(heads, ld_candidates(source_rows(own)))


def nested(heads: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with those of the candidates ``found`` that are theirs, in place of their group and spellings."""
    d = heads.join(_nested(found), list(GROUP), "left")
    return d.select(*(c for c in heads.columns if c not in (*GROUP, "spellings")), F.coalesce("ld_candidates", F.array().cast(f"array<{CANDIDATE}>")).alias("ld_candidates"))


def nested_candidates(src: DataFrame) -> DataFrame:
    """(group, ld_candidates): the candidates of each document that has any, sorted by article."""
    return _nested(ld_candidates(src))


def _nested(found: DataFrame) -> DataFrame:
    entry = F.struct(F.col("ld_article_norm").alias("article_norm"), *(F.col(f"ld_{n}").alias(n) for n in CANDIDATE_FIELDS))
    return found.groupBy(*GROUP).agg(F.array_sort(F.collect_list(entry)).alias("ld_candidates"))


def _documents(d: DataFrame, *rest: str) -> DataFrame:
    """Documents from their canonical fields; rest: further columns to keep."""
    # the article and name of a key follow from any spelling of the group
    of_texts = {"article_norm": ("c_article", "text"), "article_compact": ("c_article", "compact"), "name_norm": ("c_name", "text")}
    d = normalised(d, of_texts, d.columns).withColumns({k: F.coalesce(k, F.lit("")) for k in of_texts})
    # names of a group are equal once they are normalised: that text is in its key
    d = d.withColumns({"c_name": F.coalesce("c_name", F.lit("")), "brand": from_alias(F.nullif("name_norm", F.lit("")), "brand")})
    variants = F.when(F.size("variants") > 0, F.col("variants")).otherwise(F.array("c_name"))
    d = d.withColumn("name_variants", variants)
    c = {k: F.col(k) for k in ("brand", "dn", "pn_bar", "connection", "control", "article_norm", "article_compact", "name_variants")} | {"name": F.col("c_name"), "medium": F.col("c_medium"), "temperature": F.col("c_temperature"), "length_mm": F.col("c_length"), "article": F.col("c_article")}
    return d.select(
        steel_id(F.col("article_compact"), F.col("name_norm"), F.col("dn"), F.col("pn_bar"), F.col("connection"), F.col("control")).alias("steel_id"),
        F.coalesce("c_article", F.lit("")).alias("article"),
        "article_norm",
        "article_compact",
        F.col("c_name").alias("name"),
        "name_norm",
        "name_variants",
        "brand",
        "dn",
        "pn_bar",
        "connection",
        F.col("c_medium").alias("medium"),
        "control",
        F.col("c_temperature").alias("temperature"),
        F.col("c_length").alias("length_mm"),
        F.col("c_url").alias("url"),
        semantic_text(c).alias("semantic_text"),
        lexical_text(c).alias("lexical_text"),
        *rest,
    )


def point_id(steel: Column, prefix: str = "quarry:") -> Column:
    """The version 5 UUID of prefix + id in the URL name space."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.concat(F.lit(prefix), steel).cast("binary")))
    variant = F.substring(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)), -1, 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.lower(F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)))

"""The versioned index: immutable tables in a folder of their own, checks before publication, and a pointer that is switched last.

    root/steel_<model>_<UTC time>/   docs, vectors, postings (by term bucket), terms, stats, meta
    root/_active/000000000001        the name of a published version; the greatest number counts

All paths go through Hadoop's file system, so any store that Spark writes works.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.encode import Encoder, encode
from quarry.functions.text import encoder_text
from quarry.operators.catalog import candidates, document_heads, nested
from quarry.operators.retrieval import bm25_index_topk, build_postings, corpus_stats, dense_topk, query_terms, rrf
from quarry.session import stored

# The queries that a new index must answer.
SMOKE = ("1184399", "а0486", "Temper DN80 PN16", "Broen Ду80 Ру16", "фланцевый кран Ду50 Ру40")
POINTER = "_active"


@dataclass(frozen=True)
class Meta:
    csv_sha256: str
    embedding_model: str
    embedding_revision: str
    embedding_dimension: int
    embedding_dtype: str
    max_sequence_length: int
    build_timestamp: str
    document_count: int
    source_row_count: int
    deduplicated_row_count: int
    collection_name: str
    collection_alias: str


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    vectors: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    meta: Meta


class Missing(Exception):
    """There is no such version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def utc_stamp(now: datetime | None = None) -> str:
    """A time as text; one without a zone counts as UTC."""
    now = now or datetime.now(timezone.utc)
    now = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)
    return now.strftime("%Y%m%dT%H%M%SZ")


def version_name(spark: SparkSession, root: str, model: str, now: datetime | None = None) -> str:
    import re

    base = f"steel_{re.sub('[^a-z0-9]+', '-', model.lower()).strip('-')}_{utc_stamp(now)}"
    name, n = base, 0
    while exists(spark, f"{root}/{name}"):
        n += 1
        name = f"{base}_{n}"
    return name


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def pointers(spark: SparkSession, root: str) -> list[str]:
    """The pointer files' names, in order."""
    fs, p = _fs(spark, f"{root}/{POINTER}")
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def active(spark: SparkSession, root: str) -> str | None:
    """The published version's name."""
    for name in reversed(pointers(spark, root)):
        if text := read_text(spark, f"{root}/{POINTER}/{name}"):
            return text
    return None


def publish(spark: SparkSession, root: str, name: str) -> bool:
    """Point the alias at a version. False if it points there already.

    A pointer is written aside and renamed to the next number, so a reader sees the old one or the new one, never none; of two writers one
    fails. Of the older pointers the last is kept, for readers that have listed it.
    """
    if active(spark, root) == name:
        return False
    known = pointers(spark, root)
    number = int(known[-1]) + 1 if known else 1
    fs, p = _fs(spark, f"{root}/{POINTER}/{number:012d}")
    _, aside = _fs(spark, f"{root}/{POINTER}/.{number:012d}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(name.encode("utf-8")))
    out.close()
    if fs.exists(p) or not fs.rename(aside, p):
        fs.delete(aside, False)
        raise RuntimeError("another writer has published meanwhile")
    for old in known[:-1]:
        fs.delete(_fs(spark, f"{root}/{POINTER}/{old}")[1], False)
    return True


def open_version(spark: SparkSession, root: str, name: str) -> Index:
    where = f"{root}/{name}"
    if not exists(spark, f"{where}/meta/_SUCCESS"):
        raise Missing(name)
    t = lambda n: spark.read.parquet(f"{where}/{n}")
    return Index(t("docs"), t("vectors"), t("postings"), t("terms"), t("stats"), Meta(**t("meta").first().asDict()))


def open_index(spark: SparkSession, root: str, *, name: str | None = None, model: str | None = None, report: dict | None = None) -> Index:
    """A named version, else the published one, else the one that a build report names, else the newest one of the model; Missing if there is none.

    A report counts only if it is of this alias, and of the model that is asked for.
    """
    known = report or {}
    fits = known.get("collection_alias") == POINTER and model in (None, known.get("embedding_model"))
    for candidate in (name, active(spark, root), known.get("collection_name") if fits else None):
        if candidate:
            try:
                return open_version(spark, root, candidate)
            except Missing:
                continue
    fs, p = _fs(spark, root)
    if fs.exists(p):
        names = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()), reverse=True)
        for candidate in names:
            try:
                index = open_version(spark, root, candidate)
            except Missing:
                continue
            if model is None or index.meta.embedding_model == model:
                return index
    raise Missing(name or root)


def write_tables(docs: DataFrame, encoder: Encoder, where: str, model: str) -> None:
    """docs, vectors, postings (stored by term bucket, sorted by term, so a query reads few files and row groups), terms and stats under a folder."""
    spark = docs.sparkSession
    # each file in the order of ids, so that a search that asks for some of them reads the row groups that have them
    docs.withColumn("doc_id", F.col("steel_id")).sortWithinPartitions("doc_id").write.mode("errorifexists").parquet(f"{where}/docs")
    kept = spark.read.parquet(f"{where}/docs")
    texts = kept.select("doc_id", encoder_text("semantic_text", model, "passage").alias("text"))
    encode(texts, encoder, text="text", role="document").write.mode("errorifexists").parquet(f"{where}/vectors")
    postings, lengths = build_postings(kept, "doc_id", "lexical_text")
    # dealt by ranges: a bucket, or a term that stands everywhere, is as many tasks and files as it needs
    postings.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term").write.mode("errorifexists").partitionBy("bucket").parquet(f"{where}/postings")
    df = spark.read.parquet(f"{where}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    df.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("errorifexists").parquet(f"{where}/terms")
    corpus_stats(lengths).write.mode("errorifexists").parquet(f"{where}/stats")


def build_index(rows: DataFrame, root: str, encoder: Encoder, *, model: str = "hashing-256", revision: str = "", checksum: str = "", recreate: bool = False, smoke: tuple[str, ...] = SMOKE, now: datetime | None = None) -> Meta:
    """Group, encode, write a new version, check it, and publish it if ``recreate`` asks for that. Old versions stay."""
    spark = rows.sparkSession
    name = version_name(spark, root, model, now)
    where = f"{root}/{name}"
    heads = stored(document_heads(rows, tallied=True))  # the documents and both counts come from here; candidates from their own reading of the rows
    n_rows, n_distinct = heads.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_copies", "n_rows"))).first()
    write_tables(nested(heads.drop("n_copies", "n_rows"), candidates(rows, ids=False)), encoder, where, model)
    docs, vectors = spark.read.parquet(f"{where}/docs"), spark.read.parquet(f"{where}/vectors")
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if vectors.count() != n or ids != n:
        raise RuntimeError("documents and vectors don't correspond, or two groups have one id")
    if n and docs.select("doc_id", "ld_candidates").limit(1).count() != 1:
        raise RuntimeError("the index has no sample document")
    index = Index(docs, vectors, *(spark.read.parquet(f"{where}/{t}") for t in ("postings", "terms", "stats")), None)
    if n and smoke:
        smoke_check(index, encoder, model, smoke)
    meta = Meta(checksum, model, revision, encoder.dimension, "float32", 512, utc_stamp(now), n, n_rows, n_distinct, name, POINTER)
    spark.createDataFrame([asdict(meta)], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in asdict(meta).items())).coalesce(1).write.parquet(f"{where}/meta")
    if recreate:
        publish(spark, root, name)
    return meta


def smoke_check(index: Index, encoder: Encoder, model: str, queries: tuple[str, ...] = SMOKE, k: int = 5) -> None:
    """Raw queries through both retrievers: each must find something."""
    spark = index.docs.sparkSession
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    vectors = encode(q.select("query_id", encoder_text("query", model, "query").alias("text")), encoder, text="text", out="query_vector", role="query")
    dense = dense_topk(index.vectors, vectors, id_col="doc_id", vector="vector", k=k)
    hits = rrf([dense, bm25_index_topk(index.postings, index.stats, query_terms(q, "query_id", "query"), k=k, frequencies=index.terms)], k=k)
    found = {r.query_id for r in hits.select("query_id").distinct().collect()}
    if none := [x for i, x in enumerate(queries) if i not in found]:
        raise RuntimeError(f"smoke queries without results: {none}")


def filled(meta: Meta, report: dict | None) -> Meta:
    """The metadata, with what it lacks about the model taken from a build report."""
    known = {k: (report or {}).get(k) for k in ("embedding_model", "embedding_revision", "embedding_dimension")}
    return replace(meta, **{k: v for k, v in known.items() if v is not None and getattr(meta, k) is None})


def readiness(index: Index, encoder: Encoder, *, model: str, revision: str = "", dimension: int | None = None) -> list[str]:
    """The codes of what is wrong, in order; empty if the index can serve."""
    problems = []
    wanted = dimension or encoder.dimension
    width = index.vectors.select(F.size("vector")).limit(1).collect()
    checks = (
        ("runtime_dimension_mismatch", len(encoder.encode(["x"])[0]) == encoder.dimension),
        ("spec_dimension_mismatch", encoder.dimension == wanted),
        ("index_empty", bool(width)),
        ("model_mismatch", index.meta.embedding_model == model),
        ("revision_mismatch", (index.meta.embedding_revision or "") == revision),
        ("index_dimension_mismatch", index.meta.embedding_dimension == wanted),
        ("vector_dimension_mismatch", not width or width[0][0] == wanted),
    )
    problems += [code for code, fine in checks if not fine]
    return problems

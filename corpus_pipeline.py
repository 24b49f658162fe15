"""The corpus pipeline: quality rules, near copies, secrets, the mix, and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder, and the next
stage reads that. All stages but the last return the columns of documents. Stages take nulls in any column, empty and very
long texts, repeated rows, empty tables and extra columns as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import save
from quarry.llm.mixing import cube_mix, mixed_documents
from quarry.llm.quality_rules import quality_rules
from quarry.llm.secret_scan import secret_scan
from quarry.llm.sentencepiece_codec import sentencepiece_encode
from quarry.llm.near_copies import drop_near_copies

#: What takes the place of a secret.
REDACTED = "<SECRET>"


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns col0, col1, ... so that no column's name clashes with an operator's; the names in use."""
    at = {c: f"col{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at


def _with_text(docs: DataFrame, found: DataFrame, at: dict[str, str], text: str) -> DataFrame:
    """The columns of docs from a result that kept them, with its new text; n_chars follows the text where it changes."""
    new = F.col(text)
    cols = {c: F.col(own).alias(c) for c, own in at.items()}
    cols["text"] = new.alias("text")
    if "n_chars" in cols:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(new.eqNullSafe(F.col(at["text"])), F.col(at["n_chars"])).otherwise(F.length(new).cast(kind)).alias("n_chars")
    return found.select(*cols.values())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose the boilerplate lines of their host."""
    d, at = _numbered(docs)
    judged = quality_rules(d, text=at["text"], host=at["source"], doc_id=at["doc_id"], keep=tuple(at.values()), cleaned=True).where("kept")
    return _with_text(docs, judged, at, "__cleaned")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays: the one with the smallest id."""
    d, at = _numbered(docs)
    return drop_near_copies(d, text=at["text"], doc_id=at["doc_id"]).toDF(*at)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced; all documents stay."""
    d, at = _numbered(docs)
    found = secret_scan(d, text=at["text"], owner=at["source"], repo=(at["source"], at["lang"]), keep=tuple(at.values()), redact=REDACTED)
    return _with_text(docs, found, at, "__redacted")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them."""
    d, at = _numbered(docs)
    names = {"text": at["text"], "source": at["source"], "doc_id": at["doc_id"]}
    return mixed_documents(d, cube_mix(d, **names), **names).toDF(*at)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the tokens of every text."""
    return sentencepiece_encode(docs, keep=("doc_id", "source"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the stages; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs

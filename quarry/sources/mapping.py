"""Mapping rows: the CSV scan, its required columns, and JSON sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a mapping row, in order.
COLUMNS = (
    "ld_name", "ld_article", "ld_url", "ld_dn", "ld_pn_mpa", "ld_connection", "ld_medium", "ld_control", "ld_temp", "ld_length",
    "steel_name", "steel_article", "steel_url", "steel_dn", "steel_pn_bar", "steel_connection", "steel_medium", "steel_control", "steel_temp", "steel_length",
    "match_score", "match_max", "price_ld",
)
NUMERIC = {"match_score": "int", "match_max": "int", "price_ld": "double"}
# Cell texts that count as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def require_columns(columns: list[str]) -> None:
    missing = [c for c in COLUMNS if c not in columns]
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))


def read_csv(spark: SparkSession, path: str, *, check: bool = True) -> DataFrame:
    """Mapping rows from CSV with a header: every cell as text (articles keep their zeros), missing cells null.

    Columns may come in any order and more may follow; scores and prices are typed.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    if check:
        require_columns(raw.columns)
    clean = {c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c in raw.columns}
    return raw.select(*(clean[c].cast(NUMERIC.get(c, "string")).alias(c) for c in raw.columns))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, category, expected_ld_articles) from JSON lines; blank lines are skipped."""
    return spark.read.schema("query string, category string, expected_ld_articles array<string>").json(path)


def write_queries(df: DataFrame, path: str) -> None:
    """One record a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_report(record: dict, path: str | Path) -> Path:
    """A small report as readable JSON."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, ensure_ascii=False, indent=2), encoding="utf-8")
    return path


def checksum(spark: SparkSession, path: str) -> str:
    """sha256 over the files of a path, in the order of their names; each is streamed through the digest, whatever its size."""
    import hashlib

    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(where) or []:
        listed = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [f.getPath() for f in listed if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    sums = []
    for p in sorted(found, key=lambda p: p.toString()):
        stream = fs.open(p)
        try:
            sums.append(jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream))
        finally:
            stream.close()
    return sums[0] if len(sums) == 1 else hashlib.sha256("".join(sums).encode()).hexdigest()

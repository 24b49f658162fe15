"""The Merkle manifest against a literal reading, over many shapes of trees."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle
from quarry.llm.merkle import FIELDS, fold, leaf_digest, manifest, proof_digest

H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def leaf_of(row):
    return H(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def proofs(leaves):
    """(root, [siblings of each leaf, level by level as (before, after)]) level by level."""
    at, out = list(range(len(leaves))), [[] for _ in leaves]
    level = list(leaves)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            out[k].append((run[: i % 3], run[i % 3 + 1 :]))
            at[k] = i // 3
        level = [H(*r) for r in runs]
    return level[0], out


def literal(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of every row."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = proofs([x[2] for x in by[s]])
    root, top = proofs([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, top):
        for (*_, leaf, r), own in zip(by[s], trees[s][1]):
            i = "" if r["doc_id"] is None else str(r["doc_id"])
            now = leaf
            if zlib.crc32(i.encode()) % 2 == 0:
                now = leaf_of(r | {"text": None if r["text"] is None else r["text"].replace("\n", "")})
            text = ""
            for before, after in own + above:
                text += "".join(before + after)
                now = H(*before, now, *after)
            out.append((r["doc_id"], leaf, trees[s][0], root, H(text), now, now == root))
    return out


def got(df):
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = manifest(df, more={"now": leaf_digest(text if f == "text" else F.col(f) for f in FIELDS)}).withColumn("folded", fold(F.col("now"), F.col("proof")))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), "folded", F.col("folded") == F.col("root"))


def rows_of(counts):
    """So many rows of each source, with ids out of order and a line end in every other text."""
    out = []
    for s, n in counts.items():
        out += [dict(doc_id=(i * 7919) % 10007 - 300, text=f"{s} line {i}" + "\n" * (i % 2) + "é", lang=None if i % 5 else "en", source=s, n_chars=i) for i in range(n)]
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_a_literal_reading(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = rows_of({None: 4, "": 1, "-": 2, "a": 28, "é": 3, "z": 81, "\U0001f600": 82, "￿": 9, "hot": 250})
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).repartition(5)
    assert Counter(map(tuple, got(df).collect())) == Counter(literal(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_one_source(spark, n):
    rows = rows_of({"only": n})
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert Counter(map(tuple, got(df).collect())) == Counter(literal(rows))


def test_tables_beyond_the_bounds_are_joined(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BROADCAST_OFFSETS", -1)
    monkeypatch.setattr(merkle, "BROADCAST_PROOFS", -1)
    rows = rows_of({"a": 30, "b": 100})
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert Counter(map(tuple, got(df).collect())) == Counter(literal(rows))


def test_edges(edge, none):
    assert manifest(none).collect() == []
    rows = [r.asDict() for r in edge.collect()]
    assert Counter(map(tuple, got(edge).collect())) == Counter(literal(rows))
    d = edge.withColumns({"root": F.lit("x"), "key": F.lit("y"), "proof": F.lit("z"), "i": F.lit(1), "n": F.lit(2), "k0": F.lit(3)})
    out = manifest(d, keep=tuple(d.columns))
    assert {"root_", "proof_", "key", "i", "n", "k0"} <= set(out.columns) and all(r.root_ == "x" and r.n == 2 and r.k0 == 3 for r in out.collect())


def test_a_change_anywhere_changes_the_root(spark):
    rows = rows_of({"a": 20, "b": 5})
    base = literal(rows)[0][3]
    for k in (0, 13, 24):
        other = [dict(r) for r in rows]
        other[k]["lang"] = "xx"
        df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in other], SCHEMA)
        roots = {r.root for r in manifest(df).collect()}
        assert len(roots) == 1 and base not in roots


def test_a_hot_source_is_many_ranges(spark, monkeypatch):
    saved, save = [], merkle.save
    monkeypatch.setattr(merkle, "save", lambda df, **k: saved.append(save(df, **k)) or saved[-1])
    df = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('s', id % 50) END AS source", "id AS n_chars").repartition(6)
    leaves = df.select(F.col("source").alias("key"), F.col("doc_id").alias("by"), F.lit(b"x").alias("digest"), F.monotonically_increasing_id().alias("row"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more data
    placed = merkle.ranked(leaves, [F.col("by")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = placed.where("key = 'hot'").orderBy("i").collect()
    assert [r.i for r in got] == list(range(4000)) and [r.by for r in got] == sorted(r.by for r in got) and {r.n for r in got} == {4000}
    assert saved[0].where("key = 'hot'").select(F.shiftright("mid", 33)).distinct().count() > 1

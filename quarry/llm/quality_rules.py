"""Quality rules: in-document rules, and cross-document line frequency for each host.

Lines are normalised (white space collapsed, ASCII lower case) and hashed. For every host the distinct documents
that hold a line are counted; copies of one text are one document, unless the caller wants them counted each. A line that more documents of the host hold
than the limit is boilerplate: it is removed from all of them but the first (smallest id), and a document that loses
too much that way is rejected.

Plan: one pass emits (host, line, text, id) for the distinct lines of a text; two aggregations with map-side
combine count them, so that a hot host, text or line costs each task a row for each of its keys. A counted small number of
lines over the limit goes to the workers; more of them are joined with the lines of each text, and come back to the documents as
a list for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, clear_of, host_key, lean, map_rows, save, signed

#: A line is boilerplate in a host, however large, if more distinct documents hold it.
LEAST_DOCS = 20
#: Below that number, where a caller sets a smaller one, also this share of the host's documents must be exceeded.
SHARE = 0.05
#: A document that loses at least this share of its words is rejected.
DEPLETED = 0.6
#: Rows of over-limit lines that go to the workers at most (24 bytes each); above that they are joined.
BROADCAST_LINES = 100_000

# The symbols that are counted.
SYMBOLS = "#*$%&|<>"

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_NOT_SYMBOLS = bytes(c for c in range(256) if chr(c) not in SYMBOLS)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pairs = w[:-1] * len(ids) + w[1:]
    _, pairs = np.unique(pairs, return_inverse=True)  # dense, so that a third factor can't overflow
    windows = pairs[:-1] * len(ids) + w[2:]
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    if not again.any():
        return 0
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def metrics(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else []
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, len(raw.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def lines_of(text: str) -> list[tuple[int, int]]:
    """(hash, words) of each \\n-split line; lines without words have hash 0."""
    out = []
    for line in text.encode("utf-8", "replace").lower().split(b"\n"):
        words = line.split()
        out.append((signed(xxhash.xxh64_intdigest(b" ".join(words))) if words else 0, len(words)))
    return out


def document_key(text: Column, doc_id: Column, copies: bool) -> Column:
    """What tells documents apart that hold a line: their text, with ``copies`` their id too."""
    return F.xxhash64(text, doc_id.cast("long")) if copies else F.xxhash64(text)


def held_lines(docs: DataFrame, *, text: str, host: str, doc_id: str, copies: bool = False) -> DataFrame:
    """(host, line, doc, first): the distinct lines of each document of a host, and its smallest id; line 0 is in every text.

    Null texts hold nothing; an empty table gives an empty result.
    """
    doc = document_key(docs[text], docs[doc_id], copies)
    df = docs.select(docs[doc_id].cast("long").alias("id"), host_key(docs[host]).alias("host"), docs[text].alias("text"), doc.alias("doc"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            at, lines = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t is not None:
                    # line 0 stands for the document itself
                    own = {0} | {x for x, n in lines_of(t) if n}
                    at += [i] * len(own)
                    lines += own
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in (0, 1, 3)), pa.array(lines, pa.int64())], ["id", "host", "doc", "line"])

    seen = bounded_batches(df).mapInArrow(emit, "id long, host string, doc long, line long")
    return seen.groupBy("host", "line", "doc").agg(F.min("id").alias("first"))


def boilerplate(held: DataFrame, *, least_docs: int, share: float) -> DataFrame:
    """(host, line, first): the lines over the limit of each host, and the smallest id that holds each (null if all of its ids are).

    An empty table gives an empty result.
    """
    counted = held.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("first").alias("first")).where(F.col("docs") > least_docs)
    totals = counted.where("line = 0").select("host", F.col("docs").alias("all"))
    over = counted.where("line <> 0").join(totals, "host").where(F.col("docs") > F.least(share * F.col("all"), F.lit(float(max(least_docs, LEAST_DOCS)))))
    return over.select("host", "line", "first")


def quality_rules(docs: DataFrame, *, text: str = "text", host: str = "source", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), cleaned: bool = False, least_docs: int = LEAST_DOCS, share: float = SHARE, depleted: float = DEPLETED, spare_first: bool = True, copies: bool = False) -> DataFrame:
    """The columns ``keep``, the in-document metrics, and the verdict on every row.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept: not base_failed, and
    the document isn't depleted by the removal of boilerplate lines (n_boiler_words of its words). With ``cleaned``
    also ``__cleaned``: the text without those lines. Null text: no words, not kept. A null host is a host of its own.
    With ``spare_first`` a line stays in the documents whose id is the smallest one that holds it in the host (where all ids of a line
    are null it stays everywhere), so that of a group of near copies one remains; without, it goes from all of them. ``copies``: documents of one text under several ids count each, not
    as one. Rows that repeat are judged alike; an empty table gives an empty result. A kept column whose name is a result's gets underscores at its end.
    """
    held = held_lines(docs, text=text, host=host, doc_id=doc_id, copies=copies)
    lines = save(boilerplate(held, least_docs=least_docs, share=share), compact=True)
    few = lines.count() <= BROADCAST_LINES
    kept = {c: f"__k{i}" for i, c in enumerate(keep)}
    body = kept.get(text, "__text")
    own_body = [docs[text].alias(body)] * (text not in kept)
    df = docs.select(*(docs[c].alias(k) for c, k in kept.items()), *own_body, docs[doc_id].cast("long").alias("__id"), host_key(docs[host]).alias("host"))
    hosts: dict[str, dict[int, int]] = {}
    if few:
        for r in lines.toArrow().to_pylist():
            hosts.setdefault(r["host"], {})[r["line"]] = r["first"]
        df = df.withColumn("__lines", F.lit(None).cast("array<struct<line: long, first: long>>"))
    else:
        own = held.drop("first").join(lines, ["host", "line"]).groupBy("host", F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("line", "first")).alias("__lines"))
        df = df.withColumn("__doc", document_key(F.col(body), F.col("__id"), copies)).join(own, ["host", "__doc"], "left").drop("__doc")

    def judge():
        def each(texts: list, ids: list, of: list, some: list) -> list:
            rows = []
            for t, i, h, ls in zip(texts, ids, of, some):
                m = metrics(t or "")
                failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
                lost, left = 0, t
                over = hosts.get(h) if few else None if ls is None else {x["line"]: x["first"] for x in ls}
                if over and t:
                    mine = lines_of(t)
                    out = [n > 0 and x in over and not (spare_first and over[x] in (None, i)) for x, n in mine]
                    lost = sum(n for (_, n), gone in zip(mine, out) if gone)
                    if lost and cleaned:
                        left = "\n".join(raw for raw, gone in zip(t.split("\n"), out) if not gone)
                rows.append((*m, failed, lost, not failed and lost < depleted * m[0], left)[: len(METRICS) + 3 + cleaned])
            return list(zip(*rows)) or [[]] * (len(METRICS) + 3 + cleaned)

        return each

    fields = ", ".join(f"{m} long" for m in METRICS) + ", base_failed boolean, n_boiler_words long, kept boolean" + ", `__cleaned` string" * cleaned
    out = clear_of(list(keep), [*METRICS, "base_failed", "n_boiler_words", "kept", "__cleaned"])
    found = map_rows(df, [body if text in kept else df[body], *(df[c] for c in ("__id", "host", "__lines"))], list(kept.values()), fields, judge)
    return found.select(*(F.col(k).alias(out[c]) for c, k in kept.items()), *found.columns[len(kept) :])

"""Secret scan with corpus-wide ownership frequency.

Three base patterns give spans that always count. Wider patterns give candidates; the hash of every
candidate value is aggregated over the corpus by distinct owners and repositories. A value that many
owners have is an example copied around; one that a single owner has is live-looking and its spans are added.

Plan: one pass over the texts writes a compact row for each document (no text) and its candidates; the
candidates are deduplicated by (value, owner, repository) with partial aggregation, so a value in a third of
all rows costs each task one row, and then counted. Spans are a function of the text, hence they are joined
back once for each distinct text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import clear_of, map_rows, save

# Base kinds in order, their patterns, the group that has the value and its least length.
BASE = (
    ("assign", r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)

# Wider candidates, in order.
WIDER = (
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    ("bearer", r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*"),
    ("url", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"']{1,64}:[^\s/@\"']{6,64}@"),
    ("blob", r"[A-Za-z0-9+/_-]{24,}={0,2}"),
)

#: A blob needs a digit, both cases and so many bits of entropy a character.
BLOB_BITS = 3.5
#: A value that more owners, or more repositories, than this have is a copied example.
MOST_OWNERS = 1
MOST_REPOS = 2

KINDS = [k for k, *_ in BASE] + [k for k, _ in WIDER]
_BASE = [(k, re.compile(p), g, n) for k, p, g, n in BASE]
_WIDER = [(k, re.compile(p)) for k, p in WIDER]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base matches, in order. A match whose value is too short is dropped, not retried."""
    found = []
    for i, (_, pattern, group, least) in enumerate(_BASE):
        if i == 2:  # runs of hex digits: those that are long enough are the same matches
            pattern, least = _LONG_HEX, 0
        found += [(m.start(), i, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


_LONG_HEX = re.compile(r"[0-9a-f]{16,}")


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


class Taken:
    """Disjoint spans in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take [a, b) unless something in it is taken."""
        i = bisect_right(self.ends, a)
        if i < len(self.starts) and self.starts[i] < b:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Wider matches that no base span and no earlier kind overlaps."""
    taken, found = Taken([(a, b) for a, _, b in base]), []
    for i, (kind, pattern) in enumerate(_WIDER, len(BASE)):
        for m in pattern.finditer(text):
            v = m[0]
            if kind == "blob" and not (any(c.isdigit() for c in v) and v.lower() != v and v.upper() != v and bits(v) >= BLOB_BITS):
                continue
            if taken.add(*m.span()):
                found.append((m.start(), i, m.end()))
    return sorted(found)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans, by: str) -> str:
    """text with every span, or run of overlapping spans, replaced."""
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], by]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def live_spans(found: DataFrame, *, most_owners: int, most_repos: int) -> DataFrame:
    """(text_key, live array<struct<a, k, b>>) of each distinct text with owner-specific candidates."""
    each = found.where(F.size("cands") > 0).select("text_key", "owner", "repo", F.explode("cands").alias("c"))
    owned = each.groupBy(F.col("c.value").alias("value"), "owner", "repo").agg(F.lit(1).alias("one"))
    owned = owned.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    rare = owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).where((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)).select("value")
    spans = each.groupBy("text_key", F.col("c.value").alias("value"), "c.a", "c.k", "c.b").agg(F.lit(1).alias("one"))
    live = spans.join(rare, "value").select("text_key", F.struct("a", "k", "b").alias("s"))
    return live.groupBy("text_key").agg(F.collect_list("s").alias("live"))


def secret_scan(docs: DataFrame, *, text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), keep: tuple[str, ...] = ("doc_id",), redact: str | None = None, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """The columns ``keep``, counts and a digest of the base spans, and all spans (base and owner-specific candidates).

    With ``redact`` the result also has ``__redacted``: the text with every span replaced by that string.
    Null and empty texts have no spans, and an empty digest input; a null owner or repository counts as one of
    its own. Documents with equal texts get equal spans. An empty table gives an empty result. A kept column whose name is a
    result's gets underscores at its end.
    """
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "__redacted"]
    cols = clear_of(list(keep), own)
    kept = {c: f"__k{i}" for i, c in enumerate(cols)}
    owner_key = F.coalesce(F.concat(F.lit("="), docs[owner].cast("string")), F.lit("-"))
    repo_key = F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-")) for c in repo))
    body = kept.get(text, "__text")
    own_body = [docs[text].alias(body)] * (text not in kept)
    df = docs.select(*(docs[c].alias(k) for c, k in kept.items()), owner_key.alias("owner"), repo_key.alias("repo"), *own_body)

    def scan():
        def each(texts: list) -> list:
            keys, base, wider = [], [], []
            for t in texts:
                t = t or ""
                found = base_spans(t)
                more = candidates(t, found)
                base.append([{"a": a, "k": k, "b": b} for a, k, b in found])
                wider.append([{"value": hashlib.blake2b(t[a:b].encode("utf-8", "replace"), digest_size=16).digest(), "a": a, "k": k, "b": b} for a, k, b in more])
                keys.append(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() if more else None)
            return [keys, base, wider]

        return each

    with_body = redact is not None or text in kept
    found = map_rows(df, [body if with_body else df[body]], [c for c in df.columns if with_body or c != body], "text_key binary, base array<struct<a:int,k:int,b:int>>, cands array<struct<value:binary,a:int,k:int,b:int>>", scan)
    found = save(found)
    live = live_spans(found, most_owners=most_owners, most_repos=most_repos)
    without = found.where(F.col("text_key").isNull()).withColumn("live", F.lit(None).cast("array<struct<a:int,k:int,b:int>>"))
    joined = found.where(F.col("text_key").isNotNull()).join(live, "text_key", "left")
    both = without.unionByName(joined)
    both = both.withColumn("live", F.coalesce("live", F.array().cast("array<struct<a:int,k:int,b:int>>")))
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s.k), s.a, s.b)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.k == k)).cast("long")
    spans = F.concat("base", "live")
    results = [
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(spans).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    ]
    named = [F.col(k).alias(cols[c]) for c, k in kept.items()]
    if redact is None:
        return both.select(*named, *results)

    def cut():
        return lambda texts, spans: [[redacted(t, [(x["a"], x["b"]) for x in s], redact) if t and s else t for t, s in zip(texts, spans)]]

    rows = both.select(*kept.values(), *([body] * (text not in kept)), *results, spans.alias("__spans"))
    names = [*kept.values(), *own[:-1]]
    done = map_rows(rows, [body if text in kept else F.col(body), F.col("__spans")], names, "`__redacted` string", cut)
    return done.select(*named, *own)

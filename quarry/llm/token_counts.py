"""Token counts: the exact length histogram.

Documents are encoded and aggregated by encoded length; suffix sums over the histogram answer, for every
context limit, how many documents and tokens lie at or above it, the total after truncation, and quantiles.

Plan: encoding is one pass; only lengths are aggregated, with map-side combine, so the shuffle has a row for each
distinct length and task. Suffix sums run in two levels (inside blocks of lengths, then over blocks), so that no
task gets the whole histogram unless it fits one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, save

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokeniser pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 512


def ranks_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(data: bytes, pattern: str = PATTERN):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and n_tokens of every whole text; null and empty: 0. Texts are ordinary text, never special tokens.

    Rows that repeat are counted each; an empty table gives an empty result. A kept column named n_tokens becomes n_tokens_.
    """
    data = docs.sparkSession.sparkContext.broadcast(ranks_of(tokenizer))  # one vocabulary: a megabyte, whatever the corpus

    def count():
        own = encoder(data.value)
        return lambda texts: [[len(own.encode_ordinary(t)) if t else 0 for t in texts]]

    return map_rows(docs, [docs[text]], list(keep), "n_tokens long", count)


def length_histogram(lengths: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """For each distinct length L: its documents, and for the context limit L the suffix and prefix sums.

    docs_ge and tokens_ge count documents of L tokens or more; truncated_total is the corpus cut to L tokens a
    document; n_truncated are the documents that lose tokens; quantile is the share of documents of at most L tokens.
    An empty table gives an empty result.
    """
    hist = save(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), compact=True)  # two plans read it, and the texts are encoded once
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lengths
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"), F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    h = hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_ge"),
        (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_ge"),
        "all_docs",
        "all_tokens",
    )
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        (F.col("docs_ge") - F.col("n_docs")).alias("n_truncated"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, from the histogram alone: documents, totals, truncated total, truncated documents."""
    n = F.col("n_tokens")
    total: Column = F.sum(n * F.col("n_docs"))
    return hist.agg(
        F.sum("n_docs").alias("n_docs"),
        total.alias("total_tokens"),
        F.sum(F.least(n, F.lit(limit)) * F.col("n_docs")).alias("truncated_total"),
        F.coalesce(F.sum(F.when(n > limit, F.col("n_docs"))), F.lit(0)).alias("n_truncated"),
    )


def quantiles(hist: DataFrame, probabilities: list[float]) -> DataFrame:
    """One row with p0, p1, ...: the smallest length that a share p of the documents doesn't exceed."""
    least = lambda p: F.min(F.when(F.col("quantile") >= p - 1e-12, F.col("n_tokens")))
    return hist.agg(*(least(p).alias(f"p{i}") for i, p in enumerate(probabilities)))

"""BM25 top-k that reads few postings: blocks of documents with the highest impact of each term in them.

Documents that share their rarest-looking terms (the smallest hash over a document's terms) lie together, in blocks of a fixed number. A posting
is stored as its impact, the share of a score that doesn't depend on the query; a row of the block table has a term's highest
impact in a block. The sum of these over a query's terms bounds the score of every document of the block, so

1. the blocks with the highest bounds are scored, so many that they have k documents; the k-th score is a threshold that the result
   can't be below;
2. in the blocks whose bound reaches the threshold the terms with the highest bounds are read, so many that the others can add no more than
   a share of the threshold. A document stays if its score so far and what the others can add reach the threshold;
3. the other terms are read in the blocks that still have documents, for those alone.

No document that is left out can be in the result, so it is exact. Files of both tables have some documents each and are sorted by term bucket and term, so a query's terms prune their row groups and pages.
The postings of the queries' terms are dealt by block, once, and steps 2 and 3 are worked out where a block then lies, for all queries that can find something in it: what leaves
a task are documents that reach the threshold, not what each term adds to each document. A pass takes a bounded number of query terms; more queries are more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import words
from quarry.operators.retrieval import B, K1, PREFETCH, small, term_bucket, term_counts, top

#: Documents in a block.
BLOCK_DOCS = 64
#: The terms that are read first leave no more than this share of the threshold to the others.
SHARE = 0.5
#: Scores have six places; a bound may be this much below a rounded score that it still admits.
SLACK = 1e-6
#: Query terms of a pass, which its tasks hold beside a block.
ASKED = 100_000


@dataclass(frozen=True)
class BlockIndex:
    """terms (bucket, term, idf), blocks (bucket, term, block, n, most), postings (bucket, term, block, entries of doc_id and impact)."""

    terms: DataFrame
    blocks: DataFrame
    postings: DataFrame


def _write(df: DataFrame, where: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, term, block, doc_id, impact) with the entries of a term and block in one row; two, where a batch ends between them."""
    for b in batches:
        if b.num_rows:
            term, block = b.column(1), b.column(2).to_numpy()
            new = np.append(True, (block[1:] != block[:-1]) | pc.not_equal(term.slice(1), term.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False))
            at = np.flatnonzero(new)
            entries = pa.ListArray.from_arrays(pa.array(np.append(at, b.num_rows), pa.int32()), pa.StructArray.from_arrays([b.column(3), b.column(4)], ["doc_id", "impact"]))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in range(3)), entries], ["bucket", "term", "block", "entries"])


def write_blocks(docs: DataFrame, where: str, *, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, k1: float = K1, b: float = B) -> BlockIndex:
    """Write the block index of documents under a folder, and open it. Documents without terms are counted, and found by no query."""
    spark = docs.sparkSession
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.array_min(F.transform(words(text), lambda x: F.xxhash64(x))).alias("near"))
    # like documents are neighbours; a block is so many neighbours of one range. Texts travel once, and nothing else does
    t = t.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id").withColumn("__row", F.monotonically_increasing_id())
    t = t.withColumn("block", F.shiftleft(F.shiftright("__row", 33), 33) + F.floor(F.col("__row").bitwiseAND((1 << 33) - 1) / block_docs))
    t = t.select("doc_id", "block", words("text").alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    stored = _write(term_counts(t), f"{where}/documents")
    kind = t.schema["doc_id"].dataType.simpleString()
    n, avgdl = stored.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    tf = stored.select("doc_id", "block", "dl", F.explode("terms").alias("t")).select("doc_id", "block", "dl", "t.term", "t.tf")
    if not stored.groupBy("block", "doc_id", "dl").count().where("count > 1").isEmpty():
        # rows of one id and length in a block are one document's: only then are postings dealt and added
        tf = tf.groupBy("term", "block", "doc_id", "dl").agg(F.sum("tf").alias("tf"))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    flat = tf.select(term_bucket("term").alias("bucket"), "term", "block", "doc_id", impact.alias("impact")).sortWithinPartitions("bucket", "term", "block", "doc_id")
    postings = _write(flat.mapInArrow(_packed, f"bucket int, term string, block long, entries array<struct<doc_id: {kind}, impact: double>>"), f"{where}/postings")
    blocks = _write(postings.select("bucket", "term", "block", F.size("entries").alias("n"), F.array_max("entries.impact").alias("most")), f"{where}/blocks")
    df = blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    idf = df.select("bucket", "term", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    _write(idf.sortWithinPartitions("bucket", "term"), f"{where}/terms")
    return open_blocks(spark, where, kind)


def open_blocks(spark: SparkSession, where: str, id_type: str = "bigint") -> BlockIndex:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{where}/{name}")
    return BlockIndex(
        read("terms", "bucket int, term string, idf double"),
        read("blocks", "bucket int, term string, block long, n int, most double"),
        read("postings", f"bucket int, term string, block long, entries array<struct<doc_id: {id_type}, impact: double>>"),
    )


def _parts(index: BlockIndex, wanted: DataFrame, buckets: list[int]) -> DataFrame:
    """(query_id, block, doc_id, part) of the postings that wanted (query_id, term, block, idf) names; a part is one term's share of a score."""
    rows = index.postings.where(F.col("bucket").isin(buckets)).select("term", "block", "entries")
    wanted = F.broadcast(wanted) if small(wanted) else wanted
    each = rows.join(wanted, ["term", "block"]).select("query_id", "block", "idf", F.explode("entries").alias("e"))
    return each.select("query_id", "block", "e.doc_id", (F.col("idf") * F.col("e.impact")).alias("part"))


@dataclass(frozen=True)
class _Asked:
    """The queries of a pass: their names and thresholds, the terms, and by term (from ``start``) its queries' numbers and its idf."""

    names: pa.Array
    least: np.ndarray
    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    idf: np.ndarray

    @staticmethod
    def of(asked: pa.Table, least: pa.Table) -> _Asked:
        plain = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        q, t = (plain(asked.column(c)).dictionary_encode(null_encoding="encode") for c in ("query_id", "term"))
        code = t.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        at = pc.index_in(q.dictionary, value_set=plain(least.column("query_id")))
        known = np.append(plain(least.column("least")).to_numpy(), 0.0)  # a query without a threshold: 0
        return _Asked(q.dictionary, known[pc.fill_null(at, len(known) - 1).to_numpy()], t.dictionary, np.searchsorted(code[order], np.arange(len(t.dictionary) + 1)), q.indices.to_numpy()[order], plain(asked.column("idf")).to_numpy()[order])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by block, cut anew so that none ends inside a block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            block = b.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut or (held and held[-1].column("block")[-1].as_py() != block[-1]):
                yield pa.concat_batches([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _in_block(a: _Asked, term: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(queries, documents, scores) that reach the thresholds, and (queries, rows) that were read, of a block's rows ``term`` with impacts m (rows by documents)."""
    sizes = a.start[term + 1] - a.start[term]
    row = np.repeat(np.arange(len(term)), sizes)
    at = np.arange(len(row)) + np.repeat(a.start[term] - (np.cumsum(sizes) - sizes), sizes)
    q, w = a.query[at], a.idf[at]
    can = w * m.max(1)[row]
    bound = np.bincount(q, can, len(a.names))
    keep = bound[q] >= a.least[q]
    order = np.flatnonzero(keep)[np.lexsort((can[keep], q[keep]))]
    q, w, row, can = q[order], w[order], row[order], can[order]
    none = np.zeros(0, np.int64)
    if not len(q):
        return none, none, np.zeros(0), none, none
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(q))))
    least = a.least[q[first]]
    # what a term and those with lower bounds can add
    upto = np.cumsum(can)
    upto -= (upto[first] - can[first])[group]
    high = upto >= SHARE * least[group]
    low = np.maximum.reduceat(np.where(high, 0.0, upto), first)
    each = w[:, None] * m[row]
    part = np.add.reduceat(np.where(high[:, None], each, 0.0), first)
    left = (part > 0) & (part + low[:, None] >= least[:, None] - SLACK)
    more = ~high & left.any(1)[group]
    part += np.add.reduceat(np.where(more[:, None], each, 0.0), first)
    g, d = np.nonzero(left & (part >= least[:, None] - SLACK))
    read = high | more
    return q[first][g], d, part[g, d], q[read], row[read]


def _worker(sent, report: bool):
    """What reaches the thresholds, (query_id, doc_id, score), or what was read for it, (query_id, term, block), in sorted rows (term, block, entries)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _Asked(*sent.value)
        for b in _whole_blocks(batches):
            block, term = b.column("block").to_numpy(), pc.index_in(b.column("term"), value_set=a.terms).to_numpy()
            entries = b.column("entries")
            sizes = pc.list_value_length(entries).to_numpy()
            flat, ends = entries.flatten(), np.append(0, np.cumsum(sizes))
            ids = pc.struct_field(flat, [0]).dictionary_encode(null_encoding="encode")
            doc, impact = ids.indices.to_numpy(), pc.struct_field(flat, [1]).to_numpy()
            row = np.repeat(np.arange(len(block)), sizes)
            edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            found: list[list[np.ndarray]] = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                f = slice(ends[lo], ends[hi])
                own, place = np.unique(doc[f], return_inverse=True)
                m = np.bincount((row[f] - lo) * len(own) + place, impact[f], (hi - lo) * len(own)).reshape(hi - lo, len(own))
                q, d, score, rq, rr = _in_block(a, term[lo:hi], m)
                found.append([rq, rr + lo] if report else [q, own[d], score])
            columns = [np.concatenate(c) for c in zip(*found)]
            first = a.names.take(pa.array(columns[0]))
            if report:
                at = pa.array(columns[1])
                yield pa.RecordBatch.from_arrays([first, b.column("term").take(at), b.column("block").take(at)], ["query_id", "term", "block"])
            else:
                yield pa.RecordBatch.from_arrays([first, ids.dictionary.take(pa.array(columns[1])), pa.array(columns[2])], ["query_id", "doc_id", "score"])

    return work


def blockmax_topk(index: BlockIndex, terms: DataFrame, *, k: int = PREFETCH, save=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """((query_id, doc_id, score, rank), (query_id, term, block): the blocks whose postings were read) for terms (query_id, term).

    ``save`` may store a table that several steps read; without it they are computed again.
    """
    passes = max(1, -(-terms.count() // ASKED))
    of = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    each = [_pass(index, terms.where(of == i) if passes > 1 else terms, k, save) for i in range(passes)]
    out, read = each[0]
    for o, r in each[1:]:
        out, read = out.unionByName(o), read.unionByName(r)
    return out, read


def _pass(index: BlockIndex, terms: DataFrame, k: int, save) -> tuple[DataFrame, DataFrame]:
    near = lambda df: F.broadcast(df) if small(df) else df
    by, spark = ["query_id", "block"], terms.sparkSession
    buckets = sorted(r.b for r in terms.select(term_bucket("term").alias("b")).distinct().collect())  # the index's buckets at most
    asked = save(index.terms.where(F.col("bucket").isin(buckets)).select("term", "idf").join(near(terms), "term").select("query_id", "term", "idf"))
    heads = index.blocks.where(F.col("bucket").isin(buckets)).select("term", "block", "n", "most").join(near(asked), "term")
    # of the k blocks with the highest bounds as many as it takes to have k documents
    blocks = heads.groupBy(*by).agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.max("n").alias("docs"))
    best = top(blocks, ["query_id"], [F.desc("bound"), F.col("block")], k, "place")
    before = F.sum("docs").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    seeds = save(best.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).select(*by))
    tried = seeds.join(near(asked), "query_id").select(*by, "term", "idf")
    first = _parts(index, tried, buckets).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    kth = top(first, ["query_id"], [F.desc("score"), F.col("doc_id")], k).where(F.col("rank") == k)
    least = kth.select("query_id", (F.col("score") - SLACK).alias("least"))  # a row a query
    a = _Asked.of(asked.toArrow(), least.toArrow())  # ASKED rows at most
    sent = spark.sparkContext.broadcast((a.names, a.least, a.terms, a.start, a.query, a.idf))  # no class of its own: workers may not have the module
    hit = index.postings.where(F.col("bucket").isin(buckets)).join(near(asked.select("term").distinct()), "term", "left_semi")
    dealt = hit.select("term", "block", "entries").repartition("block").sortWithinPartitions("block")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    ids = index.postings.schema["entries"].dataType.elementType["doc_id"].dataType.simpleString()
    found = dealt.mapInArrow(_worker(sent, False), f"query_id {kind(terms, 'query_id')}, doc_id {ids}, score double")
    scores = found.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    read = dealt.mapInArrow(_worker(sent, True), f"query_id {kind(terms, 'query_id')}, term string, block long")
    there = index.blocks.where(F.col("bucket").isin(buckets)).select("term", "block")
    read = tried.join(there, ["term", "block"], "left_semi").select("query_id", "term", "block").unionByName(read).distinct()
    return top(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k), read

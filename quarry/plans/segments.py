"""A live lexical index: documents are upserted by id and deleted, in segments that are never changed.

    root/forward/segment=S    (doc_id, dl, terms): a segment's documents, in runs sorted by id; an id that the batch deletes has null dl and terms
    root/postings/segment=S   (bucket, term, doc_id, tf, dl) of some documents a file, each file sorted
    root/df/segment=S         (bucket, term, df) of the segment, each file sorted
    root/dead/by=S            (segment, doc_id): documents of older segments that segment S has replaced or deleted
    root/dead_df/by=S         (segment, bucket, term, df): what those take from the older segments' counts
    root/_live/000000000012   the manifest: live segments with their totals; the greatest number counts

An upsert deals the batch's texts by ranges of ids, the only time that they travel, and splits them where they then lie. Postings stay with their documents
and are sorted there. It writes a segment with the batch's documents, finds the ids in the older segments (their forward tables, sorted by id, are
pruned by the batch's range of ids), and writes what those lose. So documents, mean length and document frequencies are sums over
segments at any time, and nothing is rewritten. Segments of one tier are merged when there are enough of them, so that a search reads
a number of segments that grows with the logarithm of the index. A manifest is renamed into place after all tables are
written; it says which batch it holds, so a batch that a stream gives again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import words
from quarry.operators.retrieval import PREFETCH, _tasks, bm25_scores, small, term_bucket, term_counts, top
from quarry.plans.index import _fs, exists, read_text

LIVE = "_live"
#: Segments of a tier that are merged, and how many times larger the documents of the next tier are.
FAN = 4
#: Documents of the lowest tier.
TIER = 1000
#: Ids of a batch, and dead documents, that are broadcast at most.
BROADCAST_IDS = 2_000_000
#: Live documents that a task of a search scores, about: its sums for all queries fit in memory.
TASK_DOCS = 20_000
#: The segments' files are read and merged more often than they are written anew.
CODEC = "zstd"

SCHEMAS = {
    "forward": "doc_id {id}, dl long, terms array<struct<term: string, tf: long>>, segment string",
    "postings": "bucket int, term string, doc_id {id}, tf long, dl long, segment string",
    "df": "bucket int, term string, df long, segment string",
    "dead": "segment string, doc_id {id}, by string",
    "dead_df": "segment string, bucket int, term string, df long, by string",
}


@dataclass(frozen=True)
class Segment:
    name: str
    docs: int
    tokens: int
    dead_docs: int = 0
    dead_tokens: int = 0

    @property
    def live(self) -> int:
        return self.docs - self.dead_docs


@dataclass(frozen=True)
class Live:
    """A manifest: its number, the last batch it holds, the type of ids, its segments, oldest first, and which writers have
    buried documents of which of them (what a writer that failed has left is not named, and doesn't count)."""

    number: int
    batch: int
    id_type: str
    segments: tuple[Segment, ...]
    buried: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def docs(self) -> int:
        return sum(s.live for s in self.segments)

    @property
    def tokens(self) -> int:
        return sum(s.tokens - s.dead_tokens for s in self.segments)


# -- manifests ------------------------------------------------------------------------------------------------


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/{LIVE}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def manifest(spark: SparkSession, root: str) -> Live | None:
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    d = json.loads(read_text(spark, f"{root}/{LIVE}/{numbers[-1]:012d}"))
    return Live(numbers[-1], d["batch"], d["id_type"], tuple(Segment(**s) for s in d["segments"]), tuple((w, tuple(of)) for w, of in d["buried"]))


def _commit(spark: SparkSession, root: str, old: Live | None, batch: int, id_type: str, segments: list[Segment], buried: list[tuple[str, tuple[str, ...]]]) -> Live:
    """The next manifest, renamed into place; of two writers one fails. Burials in segments that are gone are left out."""
    number = old.number + 1 if old else 1
    names = {s.name for s in segments}
    buried = [(w, kept) for w, of in buried if (kept := tuple(s for s in of if s in names))]
    fs, p = _fs(spark, f"{root}/{LIVE}/{number:012d}")
    _, aside = _fs(spark, f"{root}/{LIVE}/.{number:012d}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"batch": batch, "id_type": id_type, "segments": [asdict(s) for s in segments], "buried": buried}).encode()))
    out.close()
    if fs.exists(p) or not fs.rename(aside, p):
        fs.delete(aside, False)
        raise RuntimeError("another writer has changed the index meanwhile")
    return Live(number, batch, id_type, tuple(segments), tuple(buried))


# -- tables ---------------------------------------------------------------------------------------------------


def table(spark: SparkSession, root: str, name: str, of: Live, segments: list[str] | None = None) -> DataFrame:
    """A table of the live segments, or of some of them. Only their folders are listed."""
    part = "by" if name.startswith("dead") else "segment"
    schema = SCHEMAS[name].format(id=of.id_type)
    wanted = [s.name for s in of.segments] if segments is None else segments
    paths = [p for s in wanted if exists(spark, p := f"{root}/{name}/{part}={s}")]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths)


def dead(spark: SparkSession, root: str, of: Live, name: str = "dead", segments: list[str] | None = None) -> DataFrame:
    """What the manifest's writers have taken from its segments. A merge drops the dead, so rows about segments that are gone don't count."""
    wanted = [s.name for s in of.segments] if segments is None else segments
    return table(spark, root, name, of, [w for w, _ in of.buried]).where(F.col("segment").isin(wanted))


def documents(spark: SparkSession, root: str, of: Live, segments: list[str] | None = None) -> DataFrame:
    """The forward rows of documents, without those that only say that an id is deleted."""
    return table(spark, root, "forward", of, segments).where(F.col("dl").isNotNull())


def _write(df: DataFrame, where: str) -> None:
    df.write.option("compression", CODEC).parquet(where)


def _frequencies(terms: DataFrame, *by: str) -> DataFrame:
    """(by..., bucket, term, df) of rows (by..., term); each file sorted, so that row groups and pages are skipped."""
    df = terms.groupBy(*by, "term").agg(F.count("*").alias("df"))
    return df.select(*by, term_bucket("term").alias("bucket"), "term", "df").sortWithinPartitions("bucket", "term")


def _write_segment(spark: SparkSession, root: str, name: str, forward: DataFrame) -> Segment:
    """forward (doc_id, dl, terms) as a new segment; its files are as the rows lie."""
    at = lambda t: f"{root}/{t}/segment={name}"
    _write(forward, at("forward"))
    stored = spark.read.schema(forward.schema).parquet(at("forward")).where(F.col("dl").isNotNull())
    n, size = stored.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    p = stored.select("doc_id", "dl", F.explode("terms").alias("t")).select(term_bucket("t.term").alias("bucket"), "t.term", "doc_id", "t.tf", "dl")
    # each file has the postings of some documents: no exchange, and a term that stands everywhere is in all of them
    _write(p.sortWithinPartitions("bucket", "term", "doc_id"), at("postings"))
    _write(_frequencies(stored.select(F.explode("terms.term").alias("term"))), at("df"))
    return Segment(name, n, size)


def _new_name(batch: int) -> str:
    return f"s{max(batch, 0):09d}-{uuid.uuid4().hex[:12]}"


def forward_of(latest: DataFrame) -> DataFrame:
    """(doc_id, dl, terms) of rows (doc_id, text, gone), one of each id; null dl and terms where gone."""
    t = latest.select("doc_id", F.when(~F.col("gone"), words("text")).alias("tokens"))
    t = t.withColumn("dl", F.when(F.col("tokens").isNotNull(), F.size("tokens")).cast("long"))
    return term_counts(t)


def upsert(spark: SparkSession, root: str, rows: DataFrame, *, batch: int | None = None, doc_id: str = "doc_id", text: str = "text", version: str | None = None, deleted: str | None = None) -> Live:
    """The index after these documents have replaced those of the same ids; where ``deleted`` is true the id goes.

    Of rows with one id the one with the greatest version counts (ties, and rows without a version: the greatest text). Rows without an id are left out. A
    batch number that the index holds already changes nothing.
    """
    old = manifest(spark, root)
    if old and batch is not None and batch <= old.batch:
        return old
    number = batch if batch is not None else (old.batch + 1 if old else 0)
    id_type = rows.schema[doc_id].dataType.simpleString()
    if old and old.id_type != id_type:
        raise ValueError(f"the index has ids of type {old.id_type}, not {id_type}")
    name = _new_name(number)
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    last = F.struct(*([F.col(version)] if version else []), F.coalesce(F.col(text), F.lit("")))
    given = rows.where(F.col(doc_id).isNotNull()).withColumns({"__id": F.col(doc_id), "__text": F.col(text), "__gone": gone, "__last": last})
    given = given.select(F.col("__id").alias("doc_id"), "__text", "__gone", "__last").repartitionByRange("doc_id")  # the grouping needs no other exchange
    latest = given.groupBy("doc_id").agg(F.max_by(F.struct(F.col("__text").alias("text"), F.col("__gone").alias("gone")), "__last").alias("d"))
    forward = forward_of(latest.select("doc_id", "d.*").sortWithinPartitions("doc_id"))
    segment = _write_segment(spark, root, name, forward)
    stored = spark.read.schema(forward.schema).parquet(f"{root}/forward/segment={name}")  # its ids, deleted ones too, are what the older segments lose
    segments, buried = _bury(spark, root, old, name, stored.select("doc_id")) if old else ([], [])
    return _commit(spark, root, old, number, id_type, [s for s in [*segments, segment] if s.live], buried)


def _bury(spark: SparkSession, root: str, old: Live, name: str, ids: DataFrame) -> tuple[list[Segment], list[tuple[str, tuple[str, ...]]]]:
    """Write what the older segments lose to these ids; the segments with their new totals, and all burials."""
    lo, hi, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    near = F.broadcast if n <= BROADCAST_IDS else lambda df: df
    found = documents(spark, root, old).where(F.col("doc_id").between(lo, hi)).join(near(ids), "doc_id", "left_semi")
    known = dead(spark, root, old).select("segment", "doc_id")
    found = found.join(known, ["segment", "doc_id"], "left_anti").select("segment", "doc_id", "dl", "terms")
    at = f"{root}/lost/by={name}"
    _write(found, at)
    lost = spark.read.schema(found.schema).parquet(at)
    lost.select("segment", "doc_id").write.parquet(f"{root}/dead/by={name}")
    _write(_frequencies(lost.select("segment", F.explode("terms.term").alias("term")), "segment"), f"{root}/dead_df/by={name}")
    taken = {r.segment: (r.n, r.size) for r in lost.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("size")).collect()}  # a row for each segment
    left = [Segment(s.name, s.docs, s.tokens, s.dead_docs + taken.get(s.name, (0, 0))[0], s.dead_tokens + taken.get(s.name, (0, 0))[1]) for s in old.segments]
    return left, [*old.buried, (name, tuple(sorted(taken)))]


def tier(s: Segment) -> int:
    """Which tier a segment is of, by its live documents."""
    t, most = 0, TIER
    while s.live > most:
        t, most = t + 1, most * FAN
    return t


def merge(spark: SparkSession, root: str, *, fan: int = FAN) -> Live | None:
    """Merge the lowest tier that has ``fan`` segments, until none has; the dead go. Readers of older manifests keep their files."""
    while True:
        now = manifest(spark, root)
        by: dict[int, list[Segment]] = {}
        for s in now.segments if now else ():
            by.setdefault(tier(s), []).append(s)
        full = [t for t in sorted(by) if len(by[t]) >= fan]
        if not full:
            return now
        names = [s.name for s in by[full[0]]]
        rows = documents(spark, root, now, names).join(dead(spark, root, now, segments=names).select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")
        # an id lives in one segment only, so the order of segments doesn't matter to a search
        merged = _write_segment(spark, root, _new_name(now.batch), rows.select("doc_id", "dl", "terms"))
        first = next(i for i, s in enumerate(now.segments) if s.name in names)
        kept = [s for s in now.segments if s.name not in names]
        _commit(spark, root, now, now.batch, now.id_type, [*kept[:first], merged, *kept[first:]], list(now.buried))


def search(spark: SparkSession, root: str, terms: DataFrame, *, k: int = PREFETCH, live: Live | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the live documents, as an index built anew of them would give."""
    of = live or manifest(spark, root)
    few = small(terms)
    near = F.broadcast if few else lambda df: df
    wanted = sorted(r.b for r in terms.select(term_bucket("term").alias("b")).distinct().collect())  # TERM_BUCKETS numbers at most
    asked = near(terms.select("term").distinct())
    own = lambda df: df.where(F.col("bucket").isin(wanted)).join(asked, "term", "left_semi")
    buried = dead(spark, root, of).select("segment", "doc_id")
    buried = F.broadcast(buried) if sum(s.dead_docs for s in of.segments) <= BROADCAST_IDS else buried
    hit = own(table(spark, root, "postings", of)).join(buried, ["segment", "doc_id"], "left_anti")
    if few:
        # each posting travels once, before it meets all queries that have its term, and a document's scores are summed where it is
        hit = hit.select("term", "doc_id", "tf", "dl").repartition(max(_tasks(spark), of.docs // TASK_DOCS), "doc_id")
    counts = own(table(spark, root, "df", of)).select("term", "df").unionByName(own(dead(spark, root, of, "dead_df")).select("term", (-F.col("df")).alias("df")))
    df = counts.groupBy("term").agg(F.sum("df").alias("df"))
    stats = spark.createDataFrame([(of.docs, of.tokens / of.docs if of.docs else 0.0)], "n long, avgdl double")
    scores = bm25_scores(hit.join(near(terms.join(df, "term")), "term"), stats).withColumn("score", F.round("score", 6))
    return top(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def vacuum(spark: SparkSession, root: str, *, keep: int = 2) -> list[str]:
    """Delete the files of segments that the last ``keep`` manifests don't name, and older manifests. Returns the segments deleted."""
    numbers = _numbers(spark, root)
    named: set[str] = set()
    for n in numbers[-keep:]:
        named |= {s["name"] for s in json.loads(read_text(spark, f"{root}/{LIVE}/{n:012d}"))["segments"]}
    gone = set()
    for t in ("forward", "postings", "df"):
        fs, p = _fs(spark, f"{root}/{t}")
        for s in fs.listStatus(p) if fs.exists(p) else ():
            if (name := s.getPath().getName().removeprefix("segment=")) not in named:
                fs.delete(s.getPath(), True)
                gone.add(name)
    for t in ("batch", "lost"):  # batch: of indexes that were written before
        fs, p = _fs(spark, f"{root}/{t}")
        if fs.exists(p):
            fs.delete(p, True)
    for n in numbers[:-keep]:
        fs, p = _fs(spark, f"{root}/{LIVE}/{n:012d}")
        fs.delete(p, False)
    return sorted(gone)

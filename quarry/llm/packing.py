"""Best-fit packing of tokenised documents into sequences, after a dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a table of counts by length, whatever the corpus. The reduction
of Martello and Toth takes the lengths from the largest down: if a set with one such document is as good as any other set that
could hold it (it dominates them), some best packing has that set as a sequence, and it is fixed for as many documents as there are.
Sets of up to three documents are looked at. What is left is packed by best fit, largest first. Both work on counts, so a step
handles all documents of a length.

Plan: one pass encodes the texts, cuts them into pieces and numbers the pieces of each length within its task; the pieces
are saved. Counts by task and length have map-side combine. Sums of them give each piece its number among all of its
length, without a sort, so that a length that a third of all documents have is no task's burden. The driver gets the counts by length, and
makes a table of which numbers of a length go to which sequences; both are bounded by the capacity.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import arrow_types, bounded_batches, clear_of, lean, save
from quarry.llm.token_counts import PATTERN, ranks_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 1024
#: The id that ends a document.
END = 2
#: Rows of counts by task and length that are broadcast at most.
BROADCAST_COUNTS = 200_000

#: A sequence's content: (length, how many of it), largest first.
Content = tuple[tuple[int, int], ...]


# -- the instance, as counts by length ------------------------------------------------------------------------


def _smallest(counts: Counter, sizes: list[int], without: int, least: int = 1) -> list[int]:
    """Up to three smallest lengths of at least ``least``, one copy of ``without`` left out; ``sizes`` ascend."""
    out: list[int] = []
    for s in sizes:
        if s >= least:
            out += [s] * min(3, counts[s] - (s == without))
            if len(out) >= 3:
                break
    return out[:3]


def dominant(counts: Counter, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a document of length j that dominates every other set with it; None if none of up to three is known to."""
    sizes = sorted(s for s in counts if counts[s] > (s == j))  # lengths beside one document of length j
    room = capacity - j
    low = _smallest(counts, sizes, j)
    fits = sum(sum(low[: k + 1]) <= room for k in range(len(low)))
    if not fits:
        return (j,)
    most = max(s for s in sizes if s <= room)
    if fits == 1 or most == room:
        return (j, most)
    if fits > 2:
        return None
    # at most two others fit: the pair with the largest sum
    best, a, b = 0, 0, 0
    lo, hi = 0, len(sizes) - 1
    while lo <= hi:
        s, t = sizes[lo], sizes[hi]
        if s + t > room or lo == hi and counts[s] - (s == j) < 2:
            hi -= 1
            continue
        if s + t > best:
            best, a, b = s + t, t, s
        lo += 1
    if most >= best:
        return (j, most)
    if a == most:
        # a pair escapes domination only if both are longer than b, beside one a
        del_a = counts.copy()
        del_a[a] -= 1
        over = _smallest(del_a, [s for s in sizes if s <= most], j, b + 1)
        if len(over) < 2 or over[0] + over[1] > room:
            return (j, a, b)
    return None


def reduced(counts: Counter, capacity: int) -> tuple[list[tuple[Content, int]], Counter]:
    """The sequences that dominance fixes, as (content, how many), and the counts that are left."""
    left, fixed = Counter({s: n for s, n in counts.items() if n}), []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left[j] and (found := dominant(left, j, capacity)):
                need = Counter(found)
                # of a set alone, all copies; removals only make other sets smaller, so the set dominates as long as there are copies
                times = min(left[s] // n for s, n in need.items())
                for s, n in need.items():
                    left[s] -= n * times
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                changed = True
        left = +left
    return fixed, left


def best_fit(counts: Counter, capacity: int) -> list[tuple[Content, int]]:
    """Best fit with decreasing lengths, all documents of a length at once: (content, how many sequences)."""
    classes: dict[int, list[tuple[Content, int]]] = {}  # by what is left of a sequence
    for s in sorted(counts, reverse=True):
        n = counts[s]
        for room in sorted(r for r in classes if r >= s):
            if not n:
                break
            per, kept = room // s, []
            for content, times in classes.pop(room):
                full = min(times, n // per)
                if full:
                    classes.setdefault(room - per * s, []).append(((*content, (s, per)), full))
                    n, times = n - per * full, times - full
                if times and 0 < n < per:
                    classes.setdefault(room - n * s, []).append(((*content, (s, n)), 1))
                    n, times = 0, times - 1
                if times:
                    kept.append((content, times))
            if kept:
                classes.setdefault(room, []).extend(kept)
        per = capacity // s
        if n >= per:
            classes.setdefault(capacity - per * s, []).append((((s, per),), n // per))
        if n % per:
            classes.setdefault(capacity - n % per * s, []).append((((s, n % per),), 1))
    return [x for xs in classes.values() for x in xs]


def packed(counts: Counter, capacity: int) -> list[tuple[Content, int]]:
    """All sequences of an instance: those fixed by dominance, then best fit for the rest."""
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(sequences: list[tuple[Content, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, until, per, sequence, offset): pieces first..until-1 of a length go, ``per`` each, to sequences from that number on."""
    used: Counter = Counter()
    out, number = [], 0
    for content, times in sequences:
        offset = 0
        for s, per in content:
            out.append((s, used[s], used[s] + per * times, per, number, offset))
            used[s] += per * times
            offset += s * per
        number += times
    return out


# -- the documents --------------------------------------------------------------------------------------------


def encoder_of(vocabulary: bytes):
    """The tokenizer of a byte-level BPE file, from its vocabulary: ids are ranks, and added tokens are found in texts."""
    import tiktoken

    spec = json.loads(vocabulary)
    # a byte is written as itself if it is printable, else as the next code point from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: own.encode(text, allowed_special="all")


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else the odd piece first."""
    first = length if length <= capacity else length % capacity
    bounds = [*([0] if first else []), *range(first, length + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def pieces(docs: DataFrame, *, text: str, keep: dict[str, str], tokenizer: str, end: int, capacity: int, with_ids: bool) -> DataFrame:
    """The pieces of all documents (the columns ``keep`` under new names), with the task that made them and their number among its pieces of that length."""
    data = docs.sparkSession.sparkContext.broadcast(ranks_of(tokenizer))  # one vocabulary: two megabytes, whatever the corpus
    own = T._parse_datatype_string("piece int, start long, length int, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids)
    rows = docs.select(*(docs[c].alias(k) for c, k in keep.items()), docs[text].alias("text"))
    at = len(keep)
    kinds = arrow_types(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encode, task, seen = encoder_of(data.value), TaskContext.get().partitionId(), Counter()
        for b in batches:
            of, found = [], []
            for i, t in enumerate(b.column(at).to_pylist()):
                ids = np.array([*encode(t or ""), end], "<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + n]
                    of.append(i)
                    found.append((k, start, n, zlib.crc32(part.tobytes()), task, seen[n], *([part.tolist()] if with_ids else [])))
                    seen[n] += 1
            columns = list(zip(*found)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of, pa.int64())) for c in range(at)), *(pa.array(v, k) for v, k in zip(columns, kinds))], names=[*keep.values(), *own.names])

    return bounded_batches(rows).mapInArrow(run, T.StructType([*rows.schema.fields[:at], *own.fields]))


def pack(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: the columns ``keep``, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    Documents of more than ``capacity`` tokens, the end id included, are cut. Pieces of a sequence lie one behind the other from
    offset 0 on. Null text: empty, which is the end id alone. Null ids and repeated rows are documents like any other; an empty table gives an
    empty result. A kept column whose name is a result's gets underscores at its end. Which of equally long pieces meet depends on
    the order of the input's files; their number of sequences doesn't.
    """
    names = clear_of(list(keep), ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])
    kept = {c: f"k{i}" for i, c in enumerate(keep)}
    cut = save(pieces(docs, text=text, keep=kept, tokenizer=tokenizer, end=end, capacity=capacity, with_ids=with_ids))
    counts = save(cut.groupBy("length", "task").agg(F.count("*").alias("here")), compact=True)
    spark = docs.sparkSession
    instance = Counter({r.length: r.n for r in counts.groupBy("length").agg(F.sum("here").alias("n")).collect()})  # a row for each length
    plan = spark.createDataFrame(places(packed(instance, capacity)), "length int, first long, until long, per long, number long, offset int")
    before = F.sum("here").over(Window.partitionBy("length").orderBy("task")) - F.col("here")
    counts = counts.select("length", "task", before.alias("before"))
    if counts.count() <= BROADCAST_COUNTS:
        counts = F.broadcast(counts)
    rank = F.col("before") + F.col("nth")
    placed = cut.join(counts, ["length", "task"]).withColumn("nth", rank).drop("before", "task")
    of = F.col("nth") - F.col("first")
    plan = plan.withColumnRenamed("length", "of_length")
    placed = placed.join(F.broadcast(plan), (F.col("length") == F.col("of_length")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("until")))
    sequence = F.col("number") + F.floor(of / F.col("per"))
    offset = F.col("offset") + F.col("length") * (of % F.col("per"))
    return placed.select(*(F.col(k).alias(names[c]) for c, k in kept.items()), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", sequence.alias("sequence_id"), offset.cast("long").alias("offset"), *(["ids"] if with_ids else []))

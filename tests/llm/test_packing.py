"""Packing: the reduction against the best packing of small instances, and every document in its place."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing
from quarry.llm.packing import CAPACITY, END, TOKENIZER, best_fit, cuts, dominant, encoder_of, pack, packed, places, reduced
from quarry.llm.token_counts import ranks_of


def fewest(items, capacity):
    """The least number of sequences, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            k = rooms.index(r)
            go(i + 1, rooms[:k] + (r - items[i],) + rooms[k + 1 :])
        go(i + 1, (*rooms, capacity - items[i]))

    go(0, ())
    return best[0]


def test_reduction_loses_nothing():
    rng, fixed_sets = random.Random(1), Counter()
    for _ in range(1200):
        capacity = rng.choice([10, 20, 30, 50])
        least = max(1, rng.choice([1, capacity // 5, capacity // 4, capacity // 3]))
        items = [rng.randint(least, capacity) for _ in range(rng.randint(1, 10))]
        fixed, left = reduced(Counter(items), capacity)
        taken = Counter()
        for content, times in fixed:
            assert sum(s * n for s, n in content) <= capacity
            fixed_sets[sum(n for _, n in content)] += times
            for s, n in content:
                taken[s] += n * times
        assert taken + left == Counter(items)
        assert sum(n for _, n in fixed) + fewest(list(left.elements()), capacity) == fewest(items, capacity), (items, capacity)
    assert all(fixed_sets[n] > 20 for n in (1, 2, 3)), fixed_sets


def test_dominant_sets():
    of = lambda items, j: dominant(Counter(items), j, 10)
    assert of([10, 3], 10) == (10,) and of([7, 4, 4], 7) == (7,)
    assert of([7, 3, 2, 1], 7) == (7, 3)  # fills the sequence
    assert of([6, 3, 2], 6) == (6, 3)  # only one more fits
    assert of([5, 4, 2, 2], 5) == (5, 4)  # as long as the best pair
    assert of([4, 4, 2, 2], 4) == (4, 4, 2)
    assert of([3, 1, 1, 1, 2], 3) is None


def test_best_fit_is_the_plain_algorithm():
    rng = random.Random(2)
    for _ in range(400):
        capacity = rng.randint(5, 60)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 60))), reverse=True)
        rooms = []
        for s in items:
            fit = min((r for r in rooms if r >= s), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((capacity if fit is None else fit) - s)
        got = best_fit(Counter(items), capacity)
        assert Counter({}) + Counter(rooms) == sum((Counter({capacity - sum(s * n for s, n in c): t}) for c, t in got), Counter())


def test_counts_of_any_size():
    rng = random.Random(3)
    counts = Counter({s: rng.randint(1, 10**9) for s in rng.sample(range(1, 1025), 700)})
    sequences = packed(counts, 1024)
    used = Counter()
    for s, first, until, per, _, _ in places(sequences):
        assert first == used[s] and (until - first) % per == 0
        used[s] = until
    assert used == counts
    total, number = sum(s * n for s, n in counts.items()), sum(t for _, t in sequences)
    assert total <= number * 1024 < 1.02 * max(total, 1024 * sum(n for s, n in counts.items() if s > 512)) and len(places(sequences)) < 20_000


def test_cuts():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)] and cuts(5, 4) == [(0, 1), (1, 4)] and cuts(8, 4) == [(0, 4), (4, 4)] and cuts(11, 4) == [(0, 3), (3, 4), (7, 4)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def checked(out, docs, capacity=CAPACITY):
    """Every piece against the library's ids; every sequence without gaps. Returns the number of sequences."""
    lib, rows = library(), docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, END]
        n = len(ids)
        first = n if n <= capacity else n % capacity or capacity
        start, k = 0, 0
        while start < n:
            length = first if start == 0 else capacity
            want[r.doc_id, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            start, k = start + length, k + 1
    got = out.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents(spark, docs):
    n = checked(pack(docs), docs)
    total = sum(r.length for r in pack(docs).select("length").collect())
    assert n <= 1.005 * -(-total // CAPACITY)


@pytest.mark.parametrize("capacity", [3, 64])
def test_edges(spark, edge, none, capacity):
    assert pack(none).collect() == []
    checked(pack(edge, capacity=capacity), edge, capacity)
    d = edge.withColumns({"length": F.lit("x"), "task": F.lit("y"), "first": F.lit(7), "__length": F.lit(1)})
    out = pack(d, keep=tuple(d.columns), with_ids=True)
    assert {"length_", "task", "first"} <= set(out.columns) and all(r.length_ == "x" and r.task == "y" and len(r.ids) == r.length for r in out.collect())


def test_a_length_that_many_documents_have(spark, monkeypatch):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"w{i} " * (i % 50)) for i in range(900)], "doc_id long, text string").repartition(7)
    a = checked(pack(df), df)
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", -1)
    assert checked(pack(df.repartition(3)), df) == a


def test_encoder_is_the_library():
    lib, own = library(), encoder_of(ranks_of(TOKENIZER))
    rng = random.Random(4)
    texts = ["", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "é漢😀 \n\n  x\t\t1,000.5 it's I'LL\x00\x1f", *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(300))]
    for t in texts:
        assert own(t) == lib.encode(t, add_special_tokens=False).ids, t

"""Fingerprints, Golay keys, components, near copies and top-k search against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm.buckets import bucket_pairs, components
from quarry.llm.near_copies import drop_near_copies, near_copies
from quarry.llm.simhash import Golay, close, golay_keys, keys_of, simhash_components
from quarry.llm.topk_search import topk_search


def find_roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_pairs(fps, most=4):
    a = np.array(fps, np.uint64)
    d = np.bitwise_count(a[:, None] ^ a[None, :])
    return [(fps[i], fps[j]) for i, j in zip(*np.nonzero(d <= most)) if i < j]


def test_golay_tables_and_guarantee():
    golay, rng = Golay(), np.random.default_rng(0)
    assert sorted(Counter((golay.patterns >= 0).sum(1)).items()) == [(1, 277), (6, 1771)]
    for flips in range(5):
        a = rng.integers(-(2**63), 2**63, 3000)
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, flips, replace=False):
                b[i] ^= np.int64(np.uint64(1) << np.uint64(bit))
        keys = []
        for x in (a, b):
            own = [set() for _ in a]
            for r, k in zip(*(y.tolist() for y in keys_of(x, golay))):
                own[r].add(k)
            keys.append(own)
        assert all(x & y for x, y in zip(*keys))


def graph(seed):
    rng = random.Random(seed)
    return [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)]


def test_components(spark, monkeypatch):
    from quarry.llm import buckets

    pairs = graph(2)
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = find_roots({x for p in pairs for x in p}, pairs)
    for most in (buckets.COMPONENT_ROWS, -1):
        monkeypatch.setattr(buckets, "COMPONENT_ROWS", most)
        assert {r.node: r.root for r in components(edges).collect()} == want
        assert components(edges.limit(0)).count() == 0


def clusters(seed, groups=4, members=150, bits=12):
    """Clusters far denser than a bucket's first member can settle, chains, and lone values."""
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(groups):
        base = rng.getrandbits(64)
        own = rng.sample(range(64), bits)
        fps |= {base ^ sum(1 << b for b in rng.sample(own, rng.randrange(7))) for _ in range(members)}
    return [x - (1 << 64) if x >> 63 else x for x in fps]


def test_dense_clusters(spark):
    fps = clusters(4)
    u = [x & (2**64 - 1) for x in fps]
    of = find_roots(u, near_pairs(u))
    want = {n: r for n, r in of.items() if list(of.values()).count(r) > 1}
    nodes = spark.createDataFrame([(x,) for x in fps], "node long")
    for part in (4096, 16, 3):  # whole buckets, and buckets in parts
        links = bucket_pairs(golay_keys(nodes), close, true=True, part=part)
        pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links.collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        assert find_roots({x for p in pairs for x in p}, pairs) == want and len(set(want.values())) >= 4


def test_links_grow_with_members_only(spark):
    """What leaves the workers for a group of near copies: links, in proportion to its members."""
    seen = {}
    for n in (300, 600, 1200):
        nodes = spark.createDataFrame([(x,) for x in clusters(9, 1, n, 16)], "node long")
        seen[n] = (nodes.count(), bucket_pairs(golay_keys(nodes), close, true=True).count(), golay_keys(nodes).groupBy("key").count().agg(F.max("count")).first()[0])
    print("members, links, largest bucket:", seen)
    assert all(links < 4 * members for members, links, _ in seen.values()) and seen[1200][2] > 100


def test_all_pairs_of_other_roots(spark):
    """Not links but all matches: pairs of different roots only, the same from whole buckets and from parts."""
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, rng.randrange(6), rng.randrange(40)) for i in range(200)]
    match = lambda x, y: (x[1] != y[1]) & (np.abs(x[2] - y[2]) <= 3)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and abs(a[3] - b[3]) <= 3}
    df = spark.createDataFrame(rows, "key long, node long, root long, at long")
    for part in (4096, 20, 7):
        got = [tuple(r) for r in bucket_pairs(df, match, true=False, part=part).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_simhash_query(docs, edge, none):
    for df in (docs, edge):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
        fps = sorted({f for _, f in rows})
        root = find_roots(fps, near_pairs(fps))
        least = {}
        for i, f in rows:
            if i is not None:
                least[root[f]] = min(i, least.get(root[f], i))
        want = Counter((i, f"{f:016x}", least.get(root[f])) for i, f in rows)
        assert Counter(map(tuple, simhash_components(df).collect())) == want
    assert simhash_components(none).count() == 0


def shingle_set(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def planted(spark, n=60, seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows, i = [], 0
    for _ in range(n):
        w = [word() for _ in range(rng.randrange(80, 400))]
        rows.append((i, " ".join(w)))
        i += 1
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(0, max(1, len(v) // 60))):
                v[rng.randrange(len(v))] = word()
            rows.append((i, " ".join(v)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_near_copies(spark, edge, none):
    rows = planted(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jac(a, b) >= 0.8]
    root = find_roots(ids, pairs)
    kept = {r.doc_id for r in drop_near_copies(df).collect()}
    want = set(root.values())
    assert want <= kept and len(kept - want) <= 0.03 * (len(rows) - len(want)), (len(want), len(kept))
    assert drop_near_copies(edge).count() == edge.select("text").fillna("").distinct().count() - 1  # null, '' and white space are one
    assert drop_near_copies(edge).columns == edge.columns and drop_near_copies(none).count() == 0


def with_blocks(word, n, seed):
    """Texts, and copies with a block of new words appended, inserted or put before, or with a block cut, at similarities around 0.8 to 0.95."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        w = [word(rng) for _ in range(rng.randrange(300, 1000))]
        rows.append(w)
        for j in (0.8, 0.81, 0.87, 0.95):
            m, at = int(len(w) * (1 / j - 1)), rng.randrange(len(w))
            block = ["".join(rng.choice("klmnop") for _ in range(9)) for _ in range(m)]
            rows += [w + block, block + w, w[:at] + block + w[at:], w[: int(len(w) * j)], w[int(len(w) * (1 - j)) :]]
    # copies of one text would be linked by one another: a text and one of them at a time
    out, at = [], 0
    for k in range(0, len(rows), 21):
        for v in rows[k + 1 : k + 21]:
            mark = {x: f"{x}{at}" for x in rows[k]}
            out += [(at, " ".join(mark[x] for x in rows[k])), (at + 1, " ".join(mark.get(x, x) for x in v))]
            at += 2
    return out


def with_few_words(n, seed):
    """Pairs of a text of 1000 words out of 100 and the same with 240 new words: similarity 0.806, but most of the words are new."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = [f"{k}x{i}" for i in range(100)]
        w = [rng.choice(own) for _ in range(1000)]
        block = [f"{k}y{i}" for i in range(240)]
        out += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + block))]
    return out


def kept_by_brute_force(rows):
    """Of pairs (2k, 2k + 1) of texts: the ids that stay."""
    sets = [shingle_set(t) for _, t in rows]
    return {i for i, s in enumerate(sets) if i % 2 == 0 or len(s & sets[i - 1]) < 0.8 * len(s | sets[i - 1])}


def test_near_copies_with_blocks(spark):
    rows = with_blocks(lambda rng: "".join(rng.choice("abcdefghij") for _ in range(8)), 8, 11)
    want = kept_by_brute_force(rows)
    assert {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert 0.2 * len(rows) < len(rows) - len(want)


def edits_of(rng, w, kind, share):
    n, at = max(1, int(share * len(w))), rng.randrange(len(w))
    new = lambda k: [f"n{rng.randrange(10**6)}" for _ in range(k)]
    if kind == "words":
        v = list(w)
        for i in rng.sample(range(len(w)), max(1, n // 5)):
            v[i] = new(1)[0]
        return v
    if kind == "cut":
        return w[:at] + w[at + n :]
    return w[:at] + new(n) + w[at:]


def test_near_copies_by_band(spark):
    """2000 documents, short ones and long ones, with words changed, blocks cut and inserted: every pair of 0.8 or more is found, in each band."""
    rng = random.Random(21)
    rows = []
    while len(rows) < 2000:
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 12, 40, 150, 500]))]
        group = [w] + [edits_of(rng, w, rng.choice(["words", "cut", "insert"]), rng.uniform(0.01, 0.25)) for _ in range(rng.randrange(5))]
        rows += [(len(rows) + i, " ".join(v)) for i, v in enumerate(group)]
    sets = {i: shingle_set(t) for i, t in rows}
    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    common = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    bands, pairs = Counter(), []
    for (a, b), n in common.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        if j >= 0.8:
            pairs.append((a, b))
            bands[min(int(j * 20) / 20, 0.9), min(len(sets[a]), len(sets[b])) < 20] += 1
    assert all(bands[x, short] > 20 for x in (0.8, 0.85, 0.9) for short in (False,)) and bands[0.8, True] + bands[0.85, True] + bands[0.9, True] > 20, bands
    texts, classes = near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    first = {r.node: r["first"] for r in texts.collect()}
    got = {}
    for r in classes.collect():
        got.setdefault(r.root, set()).add(first[r.node])
    of = find_roots(sets, pairs)
    want = {}
    for i, r in of.items():
        want.setdefault(r, set()).add(i)
    alike = {}  # copies of one text are one node, named by its smallest id
    for i, t in rows:
        alike.setdefault(t, i)
    names = dict(rows)
    want = {frozenset(alike[names[i]] for i in own) for own in want.values()}
    assert {frozenset(x) for x in got.values()} == {x for x in want if len(x) > 1}


def test_near_copies_of_few_words(spark):
    rows = with_few_words(40, 12)
    want = kept_by_brute_force(rows)
    assert want == set(range(0, 80, 2))
    assert {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_prefixes_of_near_sets_meet():
    from quarry.llm.near_copies import prefix

    rng = np.random.default_rng(5)
    common = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    counts = rng.integers(2, 50, len(common))
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        both = np.unique(np.concatenate([rng.choice(common, n // 2), rng.integers(0, 2**64, n - n // 2, dtype=np.uint64)]))
        more = rng.integers(0, 2**64, int(len(both) / 0.8) - len(both), dtype=np.uint64)
        cut = int(rng.integers(0, len(more) + 1))
        a, b = (np.unique(np.concatenate([both, x])) for x in (more[:cut], more[cut:]))
        assert np.intersect1d(*(prefix(x, 0.8, common, counts) for x in (a, b))).size


def test_near_copies_without_broadcast(spark, edge, monkeypatch):
    from quarry.llm import buckets, near_copies as n

    df = spark.createDataFrame(planted(spark, 15), "doc_id long, text string")
    want = [sorted(map(str, drop_near_copies(x).collect())) for x in (df, edge)]
    monkeypatch.setattr(n, "BROADCAST_TEXTS", -1)
    monkeypatch.setattr(buckets, "BROADCAST_ROOTS", -1)
    monkeypatch.setattr(buckets, "COMPONENT_ROWS", -1)
    assert [sorted(map(str, drop_near_copies(x).collect())) for x in (df, edge)] == want


def test_hubs_of_large_buckets(spark):
    """The same hub for a bucket that comes in parts."""
    from quarry.llm.near_copies import hub_pairs

    rng = random.Random(6)
    rows = [(k, 1000 * k + i, rng.randrange(5) << 32 | rng.randrange(90, 110)) for k in range(3) for i in range((1, 2, 60)[k])]
    df = spark.createDataFrame(rows, "key long, node long, at long")
    whole, parts = hub_pairs(df, 0.8), hub_pairs(df, 0.8, part=7)
    assert {tuple(r) for r in whole[2].collect()} == {tuple(r) for r in parts[2].collect()} == {(*r, r[0] == 2) for r in rows if r[0]}
    hub = min(rows[3:], key=lambda r: r[2])[1]
    of = lambda x: {tuple(sorted(r)) for r in x[1].collect() if hub in tuple(r)}
    assert of(whole) == of(parts) and len(of(whole)) > 30


@pytest.mark.parametrize("n", [300, 900])
def test_near_copies_of_templates(spark, monkeypatch, n):
    """Texts that keep 16 of 24 sentences share much with all others; few pairs leave the buckets, and all near ones are found."""
    from quarry.llm import near_copies as module

    rng = random.Random(n)
    sentences = [" ".join(f"s{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 14))) + "." for k in range(24)]
    rows = [(i, " ".join(sentences[k] for k in sorted(rng.sample(range(24), 16)))) for i in range(n)]
    own = [np.array(sorted({hash(tuple(t.split()[i : i + 5])) for i in range(len(t.split()) - 4)})) for _, t in rows]
    near = [(i, j) for i in range(n) for j in range(i) if 1.8 * (k := len(np.intersect1d(own[i], own[j], assume_unique=True))) >= 0.8 * (len(own[i]) + len(own[j])) - 1e-9]
    rest, plain = [], module.rest_pairs
    monkeypatch.setattr(module, "rest_pairs", lambda *a: rest.append(plain(*a)) or rest[-1].cache())
    counts = []
    monkeypatch.setattr(module, "forget", lambda *saved: counts.extend(r.count() for r in rest if any(r is s for s in saved)) or None)
    roots = find_roots(range(n), near)
    kept = {i for i, r in roots.items() if i == min(x for x in roots if roots[x] == r)}
    got = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept
    print(f"{n} texts: {n * (n - 1) // 2} pairs, {counts[0]} leave the buckets, {len(near)} are near")
    assert counts[0] < 20 * n


def test_near_copies_keeps_different(docs):
    texts, classes = near_copies(docs)
    body = {r.node: r.text for r in texts.join(docs, texts["first"] == docs.doc_id).select("node", "text").collect()}
    groups = {}
    for r in classes.collect():
        groups.setdefault(r.root, []).append(shingle_set(body[r.node]))
    for own in groups.values():  # every member is near another one
        assert all(max(len(a & b) / max(1, len(a | b)) for b in own if b is not a) >= 0.8 for a in own)


def brute_topk(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(ok) if m != n and len(w) == len(v))[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return Counter(out)


def test_topk(spark, monkeypatch):
    from quarry.llm import topk_search as t

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(50, rows[3][1]), (50, rows[50][1])]  # ties, repeated ids
    rows += [(600, None), (650, [None] * 8), (700, [float("nan")] * 8), (750, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (800, []), (801, []), (850, [1.0, 2.0]), (851, [0.5, -1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, block string")
    for sizes in ((4096, 512, 32, 64), (50, 3, 6, 4)):
        for name, x in zip(("BLOCK", "QUERIES", "PIVOTS", "CHUNK"), sizes):
            monkeypatch.setattr(t, name, x)
        assert Counter(map(tuple, topk_search(df, is_query=F.col("vec_id") % 50 == 0).collect())) == brute_topk(rows)
    assert topk_search(df.limit(0), is_query=F.col("vec_id") % 50 == 0).count() == 0


def test_sketches():
    from quarry.llm.near_copies import most_common, sketch

    rng = np.random.default_rng(1)
    for k in range(600):
        n = int(rng.integers(1, 600))
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        if k % 3 == 0:
            both >>= np.uint64(int(rng.integers(0, 12)))  # crowded: counts beyond what a sketch can say
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, int(rng.integers(0, 2 * n)), dtype=np.uint64)])) for _ in range(2))
        assert len(np.intersect1d(a, b)) <= most_common(sketch(a), sketch(b), len(a), len(b)) <= min(len(a), len(b))
    a, b = (np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(2))
    assert most_common(sketch(a), sketch(b), 500, 500) < 350 and sketch(a[:0]) == b"" and most_common(b"", sketch(a), 0, 500) == 0

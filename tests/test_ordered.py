"""As-of joins, frames, running totals, interval joins and grouping sets against plain readings; hot keys are many tasks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import grouping, intervals, ordered

CONF = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as large ones would have."""
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(rng, n, times=60):
    """(key, time, value, id): a hot key, a null key, null times, ties."""
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None, "only"])
    return [(key(), None if rng.random() < 0.03 else rng.randrange(times), None if rng.random() < 0.1 else rng.randrange(100), i) for i in range(n)]


def as_of(left, right, tolerance=None):
    out = []
    for k, t, v, i in left:
        best = max(((rt, ri, rv) for rk, rt, rv, ri in right if rk is not None and rk == k and rt is not None and t is not None and rt <= t and (tolerance is None or rt + tolerance >= t)), key=lambda x: x[:2], default=(None, None, None))
        out.append((i, *best))
    return Counter(out)


@pytest.mark.parametrize("seed", range(4))
def test_asof(spark, seed, monkeypatch):
    rng = random.Random(seed)
    left, right = rows_of(rng, 400), rows_of(rng, (150, 400, 3, 0)[seed])
    schema = "k string, t long, v long, id long"
    if seed == 1:
        monkeypatch.setattr(ordered, "BROADCAST_RANGES", -1)
    a, b = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(4)
    for tolerance in (None, 5):
        out = ordered.asof_join(a, b, by=["k"], left_time="t", right_time="t", take=["id", "v"], ties=["id"], tolerance=None if tolerance is None else F.lit(tolerance))
        assert out.columns == [*a.columns, "asof_t", "asof_id", "asof_v"]
        assert Counter((r.id, r.asof_t, r.asof_id, r.asof_v) for r in out.collect()) == as_of(left, right, tolerance)


def test_asof_of_one_key_carries_over_ranges(spark):
    """All rows have one key; a right row long before is handed on through ranges that have none."""
    a = spark.range(3000).selectExpr("'x' AS k", "id AS t", "id")
    b = spark.createDataFrame([("x", 5, 50), ("x", 2900, 51)], "k string, t long, v long")
    out = ordered.asof_join(a, b, by=["k"], left_time="t", right_time="t", take=["v"])
    got = {r.id: r.asof_v for r in out.collect()}
    assert got == {i: None if i < 5 else 50 if i < 2900 else 51 for i in range(3000)}
    placed = ordered.placed(a, ["k"], [F.col("t")])
    assert placed.select(F.spark_partition_id()).distinct().count() > 3  # the key is many tasks
    assert sorted((r.place, r.id, r.n) for r in placed.collect()) == [(i, i, 3000) for i in range(3000)]


def test_equal_rows(spark):
    df = spark.createDataFrame([("x", 1)] * 50 + [(None, 2)] * 3, "k string, t long")
    got = ordered.placed(df, ["k"], [F.col("t")]).collect()
    assert sorted(r.place for r in got if r.k) == list(range(50)) and sorted((r.place, r.n) for r in got if not r.k) == [(0, 3), (1, 3), (2, 3)]
    assert ordered.placed(df.limit(0), ["k"], [F.col("t")]).collect() == []


FRAMES = {"lag": ("value", "v", -1, -1), "lead2": ("value", "v", 2, 2), "s": ("sum", "v", -7, 0), "m": ("avg", "v", -2, 3), "lo": ("min", "v", -30, -3), "c": ("count", "v", 1, 25)}


@pytest.mark.parametrize("block", [4, 50, 100_000])
def test_frames(spark, block):
    rows = rows_of(random.Random(9), 500)
    df = spark.createDataFrame(rows, "k string, t long, v long, id long")
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        by[r[0]].append(r)
    want = {}
    for own in by.values():
        for i, (_, _, _, id_) in enumerate(own):
            frame = lambda lo, hi: [own[j][2] for j in range(max(i + lo, 0), min(i + hi, len(own) - 1) + 1)]  # noqa: B023, E731
            some = lambda lo, hi: [x for x in frame(lo, hi) if x is not None]  # noqa: B023, E731
            s, m, lo = some(-7, 0), some(-2, 3), some(-30, -3)
            want[id_] = (i, len(own), (frame(-1, -1) or [None])[0], (frame(2, 2) or [None])[0], sum(s) if s else None, sum(m) / len(m) if m else None, min(lo) if lo else None, len(some(1, 25)))
    out = ordered.framed(df, ["k"], [F.col("t").asc_nulls_first(), F.col("id")], FRAMES, block=block)
    got = {r.id: (r.place, r.n, *(r[c] for c in FRAMES)) for r in out.collect()}
    assert got == want


@pytest.mark.parametrize("tiles", [1, 4, 7, 1000])
def test_running(spark, tiles):
    rows = rows_of(random.Random(tiles), 300)
    df = spark.createDataFrame(rows, "k string, t long, v long, id long")
    df.createOrReplaceTempView("running_rows")
    want = spark.sql(f"SELECT id, row_number() OVER w - 1 AS place, sum(v) OVER (PARTITION BY k ORDER BY t NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS total, ntile({tiles}) OVER w AS tile FROM running_rows WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, id)")
    got = ordered.running(df, ["k"], [F.col("t").asc_nulls_first(), F.col("id")], {"total": "v"}, tiles=tiles)
    assert sorted((r.id, r.place, r.total, r.tile) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert ordered.running(df.limit(0), ["k"], [F.col("id")], {"total": "v"}).collect() == []


def spans(rng, n, most):
    out = []
    for i in range(n):
        s = rng.randrange(1000)
        out.append((rng.choice(["hot", "hot", "a", None]), s if rng.random() > 0.03 else None, s + rng.choice([0, 1, 2, rng.randrange(30), rng.randrange(most), -3]), i))
    return out


@pytest.mark.parametrize("least", [1, 7, 10_000])
def test_overlaps(spark, least):
    rng = random.Random(least)
    a, b = spans(rng, 150, 900), spans(rng, 130, 60)
    schema = "k string, s long, e long, id long"
    want = {(x[3], y[3]) for x in a for y in b if x[0] and x[0] == y[0] and None not in (x[1], y[1]) and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]}
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    out = intervals.overlap_join(left, right, by=["k"], left_span=("s", "e"), right_span=("s", "e"), least=least)
    got = [(r.id, r.other_id) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlap_join(left, right.limit(0), by=["k"], left_span=("s", "e"), right_span=("s", "e"), least=least).collect() == []
    points = left.select("k", "s", "id")
    inside = intervals.range_join(points, right, by=["k"], point="s", span=("s", "e"), least=least)
    assert Counter((r.id, r.other_id) for r in inside.collect()) == Counter((x[3], y[3]) for x in a for y in b if x[0] and x[0] == y[0] and None not in (x[1], y[1]) and y[1] <= x[1] < y[2])


def test_overlaps_of_times(spark):
    df = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' AS s, timestamp'2024-01-01 01:00:00' AS e, date'2024-01-01' AS d, date'2024-02-01' AS u")
    other = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:59:59' AS s, timestamp'2024-01-01 09:00:00' AS e, date'2024-01-31' AS d, date'2024-02-02' AS u")
    assert intervals.overlap_join(df, other, by=["k"], left_span=("s", "e"), right_span=("s", "e"), least=60_000_000).count() == 1
    assert intervals.overlap_join(df, other, by=["k"], left_span=("d", "u"), right_span=("d", "u"), least=1).count() == 1
    assert intervals.range_join(df, other, by=["k"], point="e", span=("s", "e"), least=60_000_000).count() == 1


def test_grouping_sets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice(["p", "q"]), rng.choice([None, 1, 5, 9])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b int, c string, v long")
    df.createOrReplaceTempView("grouped_rows")
    values = {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v")}
    for how, sql in ((grouping.cube, "CUBE (a, b, c)"), (grouping.rollup, "ROLLUP (a, b, c)")):
        want = spark.sql(f"SELECT a, b, c, grouping_id() AS g, count(*), count(v), sum(v), min(v), max(v), avg(v) FROM grouped_rows GROUP BY {sql}")
        assert Counter(map(tuple, how(df, ["a", "b", "c"], values).collect())) == Counter(map(tuple, want.collect()))
    twice = grouping.grouping_sets(df, ["a", "b"], [["a"], ["a"], []], {"n": ("count", None)})
    assert twice.count() == 7 and twice.where("grouping_id = 3").first().n == 400
    assert grouping.cube(df.limit(0), ["a"], {"n": ("count", None)}).collect() == []
    with pytest.raises(ValueError):
        grouping.cube(df, ["a"], {"n": ("median", "v")})


def test_grouping_expands_groups_not_rows(spark):
    df = spark.range(1000).selectExpr("id % 3 AS a", "id % 2 AS b", "id AS v")
    plan = grouping.cube(df, ["a", "b"], {"s": ("sum", "v")})._jdf.queryExecution().executedPlan().toString()
    expand = plan.index("Generate")
    assert plan.index("partial_sum(v", expand) > expand and plan[expand:].count("Exchange") == 1  # rows meet once, below the expansion

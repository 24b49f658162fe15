"""Windows over a stream: late rows, restarts, and the same table as a batch over all rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.streaming import windows
from quarry.streaming.windows import Windows

SCHEMA = "id long, ts timestamp, k string, v long"
START = dt.datetime(2024, 1, 1)
def values():
    return [F.count("*").alias("n"), F.sum("v").alias("s")]


def row(i, minutes, k="a", v=1):
    return (i, None if minutes is None else START + dt.timedelta(minutes=minutes), k, v)


def feed(spark, root, rows, w, watermark="10 minutes"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    q = windows.start(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), w, values(), f"{root}/out", watermark=watermark)
    q.awaitTermination()
    return windows.late(q)


def table(df):
    return sorted(((r.start, r.end, r.k, r.n, r.s) for r in df.collect()), key=str)


@pytest.mark.parametrize("w", [Windows("ts", ("k",), size="10 minutes"), Windows("ts", ("k",), size="30 minutes", slide="10 minutes")])
def test_restarts_give_the_batch_table(spark, tmp_path, w):
    """Each feed is a run of its own that starts from the checkpoint; rows within the watermark come in any order."""
    steps = [[row(0, 1), row(1, 12, "b"), row(2, 5, None), row(9, None)], [row(3, 3), row(4, 25, v=None)], [row(5, 24), row(6, 61, "b"), row(7, 59)]]
    for rows in steps:
        assert feed(spark, tmp_path, rows, w, "2 hours") == 0
    every = spark.createDataFrame([r for rows in steps for r in rows], SCHEMA)
    assert table(windows.result(spark, f"{tmp_path}/out", w)) == table(windows.aggregated(every, w, values()))


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    w = Windows("ts", ("k",), size="10 minutes")
    assert feed(spark, tmp_path, [row(0, 1), row(1, 100)], w) == 0  # the watermark is now at 90 minutes
    assert feed(spark, tmp_path, [row(2, 2), row(3, 3), row(4, 95), row(5, 101)], w) > 0  # rows 2 and 3 are late, 4 isn't
    got = {(r.start, r.n) for r in windows.result(spark, f"{tmp_path}/out", w).collect()}
    assert got == {(START, 1), (START + dt.timedelta(minutes=90), 1), (START + dt.timedelta(minutes=100), 2)}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    w = Windows("ts", ("k",), size="10 minutes")
    feed(spark, tmp_path, [row(0, 1), row(1, 2)], w)
    before = table(windows.result(spark, f"{tmp_path}/out", w))
    commits = sorted((tmp_path / "out" / "_checkpoint" / "commits").glob("[0-9]*"))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)  # as if the driver had been lost before the commit
    feed(spark, tmp_path, [row(2, 21)], w)
    got = table(windows.result(spark, f"{tmp_path}/out", w))
    assert set(before) <= set(got) and [x[3] for x in got] == [2, 1]


def test_sessions_close_with_the_watermark(spark, tmp_path):
    w = Windows("ts", ("k",), gap="20 minutes")
    feed(spark, tmp_path, [row(0, 0), row(1, 15), row(2, 70)], w)
    feed(spark, tmp_path, [row(3, 75), row(4, 80, "b"), row(5, 200)], w)
    feed(spark, tmp_path, [row(6, 400)], w)
    got = [(r.start, r.end, r.k, r.n) for r in windows.result(spark, f"{tmp_path}/out", w).orderBy("start").collect()]
    at = lambda m: START + dt.timedelta(minutes=m)
    assert got == [(at(0), at(35), "a", 2), (at(70), at(95), "a", 2), (at(80), at(100), "b", 1), (at(200), at(220), "a", 1)]


def test_closed_sessions_are_read_as_they_lie(spark, tmp_path):
    """No exchange, and no session twice, although a restart closes some and a batch runs again."""
    w = Windows("ts", ("k",), gap="20 minutes")
    for rows in ([row(0, 0), row(1, 5), row(2, 100, None)], [row(3, 200), row(4, 85, None)], [row(5, 400, "b")]):
        feed(spark, tmp_path, rows, w)
        commits = sorted((tmp_path / "out" / "_checkpoint" / "commits").glob("[0-9]*"))
        for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
            f.unlink(missing_ok=True)
    out = windows.result(spark, f"{tmp_path}/out", w)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    at = lambda m: START + dt.timedelta(minutes=m)
    assert table(out) == sorted([(at(0), at(25), "a", 2, 2), (at(85), at(120), None, 2, 2), (at(200), at(220), "a", 1, 1)], key=str)


def test_sizes():
    for bad in ({}, {"size": "1 hour", "gap": "1 hour"}):
        with pytest.raises(ValueError):
            Windows("ts", ("k",), **bad)

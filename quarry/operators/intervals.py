"""Joins of overlapping intervals, by equality of cells.

An interval [start, end) belongs to the level whose cells are no shorter than it, so it lies in two cells of that level at most. A pair is
found at the higher level of its two: the shorter interval is also dealt to the cells of each higher level that the other side has, two at
most again. It counts in one cell only, the later of the two first cells that its intervals have there. So the join is on (keys, level,
cell): no nested loop, no interval in many cells, every pair once, and hot cells are split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many times longer the cells of the next level are.
STEP = 4


def _number(c: Column, kind: str) -> Column:
    """Times as microseconds, dates as days, numbers as they are."""
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(c) if kind == "date" else c


def _levelled(df: DataFrame, by: list[str], start: str, end: str, side: str, least: int) -> DataFrame:
    """(keys, s, e, level, row) of df; empty and reversed intervals and nulls are left out."""
    kinds = [df.schema[c].dataType.simpleString() for c in (start, end)]
    s, e = (_number(F.col(c), k) for c, k in zip((start, end), kinds))
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), s.cast("long").alias(f"s_{side}"), e.cast("long").alias(f"e_{side}"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns))).alias(side))
    rows = rows.where(F.col(f"s_{side}") < F.col(f"e_{side}"))
    for i in range(len(by)):
        rows = rows.where(F.col(f"k{i}").isNotNull())
    length = (F.col(f"e_{side}") - F.col(f"s_{side}")) / F.lit(least)
    return rows.withColumn(f"own_{side}", F.greatest(F.ceil(F.log(length) / F.log(F.lit(float(STEP))) - 1e-9), F.lit(0)).cast("int"))


def _cells(rows: DataFrame, side: str, levels: list[int], least: int) -> DataFrame:
    """rows in the cells of their own level, and of the higher ones that the other side has."""
    widths = {n: least * STEP**n for n in levels}
    every = F.array(*(F.struct(F.lit(n).alias("level"), F.lit(w).alias("width")) for n, w in widths.items()))
    wanted = F.filter(every, lambda x: x.level >= F.col(f"own_{side}"))
    rows = rows.withColumn("at", F.explode(wanted)).select("*", "at.level", "at.width").drop("at")
    first, last = F.floor(F.col(f"s_{side}") / F.col("width")), F.floor((F.col(f"e_{side}") - 1) / F.col("width"))
    return rows.withColumn(f"first_{side}", first).withColumn("cell", F.explode(F.sequence(first, last))).drop("width")


def overlap_join(left: DataFrame, right: DataFrame, *, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], least: int, prefix: str = "other_") -> DataFrame:
    """All pairs of a left and a right row with equal keys whose half-open intervals [start, end) overlap.

    Columns: those of left, and those of right with ``prefix``. least: the width of the smallest cells, in the unit of the bounds (microseconds for times,
    days for dates); it changes the work, not the result. Empty, reversed and null intervals and null keys match nothing.
    """
    a, b = _levelled(left, by, *left_span, "a", least), _levelled(right, by, *right_span, "b", least)
    present = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731  at most the logarithm of the longest interval
    of_a, of_b = present(a, "own_a"), present(b, "own_b")
    levels = sorted({*of_a, *of_b})
    if not of_a or not of_b:
        levels = [0]
    keys = [f"k{i}" for i in range(len(by))]
    pairs = _cells(a, "a", levels, least).join(_cells(b, "b", levels, least), [*keys, "level", "cell"])
    pairs = pairs.where((F.col("level") == F.greatest("own_a", "own_b")) & (F.col("cell") == F.greatest("first_a", "first_b")))
    pairs = pairs.where((F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")))
    return pairs.select(*(F.col(f"a.c{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"b.c{i}").alias(f"{prefix}{c}") for i, c in enumerate(right.columns)))


def range_join(points: DataFrame, spans: DataFrame, *, by: list[str], point: str, span: tuple[str, str], least: int, prefix: str = "other_") -> DataFrame:
    """All pairs of a point and an interval [start, end) that holds it: the overlap join with points as the shortest intervals."""
    kind = points.schema[point].dataType.simpleString()
    at = _number(F.col(point), kind).cast("long")
    p = points.withColumns({"__from": at, "__to": at + 1})
    s, e = (_number(F.col(c), spans.schema[c].dataType.simpleString()).cast("long") for c in span)
    q = spans.withColumns({"__from": s, "__to": e})
    out = overlap_join(p, q, by=by, left_span=("__from", "__to"), right_span=("__from", "__to"), least=least, prefix=prefix)
    return out.drop("__from", "__to", f"{prefix}__from", f"{prefix}__to")

"""Sub-totals over sets of columns, from the partial sums of the finest level.

Rows are aggregated once by all columns, with map-side combine; the sub-totals expand that small table, not the rows. So the
expansion costs a copy of each group for each set, whatever the number of rows, and a hot group is one row before it is expanded.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (function, column): count (of rows, if the column is None), sum, min, max or avg.
Aggregates = dict[str, tuple[str, str | None]]


def grouping_sets(df: DataFrame, columns: list[str], sets: list[list[str]], values: Aggregates, *, group_id: str = "grouping_id") -> DataFrame:
    """A row for each group of each set: the columns (null where the set leaves them out), grouping_id, and the values.

    grouping_id has a bit for each column, the first the highest, set where the column is left out; it tells a null in the data from one
    that stands for all. Sets that are given twice are two. The empty set is one row over everything; without rows there is none.
    """
    partial, final = _parts(values)
    finest = df.groupBy(*(F.col(c).alias(f"g{i}") for i, c in enumerate(columns))).agg(*partial)
    keys = [[F.col(f"g{i}") if c in s else F.lit(None).cast(df.schema[c].dataType) for i, c in enumerate(columns)] for s in sets]
    ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for s in sets]
    each = F.array(*(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(own)), F.lit(b).cast("long").alias("id"), F.lit(n).alias("n")) for n, (own, b) in enumerate(zip(keys, ids))))
    parts = [c for c in finest.columns if c.startswith("p")]
    spread = finest.select(F.explode(each).alias("set"), *parts)
    out = spread.groupBy("set").agg(*final)
    return out.select(*(F.col(f"set.k{i}").alias(c) for i, c in enumerate(columns)), F.col("set.id").alias(group_id), *values)


def cube(df: DataFrame, columns: list[str], values: Aggregates, **how) -> DataFrame:
    """Sub-totals over every subset of the columns."""
    return grouping_sets(df, columns, [list(s) for n in range(len(columns), -1, -1) for s in combinations(columns, n)], values, **how)


def rollup(df: DataFrame, columns: list[str], values: Aggregates, **how) -> DataFrame:
    """Sub-totals over the columns, then without the last, and so on."""
    return grouping_sets(df, columns, [columns[:n] for n in range(len(columns), -1, -1)], values, **how)


def _parts(values: Aggregates) -> tuple[list[Column], list[Column]]:
    """What the finest level keeps, and how it makes the values of a coarser one."""
    partial, final = [], []
    for i, (name, (f, c)) in enumerate(values.items()):
        p, q = f"p{i}", f"p{i}n"
        if f == "count":
            partial.append((F.count("*") if c is None else F.count(c)).alias(p))
            final.append(F.sum(p).alias(name))
        elif f == "avg":
            partial += [F.sum(c).alias(p), F.count(c).alias(q)]
            final.append((F.sum(p) / F.nullif(F.sum(q), F.lit(0))).alias(name))
        elif f in ("sum", "min", "max"):
            of = {"sum": F.sum, "min": F.min, "max": F.max}[f]
            partial.append(of(c).alias(p))
            final.append(of(p).alias(name))
        else:
            raise ValueError(f"no such aggregate: {f}")
    return partial, final

"""Operators over ordered keys: places, as-of joins, row frames and running totals, however many rows a key has.

A window over a key is one task for each key. Here rows are dealt by ranges of (key, order) and sorted, so that a key with a third
of all rows is many tasks, and what a range needs from those before it is a table with a row or two for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stored

#: Rows of the small tables (one for each range and key) that are broadcast at most.
BROADCAST_RANGES = 1_000_000
#: Rows of a key that are framed together.
BLOCK = 100_000


def near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_RANGES else df


def ranges(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df (saved) dealt by ranges of by and order, and sorted in them, with __range, the number of a row's range, and __at, its place there.

    Rows that agree in by and order are sorted by a hash of the row, so that many of them may be several ranges.
    """
    tie = F.xxhash64(*(F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))
    sort = [*(F.col(c).asc_nulls_first() for c in by), *order, tie]
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = stored(dealt.withColumn("__row", F.monotonically_increasing_id()))
    return placed.withColumns({"__range": F.shiftright("__row", 33), "__at": F.col("__row").bitwiseAND((1 << 33) - 1)}).drop("__row")


def placed(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with place, from 0 in each key by order, and n, the key's rows. A null key is a key; rows that agree in order come in any order.

    One exchange of the rows; an empty table gives an empty result.
    """
    r = ranges(df, by, order)
    counts = r.groupBy(*by, "__range").agg(F.count("*").alias("here"), F.min("__at").alias("first"))
    own = Window.partitionBy(*by)
    shift = F.sum("here").over(own.orderBy("__range")) - F.col("here") - F.col("first")
    of = counts.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__range").alias("__of"), shift.alias("__shift"), F.sum("here").over(own).alias("n"))
    same = (F.col("__range") == F.col("__of")) & _same([F.col(c) for c in by], [F.col(f"__k{i}") for i in range(len(by))])
    return r.join(near(of), same).select(*df.columns, (F.col("__at") + F.col("__shift")).alias("place"), "n")


def _same(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out &= x.eqNullSafe(y)
    return out


# -- frames ---------------------------------------------------------------------------------------------------


def framed(df: DataFrame, by: list[str], order: list[Column], values: dict[str, tuple[str, str, int, int]], *, block: int = BLOCK) -> DataFrame:
    """df with place, n, and for each {name: (function, column, first, last)} the function over the rows from first to last around each row.

    function is sum, avg, min, max, count, or value (of the only row of the frame: first = last = -1 is lag, 1 is lead). Rows are
    numbered, and dealt by blocks of their numbers; a block also gets the rows that its frames reach into, so frames across blocks are whole.
    order must tell the rows of a key apart, or frames depend on the order of ties.
    """
    back = max([0, *(-v[2] for v in values.values())])
    ahead = max([0, *(v[3] for v in values.values())])
    p = placed(df, by, order)
    home = F.floor(F.col("place") / block)
    lo = F.greatest(F.floor((F.col("place") - ahead) / block), F.lit(0))
    hi = F.least(F.floor((F.col("place") + back) / block), F.floor((F.col("n") - 1) / block))
    copies = p.withColumn("__block", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*by, "__block").orderBy("place")
    of = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "value": F.first}
    out = {name: of[f](c).over(w.rowsBetween(first, last)) for name, (f, c, first, last) in values.items()}
    return copies.withColumns(out).where(F.col("__block") == home).drop("__block")


def running(df: DataFrame, by: list[str], order: list[Column], values: dict[str, str], *, tiles: int | None = None) -> DataFrame:
    """df with place, n, and for each {name: column} the column's total from the key's first row to this one; with ``tiles`` also tile, from 1.

    Two levels: totals inside a range, and those of the ranges before. Nulls add nothing. order must tell the rows of a key apart.
    """
    r = ranges(df, by, order)
    sums = {f"__s{i}": F.sum(c) for i, c in enumerate(values.values())}
    counts = r.groupBy(*by, "__range").agg(F.count("*").alias("here"), F.min("__at").alias("first"), *(s.alias(c) for c, s in sums.items()))
    own = Window.partitionBy(*by)
    upto = own.orderBy("__range")
    of = counts.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__range").alias("__of"),
        (F.sum("here").over(upto) - F.col("here") - F.col("first")).alias("__shift"), F.sum("here").over(own).alias("n"),
        *(F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in sums),
    )
    same = (F.col("__range") == F.col("__of")) & _same([F.col(c) for c in by], [F.col(f"__k{i}") for i in range(len(by))])
    inside = Window.partitionBy(*by, "__range").orderBy("__at")
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = r.withColumns({f"__t{i}": F.sum(c).over(inside) for i, c in enumerate(values.values())})
    out = each.join(near(of), same).withColumn("place", F.col("__at") + F.col("__shift"))
    total = {name: F.when(F.col(f"__t{i}").isNotNull() | F.col(f"__s{i}").isNotNull(), zero(F.col(f"__t{i}")) + zero(F.col(f"__s{i}"))) for i, name in enumerate(values)}
    out = out.select(*df.columns, "place", "n", *(t.alias(name) for name, t in total.items()))
    if not tiles:
        return out
    # the first n % tiles tiles have one row more
    small, more = F.floor(F.col("n") / tiles), F.col("n") % tiles
    wide = more * (small + 1)
    tile = F.when(F.col("place") < wide, F.floor(F.col("place") / (small + 1))).otherwise(more + F.floor((F.col("place") - wide) / F.greatest(small, F.lit(1))))
    return out.withColumn("tile", (tile + 1).cast("int"))


# -- as-of joins ----------------------------------------------------------------------------------------------


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str, take: list[str], ties: list[str] = [], tolerance: Column | None = None, prefix: str = "asof_") -> DataFrame:  # noqa: B006
    """Every row of left, with ``take`` (and the time) of the last row of right with the same key that isn't later; null where there is none.

    Of right rows with one time that with the greatest ``ties`` counts. With ``tolerance`` (an interval, or a number for numeric times) a match may be no
    older than that. Null keys and null times match nothing. Keys have the same names in both. One exchange of both sides together: their
    union is dealt by ranges of key and time; a range takes over the last right row of the ranges before it, of which there
    is one for each key that goes on.
    """
    got = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate([right_time, *take])))
    mine = left.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*(F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns))).alias("__left"))
    theirs = right.where(F.col(right_time).isNotNull()).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*(F.col(c) for c in ties), F.lit(0).alias("__")).alias("__tie_by"), got.alias("__right"))
    for i in range(len(by)):
        theirs = theirs.where(F.col(f"__k{i}").isNotNull())
    both = mine.unionByName(theirs, allowMissingColumns=True)
    keys = [f"__k{i}" for i in range(len(by))]
    order = [F.col("__t").asc_nulls_first(), F.col("__side"), F.col("__tie_by").asc_nulls_first()]
    r = ranges(both, keys, order)
    # the last right row of each key in each range, handed on to the key's next ranges
    last = r.where("__side = 0").groupBy(*keys, "__range").agg(F.max_by("__right", "__at").alias("__last"))
    here = r.groupBy(*keys, "__range").agg(F.lit(1).alias("__one"))
    spans = here.groupBy(*keys).agg(F.count("*").alias("__spans")).where("__spans > 1").drop("__spans")
    going = here.join(near(spans), keys).join(last, [*keys, "__range"], "left")
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carry = going.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("__range").alias("__of"), before.alias("__carry")).where("__carry is not null")
    inside = Window.partitionBy(*keys, "__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    seen = r.withColumn("__seen", F.last("__right", ignorenulls=True).over(inside)).where("__side = 1")
    same = (F.col("__range") == F.col("__of")) & _same([F.col(k) for k in keys], [F.col(f"{k}_") for k in keys])
    out = seen.join(near(carry), same, "left").withColumn("__seen", F.coalesce("__seen", "__carry"))
    ok = F.col("__t").isNotNull()
    for k in keys:
        ok &= F.col(k).isNotNull()
    if tolerance is not None:
        ok &= F.col("__seen.v0") + tolerance >= F.col("__t")
    names = [right_time, *take]
    return out.select(*(F.col(f"__left.l{i}").alias(c) for i, c in enumerate(left.columns)), *(F.when(ok, F.col(f"__seen.v{i}")).alias(f"{prefix}{c}") for i, c in enumerate(names)))

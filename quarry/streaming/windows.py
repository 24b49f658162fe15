"""Event-time windows over a stream: tumbling, sliding and session windows, with a watermark, late rows counted, and a table that a
restart from the checkpoint continues.

A micro-batch writes the windows that it changed under its number, so one that is run again overwrites its own files. ``result`` takes each
window's last state. Tumbling and sliding windows are there as soon as they have a row (update mode); sessions once the watermark
has passed their end, since until then two of them may become one (append mode).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windows:
    """Windows of ``size``, one beginning every ``slide`` (none: tumbling); or sessions that end after ``gap`` without a row."""

    time: str
    by: tuple[str, ...]
    size: str | None = None
    slide: str | None = None
    gap: str | None = None

    def __post_init__(self) -> None:
        if (self.size is None) == (self.gap is None):
            raise ValueError("give a size, or a gap")

    @property
    def span(self) -> Column:
        return F.session_window(F.col(self.time), self.gap) if self.gap else F.window(self.time, self.size, self.slide or self.size)


def aggregated(rows: DataFrame, w: Windows, values: list[Column], *, watermark: str | None = None) -> DataFrame:
    """(start, end, by..., values) of each window, of a stream or a table. Rows without a time are in no window; null keys are keys."""
    rows = rows if watermark is None else rows.withWatermark(w.time, watermark)
    out = rows.groupBy(w.span.alias("span"), *w.by).agg(*values)
    return out.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *(c for c in out.columns if c != "span"))


def start(stream: DataFrame, w: Windows, values: list[Column], root: str, *, watermark: str):
    """Start a query that keeps the windows of a stream under root, with all that is there now."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/states/batch={batch}")

    out = aggregated(stream, w, values, watermark=watermark)
    mode = "append" if w.gap else "update"
    return out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()


def late(query) -> int:
    """Rows that came after their window was closed, and were left out, in the progress that the query still knows."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def result(spark: SparkSession, root: str, w: Windows) -> DataFrame:
    """The windows as the last batch that changed each has left them. A session is written once, when it has closed: those are read as they lie."""
    states = spark.read.parquet(f"{root}/states")
    keys = ["start", "end", *w.by]
    rest = [c for c in states.columns if c not in (*keys, "batch")]
    if w.gap:
        return states.select(*keys, *rest)
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")

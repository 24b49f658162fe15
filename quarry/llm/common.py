"""What the training-data operators share: table access, text primitives, lineage cuts, and texts on their way through Python."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import shared_dir

#: A word of the size and quality contracts, for Java and RE2 alike; bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, *, compact: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files survive the loss of an executor; they are removed by ``forget``, or when the driver's JVM ends. ``compact`` is for
    tables of few bytes a row: their rows are dealt to two tasks a core first, since each file costs an executor the start of a
    few processes where the file system sets permissions by a shell.
    """
    spark = df.sparkSession
    if compact:
        df = df.repartition(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*saved: DataFrame) -> None:
    """Remove the files of saved tables that nothing reads any more, and let Spark remove the shuffle files of finished plans.

    Spark removes those when the driver's JVM has collected the plans, which by itself may be long after they have filled a disk.
    """
    for df in saved:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if saved:
        gc.collect()
        jvm.System.gc()


#: Rows of texts that go to a Python worker at once, unless the session asks for fewer.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the rows of its session's Arrow batches: a batch of whole texts must fit beside the executor's heap.

    Spark bounds a batch's bytes too, so a few very long texts are a batch of their own.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def lean() -> None:
    """For workers, before Arrow batches come: memory that a batch no longer needs goes back to the system, not to Arrow's own pool.

    A worker lives as long as its executor, beside a heap that fills most of the executor's memory.
    """
    pa.set_memory_pool(pa.system_memory_pool())


def clear_of(names: list[str], own: list[str]) -> dict[str, str]:
    """Kept column -> its name in a result that has the columns ``own``: underscores at its end keep it apart from those."""
    out: dict[str, str] = {}
    for c in names:
        new = c
        while new in own or new in out.values() or new != c and new in names:
            new += "_"
        out[c] = new
    return out


def map_rows(df: DataFrame, inputs: list[Column | str], keep: list[str], fields: str, work: Callable[[], Callable[..., list]]) -> DataFrame:
    """The columns ``keep`` of df, and fields (a DDL schema) that Python computes from the inputs, one batch of rows at a time.

    work() is called in each task; what it returns gets a list of values for each input, and gives a list of values for each field.
    An input is a column, or the name of a kept one. Kept columns pass as Arrow columns: Python never sees their values, so integers of any size, nulls and nested
    values come out as they went in. A kept column whose name is a field's gets underscores at its end.
    """
    own = T._parse_datatype_string(fields)
    names = clear_of(keep, own.names)
    more = [c for c in inputs if not isinstance(c, str)]
    rows = df.select(*(df[c].alias(f"__keep{i}") for i, c in enumerate(keep)), *(c.alias(f"__in{i}") for i, c in enumerate(more)))
    into = [keep.index(c) if isinstance(c, str) else len(keep) + sum(not isinstance(x, str) for x in inputs[:i]) for i, c in enumerate(inputs)]
    kept = [T.StructField(names[c], rows.schema[i].dataType, rows.schema[i].nullable) for i, c in enumerate(keep)]
    kinds = arrow_types(own)
    heads = [f.name for f in kept]
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        each = work()
        for b in batches:
            found = each(*(b.column(i).to_pylist() for i in into))
            arrays = [pa.array(v, k) for v, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *arrays], names=[*heads, *own.names])

    return bounded_batches(rows).mapInArrow(run, T.StructType([*kept, *own.fields]))


def arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def host_key(col: Column | str) -> Column:
    """A source as a non-null key: null and '' stay apart."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), col), F.lit("-"))


def n_words(col: Column | str) -> Column:
    """Number of words of a text; null: 0."""
    return F.regexp_count(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), F.lit(WORD)).cast("long")


def signed(h: int) -> int:
    """A 64-bit hash as a bigint."""
    return h - (1 << 64) if h >> 63 else h

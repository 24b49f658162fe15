"""A session with the settings that the engine wants, the folder that all executors share, and tasks for small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """On a cluster the settings come from its own configuration."""
    b = SparkSession.builder.appName(app)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}
    for k, v in wanted.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one, but only if all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan, dealt to all cores where its files make fewer tasks than there are cores.

    Such an input is small, however much work its rows are; one with more tasks than cores isn't touched. For scans alone: the number
    of tasks of a plan with exchanges is known only after they ran.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def stored_by(df: DataFrame, *by: str) -> DataFrame:
    """As ``stored``, dealt by these columns into as many buckets as a shuffle has partitions: plans that group by them need no exchange."""
    spark = df.sparkSession
    name, buckets = f"stored_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.table(name)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder once, and read back from there by all plans that need it. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)

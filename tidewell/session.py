"""Session factory, table loader and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew joins on; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on, where the session leaves Spark's default:
    texts of a few kilobytes make its 10,000 rows tens of megabytes, held by each side of each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a DataFrame; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a session in a
    single JVM (``local[n]``) may go without; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewell-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_hint: int | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage is cut,
    the rows survive lost executors, and a later join sees plain exchanges that
    adaptive execution can split where a key is skewed."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    out = df if partition_hint is None else df.coalesce(partition_hint)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables that one call needs. ``drop`` deletes some of them, ``clear`` the rest; both
    are called when all that was computed from them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """``df``, written and read back (see ``materialize``)."""
        path = shared_path(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *frames: DataFrame) -> None:
        for frame, path in [t for t in self.tables if any(t[0] is f for f in frames)]:
            remove_path(self.spark, path)
            self.tables.remove((frame, path))

    def clear(self) -> None:
        self.drop(*[t[0] for t in self.tables])

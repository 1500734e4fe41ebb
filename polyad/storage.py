"""Shared storage for intermediate tables: written once, read back, no lineage behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark frees an execution's shuffle files at its end while this is set.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without belongs to Spark's default file system, for every reader and writer alike."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(hadoop).toString()


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/polyad"
    return f"{qualified(spark, base).rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir).

    Only where that setting is absent, as in tests in local mode, a temporary folder takes its place.
    """
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, path: str) -> None:
    """Write df as Parquet. The shuffle files of the plan behind it are of no use any more and are freed at once."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    try:
        conf.set(FREE_SHUFFLES, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Store df in shared storage once and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    store(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table. Frames that read it are of no use afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


class Rounds:
    """Stores the states of a loop: of each name the KEEP newest tables stay, an older one goes when the next one is written.

    A state may be read until two newer ones of its name exist, which covers loops that look at the state before.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        store(df, path)
        held = self.paths.setdefault(name, [])
        held.append(path)
        while len(held) > self.KEEP:
            drop(self.spark, held.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Delete all states."""
        for held in self.paths.values():
            while held:
                drop(self.spark, held.pop())


def clean(spark: SparkSession) -> None:
    """Delete all that this application has put into shared storage. Frames that read from there are of no use afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_base(spark))
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)

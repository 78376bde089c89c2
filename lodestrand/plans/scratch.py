"""Cutting lineage by written tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written to cut lineage. Superseded ones are dropped by name, the rest when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        _OWN.append((spark, self.folder))

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write df, read it back: later plans start at this file, which outlives any executor."""
        path = f"{self.folder}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        _delete(self.spark, f"{self.folder}/{name}".rstrip("/"))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _end() -> None:
    for spark, folder in _OWN:
        _delete(spark, folder)

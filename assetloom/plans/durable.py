"""Cutting lineage so that jobs survive the loss of executors.

Long loops must not carry an ever growing plan. Rows are therefore written to the folder that the
cluster shares, ``spark.checkpoint.dir``; a folder of our own is set only where none is configured
(tests and single-machine use).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. Where the session has none it is set once, which only a local session may do: elsewhere executors couldn't read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="spark-assetloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage now and go on from there (small and middling frames)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/assetloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """As ``cut``, as compressed Parquet: for frames whose size grows with the input."""
    return _written(df)[0]


class Scratch:
    """Written frames of one operator. ``clear`` deletes those that its result doesn't read, once nothing that reads them is left to run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, keep: bool = False) -> DataFrame:
        frame, path = _written(df)
        if not keep:
            self.paths.append(path)
        return frame

    def clear(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            at = hadoop(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []

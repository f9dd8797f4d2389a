"""Tables in the folder that the driver and all executors share, to cut a plan that would be computed many times over."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables of one computation: each can be read again after an executor was lost, and all but the result go when it ends.

    with Scratch(spark) as scratch:
        cut = scratch.table(df)
        ...
        out = scratch.result(...)
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/foliant-{uuid.uuid4().hex}"
        self._made = 0

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame) -> DataFrame:
        self._made += 1
        return self._write(df, f"{self.root}/{self._made}")

    def result(self, df: DataFrame) -> DataFrame:
        return self._write(df, f"{self.root}-result")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

"""Intermediate tables in the shared folder, and their removal once a successor is written."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


class Scratch:
    """Tables of one run; every table is whole before it is read, so lost executors cost no more than a stage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame, *by: str) -> DataFrame:
        """`df` written and read again; what it was made of may be dropped then."""
        self.count += 1
        folder = f"{self.place}/{self.count}"
        schema = df.schema
        df.write.partitionBy(*by).option("compression", "zstd").parquet(folder)
        out = self.spark.read.schema(schema).parquet(folder)
        out._scratch = folder
        return out

    def drop(self, *tables: DataFrame, part: str = "") -> None:
        """Deletes stored tables (or a partition of them). Shuffle files of finished steps go when the driver's
        JVM collects its garbage, which is asked for."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{t._scratch}/{part}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()

"""Run history: newest first, a fixed number kept, delete by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP = 50


def newest(history: DataFrame, ts: str = "timestamp", key: str = "id", keep: int = KEEP) -> DataFrame:
    """The `keep` newest runs (a bounded top-n)."""
    return history.orderBy(F.desc(ts), key).limit(keep)


def append(spark: SparkSession, path: str, record: DataFrame) -> None:
    record.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, keep: int = KEEP) -> DataFrame:
    return newest(spark.read.parquet(path), keep=keep)


def without(history: DataFrame, ids: Sequence[str], key: str = "id") -> DataFrame:
    return history.where(~F.col(key).isin(list(ids)))


def without_runs(history: DataFrame, drop: DataFrame, key: str = "id") -> DataFrame:
    """Delete by a table of ids."""
    return history.join(drop.select(key), key, "left_anti")

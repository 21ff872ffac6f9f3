"""Stored HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """(page_id, url, html) from a table or a Parquet path; pages without URL are left out."""
    df = spark.read.parquet(source) if isinstance(source, str) else source
    return df.select("page_id", "url", "html").where(F.col("url") != "")

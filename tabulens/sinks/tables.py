"""Sinks. Paths are any file system Spark can reach; results are partitioned by run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scalars import sanitize
from ..operators import clean, extract


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Cleaned or model-ready table; text formats are sanitised first."""
    if fmt == "csv":
        sanitize(df).write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        sanitize(df).write.mode(mode).json(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_sections(sections: dict[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> None:
    """One table per result section, one partition per run; a run that is written again replaces itself."""
    for name, d in sections.items():
        (d.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id").format(fmt).save(f"{path}/{name}"))


def write_assignments(df: DataFrame, key: Sequence[str], cluster: str, path: str) -> None:
    df.select(*key, F.col(cluster).cast("long").alias("cluster_label")).write.mode("overwrite").parquet(path)


def preview_extracted(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Row counts of the two forms an extraction is stored in."""
    wide = extract.long_to_wide(long, ["item_index"], "field_name", "value", names)
    one = lambda d, k: d.agg(F.lit(k).alias("kind"), F.count("*").alias("rows"))
    return one(long, "long").unionByName(one(wide, "wide"))


def write_extracted(long: DataFrame, names: Sequence[str], path: str) -> None:
    """Long rows as JSON, one row per item as CSV in selection order."""
    long.write.mode("overwrite").json(f"{path}/long")
    wide = extract.long_to_wide(long, ["item_index"], "field_name", "value", names)
    wide.select(*names).write.mode("overwrite").option("header", True).csv(f"{path}/wide")


def export_view(df: DataFrame, term: str, fields: Sequence[str], prices: Sequence[str] = ()) -> DataFrame:
    """Rows that contain the term, with price columns as numbers where they parse."""
    out = clean.search(df, term, fields)
    return out.withColumns({c: X.clean_price(F.col(c)).try_cast("double") for c in prices})

"""Reports on flagged rows: deviations, drivers, rate, cluster context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import band
from .encode import moments


def contamination(n: int) -> float:
    """Expected anomaly share: ten rows, within 2% and 8%."""
    return min(0.08, max(0.02, 10 / max(n, 1)))


def z_scores(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add `z`: array of (feature, absolute population z-score)."""
    stat = moments(df, features)
    return df.withColumn("z", F.array(*[F.struct(F.lit(c).alias("feature"), F.abs((F.col(c) - m) / F.lit(s or 1.0)).alias("abs_z"))
                                        for c, (m, s) in stat.items()]))


def top_anomalies(df: DataFrame, flag: str, score: str, key: str, features: Sequence[str], top: int = 20,
                  per_row: int = 5, extra: Sequence[str] = ()) -> DataFrame:
    """The flagged rows with the highest score (a bounded report) and their largest deviations, one row each."""
    worst = (z_scores(df, features).where(F.col(flag)).orderBy(F.desc(score), key).limit(top)
             .select(key, score, *extra, "z"))
    long = worst.select(key, score, *extra, F.inline("z"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("abs_z"), "feature"))
    return (long.withColumn("place", place.cast("long")).where(F.col("place") <= per_row)
            .select(key, F.round(score, 6).alias("anomaly_score"), *extra, "place", "feature", F.round("abs_z", 6).alias("abs_z_score")))


def drivers(df: DataFrame, flag: str, features: Sequence[str], top: int = 10) -> DataFrame:
    """Mean absolute z-score of the flagged rows per feature."""
    d = z_scores(df, features).where(F.col(flag)).select(F.inline("z"))
    return (d.groupBy("feature").agg(F.round(F.avg("abs_z"), 6).alias("mean_abs_z_score"))
            .orderBy(F.desc("mean_abs_z_score"), "feature").limit(top))


def rate(df: DataFrame, flag: str) -> DataFrame:
    one = df.agg(F.count_if(F.col(flag)).alias("anomaly_count"),
                 F.round(100.0 * F.count_if(F.col(flag)) / F.count("*"), 4).alias("anomaly_pct"))
    return one.withColumn("level", band(F.col("anomaly_pct"), [(10, "High"), (4, "Moderate")], "Low", strict=True))


def per_cluster(df: DataFrame, flag: str, cluster: str) -> DataFrame:
    return df.where(F.col(flag)).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("anomalies"))


def most_affected(counts: DataFrame) -> DataFrame:
    return counts.agg(F.max_by("cluster", F.struct("anomalies", -F.col("cluster"))).alias("most_affected"),
                      F.max("anomalies").alias("anomalies"), F.count("*").alias("clusters_touched"))


def with_cluster_context(top: DataFrame, distinct: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Per anomaly: which deviations its cluster explains and which are new.

    `top` has (key, cluster, feature) rows, `distinct` and `labels` one row per cluster feature.
    """
    mine = top.groupBy(key, "cluster").agg(F.sort_array(F.collect_set("feature")).alias("mine"),
                                           F.first("anomaly_score").alias("anomaly_score"))
    own = distinct.groupBy("cluster").agg(F.sort_array(F.collect_set("feature")).alias("own"))
    d = mine.join(F.broadcast(own), "cluster", "left").join(F.broadcast(labels), "cluster", "left")
    own0 = F.coalesce("own", F.array().cast("array<string>"))
    overlap, novel = F.array_intersect("mine", own0), F.array_except("mine", own0)
    return d.select(key, "cluster", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("cluster_label"),
                    "anomaly_score", F.array_join(overlap, ",").alias("cluster_pattern_overlap"),
                    F.array_join(novel, ",").alias("novel_deviations"),
                    F.when((F.size(overlap) > 0) & (F.size(novel) == 0), "cluster_consistent").otherwise("novel_pattern").alias("reading"))

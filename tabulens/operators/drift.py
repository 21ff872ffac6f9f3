"""Early against late rows: distribution drift and trends over an explicit row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pvalues import correlation_p, ks_p
from ..functions.scalars import pct_change
from ..session import cut_lineage
from .quantiles import order_boundary, split_ends
from .ranks import ONE_TASK_ROWS, ordered_places, running_totals, spearman


def two_sample(sides: DataFrame, features: Sequence[str], rows: int, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """KS statistic and mean shift per feature between rows marked early and late."""
    items = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]
    long = sides.select("side", F.inline(F.array(*items))).where("v is not null")
    freq = long.groupBy("feature", "v").agg(F.count_if(F.col("side") == "early").alias("e"),
                                            F.count_if(F.col("side") == "late").alias("l"))
    cum = running_totals(freq, "feature", "v", ["e", "l"], rows, one_task)
    tot = long.groupBy("feature").agg(
        F.count_if(F.col("side") == "early").alias("n_early"), F.count_if(F.col("side") == "late").alias("n_late"),
        F.avg(F.when(F.col("side") == "early", F.col("v"))).alias("me"),
        F.avg(F.when(F.col("side") == "late", F.col("v"))).alias("ml"),
        F.stddev_samp(F.when(F.col("side") == "early", F.col("v"))).alias("sd"))
    ks = cum.join(F.broadcast(tot), "feature")  # one row per feature
    ks = ks.groupBy("feature").agg(F.max(F.abs(F.col("e_upto") / F.col("n_early") - F.col("l_upto") / F.col("n_late"))).alias("ks"))
    return tot.join(F.broadcast(ks), "feature")


def drift(df: DataFrame, features: Sequence[str], order_by: Sequence[str], fraction: float = 0.20,
          one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """One row per feature with statistic, shift and whether it counts as drift."""
    n = df.count()
    sides = split_ends(df.select(*order_by, *[f for f in features if f not in order_by]), order_by, fraction, rows=n)
    d = two_sample(sides, features, n, one_task)
    shift = F.col("ml") - F.col("me")
    norm = F.abs(shift) / F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    p = ks_p(F.col("ks"), F.col("n_early").cast("double"), F.col("n_late").cast("double"))
    enough = F.lit(n >= 40) & (F.col("n_early") >= 5) & (F.col("n_late") >= 5)
    return d.select(
        "feature", F.round("ks", 4).alias("ks_statistic"), F.round(p, 6).alias("p_value"),
        F.round("me", 4).alias("mean_early"), F.round("ml", 4).alias("mean_late"), F.round(shift, 4).alias("mean_shift"),
        F.round(norm, 4).alias("normalised_shift"), F.when(shift > 0, "increased").otherwise("decreased").alias("direction"),
        F.when(norm > 1.0, "high").otherwise("medium").alias("severity"),
        (enough & (p < 0.05) & (norm > 0.30)).alias("drifted"))


def row_positions(df: DataFrame, keys: Sequence[str], rows: int, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """Add `position` (from 0) in the order of unique keys: one window for small tables, else
    numbered ranges (see ranks.ordered_places)."""
    if rows <= one_task:
        return cut_lineage(df.withColumn("position", F.row_number().over(W.orderBy(*keys)).cast("long") - 1))  # read several times
    return ordered_places(df, keys, "position").withColumn("position", F.col("position") - 1)


def trends(df: DataFrame, features: Sequence[str], order_by: Sequence[str], target: str | None = None,
           fraction: float = 0.20, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """Rank correlation of each feature with the row order, and its early and late means."""
    n = df.count()
    cols = [f for f in features if f not in order_by]
    placed = row_positions(df.select(*order_by, *cols), order_by, n, one_task)
    rho = spearman(placed, [("position", f) for f in features], n, one_task, places=["position"])
    window = max(int(n * fraction), 10)
    early, late = F.col("position") < window, F.col("position") >= n - window
    means = placed.agg(*[F.avg(F.when(w, F.col(f).cast("double"))).alias(f"{k}{i}") for i, f in enumerate(features) for k, w in (("e", early), ("l", late))])
    means = means.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"e{i}").alias("em"), F.col(f"l{i}").alias("lm")) for i, f in enumerate(features)])))
    d = rho.withColumnRenamed("feature_b", "feature").join(F.broadcast(means), "feature")  # one row per feature
    p = correlation_p(F.col("spearman_r"), F.col("n").cast("double"))
    return d.select(
        "feature", "n", F.round("spearman_r", 4).alias("spearman_r"),
        F.when(F.col("spearman_r") > 0, "upward").otherwise("downward").alias("direction"),
        F.round(pct_change(F.col("em"), F.col("lm")), 2).alias("pct_change"),
        F.round("em", 4).alias("early_mean"), F.round("lm", 4).alias("late_mean"),
        (F.col("feature") == F.lit(target or "")).alias("is_target"),
        ((F.abs("spearman_r") >= 0.25) & (p < 0.05) & (F.col("n") >= 20)).alias("trending"))


def chronological_split(df: DataFrame, order_by: Sequence[str], train_share: float = 0.80) -> DataFrame:
    """Column `part`: the first share of the ordered rows is train, the rest test."""
    n = df.count()
    first = order_boundary(df, order_by, int(n * train_share))
    return df.withColumn("part", F.when(first, "train").otherwise("test"))

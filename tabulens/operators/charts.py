"""Data series behind charts. No styling: labels and numbers only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CHART_PRIORITIES, SEVERITIES
from ..functions.scalars import finite
from .ranks import cumulative_share, number_rows
from .sampling import hash_sample
from .stats import pearson


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram with empty bins kept; the last edge belongs to the last bin.

    One pass for the range, one for the counts; the bin table has at most `bins` rows.
    """
    v = finite(F.col(col).cast("double"))
    one = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    spark, n, lo, hi = df.sparkSession, one["n"], one["lo"], one["hi"]
    if n == 0:
        return spark.createDataFrame([], "bin long, lower double, upper double, n long")
    if abs(hi - lo) <= 1e-12 * max(abs(lo), abs(hi), 1.0):
        return spark.createDataFrame([(0, lo, hi, n)], "bin long, lower double, upper double, n long")
    k = min(bins, n)
    width = (hi - lo) / k
    place = F.least(F.floor((v - lo) / width), F.lit(k - 1)).cast("long")
    got = df.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    spine = spark.range(k).select(F.col("id").alias("bin"))
    return spine.join(F.broadcast(got), "bin", "left").select(
        "bin", F.round(lo + F.col("bin") * width, 4).alias("lower"), F.round(lo + (F.col("bin") + 1) * width, 4).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"))


def normalize_importance(df: DataFrame, payload: str) -> DataFrame:
    """Importance rows from JSON in any of the accepted shapes: first non-zero of impact_pct, impact, importance."""
    pick = lambda k: F.get_json_object(payload, f"$.{k}")
    num = lambda k: F.nullif(pick(k), F.lit("0"))
    raw = F.coalesce(num("impact_pct"), num("impact"), num("importance"), F.lit("0"))
    val = F.round(F.coalesce(finite(raw.try_cast("double")), F.lit(0.0)), 4)
    return df.select(F.coalesce(pick("feature"), pick("name"), F.lit("unknown")).alias("feature"), val.alias("impact_pct"),
                     F.coalesce(pick("direction"), F.lit("unknown")).alias("direction"))


def importance_series(importance: DataFrame, chart: str) -> DataFrame:
    """bars (all), doughnut (top 6), decay (all, with step to the next), cumulative, radar (4 to 12 features)."""
    d = importance.select("rank", F.col("feature").alias("label"), F.col("impact_pct").alias("value"))
    if chart == "doughnut":
        return d.where("rank <= 6")
    if chart == "cumulative":
        d = cumulative_share(d, "rank", "value")
        return d.select("rank", "label", F.round("cumulative", 2).alias("value"), F.lit(80.0).alias("threshold"),
                        (F.round("cumulative", 4) >= 80).alias("reached"))
    return d


def suggestions(conc: DataFrame, spread: DataFrame, rows: DataFrame) -> DataFrame:
    """Which importance charts apply, best first, at most eight. Inputs are single rows:
    concentration, (impact_std), (n_rows)."""
    d = conc.join(F.broadcast(spread), F.lit(True)).join(F.broadcast(rows), F.lit(True))
    n = F.col("n_features")
    rules: list[tuple[str, Column, Column, str]] = [
        ("impact_ranking", F.when(n <= 10, "horizontalBar").otherwise("bar"), n >= 1, "critical"),
        ("weight_allocation", F.lit("doughnut"), (F.col("top2_pct") > 50) & (n >= 4), "high"),
        ("cumulative_power", F.lit("line"), n >= 4, "high"),
        ("decay_curve", F.lit("line"), n >= 5, "medium"),
        ("decision_profile", F.lit("radar"), n.between(4, 12), "high"),
        ("top_interaction", F.lit("scatter"), (F.col("n_rows") >= 50) & (n >= 2), "medium"),
        ("balanced_distribution", F.lit("polarArea"), (F.col("impact_std") < 15) & (n >= 5), "medium"),
        ("lever_comparison", F.lit("bar"), n.between(5, 10), "low"),
    ]
    items = F.array(*[F.when(c, F.struct(F.lit(i).alias("seq"), F.lit(name).alias("chart_id"), kind.alias("chart_type"),
                                         F.lit(p).alias("priority"))) for i, (name, kind, c, p) in enumerate(rules)])
    got = d.select(F.inline(F.filter(items, lambda x: x.isNotNull())))
    order = F
    for i, p in enumerate(CHART_PRIORITIES):
        order = order.when(F.col("priority") == p, i)
    return number_rows(got, [order.otherwise(99), "seq"], "place").where("place <= 8").drop("seq")


def unique_charts(charts: DataFrame, top: int = 10) -> DataFrame:
    """First chart of each id in sequence order, at most ten."""
    from pyspark.sql import Window as W

    first = charts.withColumn("_r", F.row_number().over(W.partitionBy("chart_id").orderBy("seq"))).where("_r = 1").drop("_r")
    return number_rows(first.orderBy("seq").limit(top), ["seq"], "place")


def scatter_sample(df: DataFrame, x: str, y: str, key: Sequence[str], n: int = 100, color: str | None = None) -> DataFrame:
    """Up to n finite points, chosen by the hash of the key."""
    d = df.withColumns({"_x": finite(F.col(x).cast("double")), "_y": finite(F.col(y).cast("double"))})
    d = hash_sample(d.where("_x is not null and _y is not null"), key, n)
    cols = [F.col("_x").alias("x"), F.col("_y").alias("y")] + ([F.col(color).alias("color")] if color else [])
    return d.select(*key, *cols)


def correlation_bars(df: DataFrame, features: Sequence[str], target: str, top: int = 10) -> DataFrame:
    rows = pearson(df, [(f, target) for f in features if f != target])
    return (rows.where("not isnan(r)").select(F.col("feature_a").alias("label"), F.round(F.abs("r"), 4).alias("value"))
            .orderBy(F.desc("value"), "label").limit(top))


def count_series(d: DataFrame, col: str, order: Sequence[str] | None = None) -> DataFrame:
    """Counts per value, in the given or alphabetical order, with chart labels."""
    got = d.groupBy(col).agg(F.count("*").alias("value"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col)) if order else F.lit(0)
    return number_rows(got.select(F.initcap(col).alias("label"), "value", place.alias("_p")), ["_p", "label"], "place").drop("_p")


def severity_series(findings: DataFrame) -> DataFrame:
    return count_series(findings, "severity", SEVERITIES)


def leaderboard_series(board: DataFrame, name: str, score: str, top: int = 10, percent: bool = False) -> DataFrame:
    val = F.round(F.col(score) * (100 if percent else 1), 2 if percent else 6)
    return board.where("status = 'success'").orderBy("rank").limit(top).select("rank", F.col(name).alias("label"), val.alias("value"))


def metric_cards(rows: DataFrame, metrics: Sequence[tuple[str, str]]) -> DataFrame:
    """One row of metrics as (position, title, value)."""
    return rows.select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(t).alias("title"),
                                                   F.col(c).cast("double").alias("value")) for i, (t, c) in enumerate(metrics)])))

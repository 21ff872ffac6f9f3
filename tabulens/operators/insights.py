"""Insight layers: rule rows over the same evidence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank
from .findings import text
from .profile import column_profile
from .ranks import number_rows

PER_LAYER = 5


def make(d: DataFrame, iid, layer: str, severity, title, value, novelty, source: str = "combined") -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return d.select(col(iid).alias("insight_id"), F.lit(layer).alias("layer"), col(severity).alias("severity"),
                    col(title).alias("title"), F.round(col(value).cast("double"), 4).alias("value"),
                    F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(novelty).cast("double"))), 2).alias("novelty_score"),
                    F.lit(source).alias("source"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- evidence used by several layers ---------------------------------------------------------

def population_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Shape flags per numeric column: skewed, heavy tail, bimodal hint, high variance."""
    cells = [x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"n{i}"), F.skewness(c).alias(f"g{i}"), F.kurtosis(c).alias(f"k{i}"),
        (F.stddev_samp(c) / F.greatest(F.abs(F.avg(c)), F.lit(1e-9))).alias(f"v{i}"))]
    rows = df.agg(*cells).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"),
        F.col(f"g{i}").alias("g"), F.col(f"k{i}").alias("k"), F.col(f"v{i}").alias("cv0")) for i, c in enumerate(cols)])))
    n = F.col("n")
    sk = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1.0)) / (n - 2))
    return rows.where("n >= 15").select(
        "feature", F.round(sk, 3).alias("skew"), F.round("k", 3).alias("kurtosis"), F.round("cv0", 3).alias("cv"),
        (F.abs(sk) > 1.5).alias("skewed"), (F.col("k") > 3).alias("heavy_tail"),
        ((F.col("cv0") > 0.6) & (F.abs(sk) < 0.5) & (n >= 40)).alias("bimodal_hint"), (F.col("cv0") > 1).alias("high_variance"))


def target_summary(df: DataFrame, target: str, task: str) -> DataFrame:
    c = F.col(target)
    if task == "classification":
        per = df.where(c.isNotNull()).groupBy(c).agg(F.count("*").alias("k"))
        none = F.lit(None).cast("double")
        return per.agg(F.lit(target).alias("target"), F.count("*").alias("n_classes"),
                       F.round(F.min("k") * 100.0 / F.sum("k"), 2).alias("minority_share_pct"),
                       *[F.first(none).alias(x) for x in ("mean", "std", "min", "max", "skew")])
    n = F.count(c)
    skew = F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2)).otherwise(0.0)
    return df.agg(F.lit(target).alias("target"), F.first(F.lit(None).cast("long")).alias("n_classes"),
                  F.first(F.lit(None).cast("double")).alias("minority_share_pct"), F.round(F.avg(c), 4).alias("mean"),
                  F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).cast("double").alias("min"),
                  F.max(c).cast("double").alias("max"), F.round(skew, 6).alias("skew"))


def concentration(importance: DataFrame) -> DataFrame:
    """One row: shares of the top features, features to reach 80%, long tail."""
    cum = F.sum("impact_pct").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    d = importance.withColumn("cum", F.round(cum, 4))
    p, r = F.col("impact_pct"), F.col("rank")
    return d.agg(F.count("*").alias("n_features"), F.round(F.sum(F.when(r <= 2, p)), 2).alias("top2_pct"),
                 F.round(F.sum(F.when(r <= 3, p)), 2).alias("top3_pct"),
                 F.coalesce(F.min(F.when(F.col("cum") >= 80, r)), F.count("*")).alias("n_for_80"),
                 F.count_if(p < 1).alias("n_low"), F.round(F.coalesce(F.sum(F.when(p < 1, p)), F.lit(0.0)), 2).alias("low_pct"),
                 F.count_if((F.col("direction") == "positive") & (r <= 8)).alias("n_positive"),
                 F.count_if((F.col("direction") == "negative") & (r <= 8)).alias("n_negative"),
                 F.max(F.when(r == 1, F.col("feature"))).alias("top_feature"), F.max(F.when(r == 1, p)).alias("top_pct"))


# --- layers ----------------------------------------------------------------------------------

def performance_classification(metrics: DataFrame, reliability: DataFrame) -> DataFrame:
    d = metrics.join(F.broadcast(reliability), F.lit(True))  # one row each
    lv = F.col("level")
    sev = F.when(lv == "High", "info").when(lv == "Moderate", "medium").otherwise("critical")
    head = make(d, "perf_classification_overview", "performance", sev, text("Classification performance: ", lv, " reliability"),
                F.col("f1_macro"), 0.3, "supervised")
    bal = F.col("accuracy") - F.col("balanced_accuracy")
    masked = make(d.where(bal > 0.08), "perf_accuracy_masks_classes", "performance", "medium",
                  "Accuracy hides weak classes", bal, 0.3, "supervised")
    gap = F.col("f1_weighted") - F.col("f1_macro")
    imb = make(d.where((gap > 0.10) & (F.col("f1_macro") > 0)), "perf_imbalance_gap", "performance", "high",
               "Weighted F1 exceeds macro F1", gap, F.when(gap > 0.15, 0.65).otherwise(0.55), "supervised")
    return union([head, masked, imb])


def performance_regression(metrics: DataFrame) -> DataFrame:
    r2 = F.col("r2")
    ratio = F.when(F.col("mae") > 0, F.col("rmse") / F.col("mae")).otherwise(1.0)
    sev = F.when(r2 >= 0.80, "info").when(r2 >= 0.55, "medium").otherwise("critical")
    kind = F.when(ratio > 2.0, " with large outlier errors").when(ratio < 1.2, " with even errors").otherwise("")
    return make(metrics, "perf_regression_overview", "performance", sev, text("Regression performance", kind), r2,
                F.when(ratio > 2, 0.45).otherwise(0.3), "supervised")


def feature_layer(conc: DataFrame) -> DataFrame:
    n = F.col("n_features")
    top = F.coalesce("top3_pct", "top_pct")
    return union([
        make(conc.where(n > 0), "feature_driver_hierarchy", "feature", "info", text("Main driver is '", F.col("top_feature"), "'"),
             top, F.when(top > 80, 0.55).otherwise(0.4), "supervised"),
        make(conc.where((F.col("n_for_80") <= 2) & (n > 5)), "feature_concentration_risk", "feature", "high",
             "Few features carry 80% of the signal", F.col("n_for_80"), 0.65, "supervised"),
        make(conc.where("n_positive > 0 and n_negative > 0"), "feature_directional_split", "feature", "info",
             "Features push in both directions", F.col("n_positive"), 0.5, "supervised"),
        make(conc.where(F.col("n_low") > n * 0.5), "feature_long_tail", "feature", "low", "Long tail of weak features",
             F.col("n_low"), 0.4, "supervised")])


def population_layer(shape: DataFrame, target: str | None = None) -> DataFrame:
    sk = shape.where("skewed").agg(F.count("*").alias("k"), F.max_by("feature", F.abs("skew")).alias("f"))
    ht = shape.where("heavy_tail").agg(F.count("*").alias("k"), F.max_by("feature", "kurtosis").alias("f"))
    bm = shape.where("bimodal_hint").orderBy("feature").limit(1)
    parts = [make(sk.where("k > 0"), "pop_skewed_features", "population", "medium", text("Skewed features, worst '", F.col("f"), "'"),
                  F.col("k"), F.when(F.col("k") > 4, 0.55).otherwise(0.45)),
             make(ht.where("k > 0"), "pop_heavy_tails", "population", "medium", text("Heavy tails, worst '", F.col("f"), "'"), F.col("k"), 0.5),
             make(bm, "pop_bimodality_hint", "population", "low", text("'", F.col("feature"), "' may be bimodal"), F.col("cv"), 0.65)]
    if target:
        parts.append(make(shape.where((F.col("feature") == target) & F.col("high_variance")), "pop_target_high_variance", "population",
                          "medium", "Target varies widely", F.col("cv"), 0.5, "supervised"))
    return union(parts)


def pattern_layer(pairs: DataFrame, nonlinear: DataFrame | None = None) -> DataFrame:
    best = F.max_by(F.concat("feature_a", F.lit(" / "), "feature_b"), F.struct(F.abs("r"), "feature_a", "feature_b"))
    multi = pairs.where("grade = 'multicollinear'").agg(F.count("*").alias("k"), best.alias("f"))
    mod = pairs.where("grade = 'moderate'").agg(F.count("*").alias("k"))
    parts = [make(multi.where("k > 0"), "pattern_multicollinearity", "pattern", "high", text("Collinear pair ", F.col("f")), F.col("k"), 0.60),
             make(mod.where("k > 0"), "pattern_feature_correlations", "pattern", "low", "Moderate feature correlations", F.col("k"), 0.35)]
    if nonlinear is not None:
        nl = nonlinear.where("nonlinear").orderBy(F.desc("lift"), "feature").limit(1)
        parts.append(make(nl, "pattern_nonlinearity", "pattern", "medium", text("'", F.col("feature"), "' acts non-linearly"), F.col("lift"),
                          F.when(F.col("lift") > 0.20, 0.75).otherwise(0.65), "supervised"))
    return union(parts)


def segment_layer(quality: DataFrame, sizes: DataFrame, contrast: DataFrame) -> DataFrame:
    lv = F.col("level")
    sev = F.when(lv == "High", "info").when(lv == "Moderate", "medium").otherwise("critical")
    top = contrast.orderBy(F.desc("norm_range"), "feature").limit(1)
    big = sizes.orderBy(F.desc("size"), "cluster").limit(1)
    return union([
        make(quality, "segment_quality_overview", "segment", sev, text("Segmentation quality: ", lv), F.col("silhouette"), 0.35, "unsupervised"),
        make(big.where("size_pct > 50"), "segment_dominant_cluster", "segment", "medium",
             text("Cluster ", F.col("cluster").cast("string"), " holds most rows"), F.col("size_pct"), 0.45, "unsupervised"),
        make(top, "segment_sharpest_contrast", "segment", "info", text("Sharpest contrast on '", F.col("feature"), "'"),
             F.col("norm_range"), 0.55, "unsupervised")])


def anomaly_layer(rate: DataFrame, drivers: DataFrame, affected: DataFrame) -> DataFrame:
    lv = F.col("level")
    first = drivers.orderBy(F.desc("mean_abs_z_score"), "feature").limit(1)
    return union([
        make(rate.where("anomaly_count > 0"), "anomaly_rate_overview", "anomaly",
             F.when(lv == "High", "high").when(lv == "Moderate", "medium").otherwise("info"), text("Anomaly rate: ", lv),
             F.col("anomaly_pct"), F.when(lv == "High", 0.7).otherwise(0.5), "unsupervised"),
        make(first, "anomaly_feature_drivers", "anomaly", "medium", text("Anomalies deviate on '", F.col("feature"), "'"),
             F.col("mean_abs_z_score"), 0.60, "unsupervised"),
        make(affected.where("anomalies >= 2"), "anomaly_cluster_colocation", "anomaly", "medium",
             text("Anomalies gather in cluster ", F.col("most_affected").cast("string")), F.col("anomalies"), 0.60, "unsupervised")])


def temporal_layer(trends: DataFrame) -> DataFrame:
    hit = trends.where("trending")
    top = hit.orderBy(F.desc(F.abs("spearman_r")), "feature").limit(1)
    t, r = F.col("is_target"), F.abs("spearman_r")
    others = hit.where("not is_target").agg(F.least(F.count("*"), F.lit(3)).alias("k"))
    return union([
        make(top, "temporal_trend_detected", "temporal", F.when(t & (r > 0.5), "high").otherwise("medium"),
             text(F.when(t, "Target").otherwise("Feature"), F.lit(" '"), F.col("feature"), "' drifts ", F.col("direction")),
             F.col("spearman_r"), F.when(t, 0.75).otherwise(0.60)),
        make(others.where("k >= 2"), "temporal_multi_feature_drift", "temporal", "medium", "Several features drift together", F.col("k"), 0.65)])


def risk_layer(conc: DataFrame, reliability: DataFrame, rate: DataFrame, drift: DataFrame) -> DataFrame:
    lv = F.col("level")
    k = drift.where("drifted").agg(F.count("*").alias("k"))
    return union([
        make(conc.where("top_pct > 50"), "risk_leakage_warning", "risk", "critical", text("Leakage risk: '", F.col("top_feature"), "'"),
             F.col("top_pct"), 0.80, "supervised"),
        make(reliability.where(lv == "Low"), "risk_deployment_not_ready", "risk", "critical", "Model is not ready for use",
             F.col("confidence_score"), 0.50),
        make(k.where("k >= 2"), "risk_drift_performance_decay", "risk", "high", "Drift in several features", F.col("k"), 0.65),
        make(reliability.where(lv == "High"), "opp_decision_automation", "risk", "info", "Reliable enough to automate decisions",
             F.col("confidence_score"), 0.50, "supervised"),
        make(rate.where(lv.isin("High", "Moderate") & (F.col("anomaly_pct") > 0)), "opp_anomaly_investigation", "risk", "medium",
             "Flagged rows are worth a review", F.col("anomaly_pct"), 0.55, "unsupervised")])


def combine(layers: Sequence[DataFrame]) -> DataFrame:
    """All layers in one ranked table: at most five per layer, ids unique by their first 40 characters."""
    d = union(layers)
    order = [severity_rank(F.col("severity")), F.desc("novelty_score"), "layer", "insight_id"]
    d = d.withColumn("_k", F.row_number().over(W.partitionBy("layer").orderBy(*order))).where(F.col("_k") <= PER_LAYER)
    d = d.withColumn("_d", F.row_number().over(W.partitionBy(F.substring("insight_id", 1, 40)).orderBy(*order))).where("_d = 1")
    return number_rows(d.drop("_k", "_d"), order)


def layer_summary(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("layer").agg(F.count("*").alias("n"), F.min_by("title", "rank").alias("key_title"))


def risk_flags(ranked: DataFrame) -> DataFrame:
    """Risks (critical, high) and opportunities of the risk layer."""
    opp = F.col("insight_id").startswith("opp_") & F.col("severity").isin("info", "low", "medium")
    kind = F.when(F.col("severity").isin("critical", "high"), "risk").when(opp, "opportunity")
    return ranked.where("layer = 'risk'").withColumn("kind", kind).where("kind is not null").select("kind", "insight_id", "severity", "title")


def supervised_cards(reliability: DataFrame, conc: DataFrame, report: DataFrame, target_share: DataFrame) -> DataFrame:
    """Result cards of a classification run."""
    lv = F.col("level")
    sev = F.when(lv == "High", "success").when(lv == "Moderate", "warning").otherwise("danger")
    card = lambda d, cid, val, num, s: d.select(F.lit(cid).alias("card"), val.alias("shown"), num.cast("double").alias("value"), s.alias("severity"))
    weak = report.agg(F.min_by("label", F.struct("f1", "label")).alias("l"), F.min("f1").alias("f"))
    return union([
        card(reliability, "model_reliability", lv, F.col("confidence_score"), sev),
        card(conc, "primary_driver", F.col("top_feature"), F.col("top_pct"), F.lit("success")),
        card(weak, "weakest_class", F.col("l"), F.round("f", 4), F.lit("warning")),
        card(target_share.where("minority_share_pct < 10"), "class_imbalance", F.lit("minority class"), F.col("minority_share_pct"), F.lit("warning"))])


def cluster_cards(quality: DataFrame, separation: DataFrame, sizes: DataFrame, rate: DataFrame) -> DataFrame:
    """Result cards of a clustering run."""
    lv = F.col("level")
    card = lambda d, cid, val, num, s: d.select(F.lit(cid).alias("card"), val.alias("shown"), num.cast("double").alias("value"), s.alias("severity"))
    span = sizes.agg(F.max("size_pct").alias("hi"), F.min("size_pct").alias("lo"), F.max("size").alias("a"), F.min("size").alias("b"))
    return union([
        card(quality, "cluster_quality", lv, F.col("silhouette"), F.when(lv == "High", "success").when(lv == "Moderate", "warning").otherwise("danger")),
        card(separation.where("rank = 1"), "primary_cluster_driver", F.col("feature"), F.col("impact_pct"), F.lit("success")),
        card(span, "cluster_size_pattern", F.lit("largest share"), F.col("hi"), F.when(F.col("a") >= 10 * F.greatest("b", F.lit(1)), "warning").otherwise("success")),
        card(span, "segment_balance", F.lit("share gap"), F.round(F.col("hi") - F.col("lo"), 2), F.when(F.col("hi") - F.col("lo") > 50, "warning").otherwise("success")),
        card(rate, "anomaly_detection", lv, F.col("anomaly_pct"), F.when(lv == "High", "danger").when(lv == "Moderate", "warning").otherwise("success"))])


def profile_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return column_profile(df, cols)

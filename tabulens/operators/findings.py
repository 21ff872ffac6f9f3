"""Root-cause findings: rule rows over evidence tables.

Evidence tables are small (one row per feature, pair, class or cluster). Every builder
returns the same columns, so findings are joined by union and ranked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import LEAKAGE_TERMS, SEVERITIES
from ..functions.scalars import severity_rank
from .ranks import number_rows

COLUMNS = ["finding_id", "category", "severity", "confidence", "source", "title", "value", "action"]


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def make(d: DataFrame, fid, category: str, severity, confidence, source, title, value, action: str) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return d.select(col(fid).alias("finding_id"), F.lit(category).alias("category"), col(severity).alias("severity"),
                    col(confidence).alias("confidence"), col(source).alias("source"), col(title).alias("title"),
                    F.round(col(value).cast("double"), 4).alias("value"), F.lit(action).alias("action"))


def feature_findings(importance: DataFrame, correlations: DataFrame) -> DataFrame:
    """Dominant feature, share of the top three, strongest linear links."""
    f, p = F.col("feature"), F.col("impact_pct")
    dominant = make(importance.where((F.col("rank") == 1) & (p >= 35)), "feature_dominance", "feature_signal",
                    F.when(p >= 55, "critical").otherwise("high"), "high", "supervised",
                    text("Feature '", f, "' dominates the model"), p, "Audit the dominant feature")
    top = importance.where(F.col("rank") <= 3).agg(F.sum("impact_pct").alias("s"), F.count("*").alias("k"))
    three = make(top.where("k >= 2"), "top_driver_cluster", "feature_signal", "medium", "high", "supervised",
                 text("Top-", F.col("k").cast("string"), " features carry most of the signal"), F.col("s"), "Monitor the top features")
    a = F.col("feature_a")
    links = make(correlations.where(F.col("type") == "feature_target").orderBy(F.desc("abs_r"), "feature_a").limit(3),
                 text("correlation_", a), "feature_signal", "low", "moderate", "supervised",
                 text("Linear link of '", a, "' with the target"), F.col("pearson_r"), "Validate the causal direction")
    return dominant.unionByName(three).unionByName(links)


def leakage_findings(importance: DataFrame, target: str) -> DataFrame:
    """Features that may encode the target: shared name, suspicious term, extreme share."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[_-]", "")
    name, goal = plain(F.col("feature")), target.lower().replace("_", "").replace("-", "")
    overlap = F.contains(name, F.lit(goal)) | F.contains(F.lit(goal), name)
    term = name.rlike("(" + "|".join(LEAKAGE_TERMS) + ")")
    extreme = F.col("impact_pct") >= 50
    d = importance.where(F.col("rank") <= 10).where(overlap | (term & (F.col("impact_pct") >= 25)) | extreme)
    return make(d, text("leakage_proxy_risk_", F.substring(name, 1, 30)), "leakage_risk",
                F.when(extreme | overlap, "critical").otherwise("high"), F.when(overlap, "high").otherwise("moderate"),
                "supervised", text("Possible leakage through '", F.col("feature"), "'"), F.col("impact_pct"),
                "Audit the feature before deployment")


def confusion_findings(pairs: DataFrame, weakness: DataFrame) -> DataFrame:
    """Main confusion pair and the weakest class."""
    a, p, r = F.col("actual"), F.col("predicted"), F.col("confusion_rate")
    main = make(pairs.orderBy(F.desc("confusion_count"), "actual", "predicted").limit(1), "primary_class_confusion",
                "class_confusion", F.when(r > 0.4, "critical").when(r > 0.25, "high").otherwise("medium"), "high", "supervised",
                text("'", a, "' is labelled as '", p, "'"), r, "Separate the two classes with a new feature")
    weak = weakness.where("weakness_type <> 'acceptable'").orderBy(F.desc("error_rate"), "label").limit(1)
    worst = make(weak, "weakest_class_rca", "class_confusion", F.when(F.col("f1") < 0.35, "high").otherwise("medium"),
                 "high", "supervised", text("Weak class '", F.col("label"), "' (", F.col("weakness_type"), ")"),
                 F.col("error_rate"), "Collect more rows of the weak class")
    return main.unionByName(worst)


def residual_findings(residual: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Bias, heteroscedasticity, error concentration, features left in the residuals."""
    out = make(residual.where("bias_type <> 'unbiased'"), "systematic_bias", "model_error", "high", "high", "supervised",
               text("Bias: ", F.col("bias_type")), F.col("mean_residual"), "Add offset features or calibrate")
    out = out.unionByName(make(residual.where("heteroscedastic"), "heteroscedasticity", "model_error", "medium", "moderate",
                               "supervised", "Error size follows the predicted value", F.col("hetero_r"), "Transform the target"))
    worse = F.when(F.col("error_concentration") == "high_value_range", F.col("high_pred_mean_abs_error")).otherwise(F.col("low_pred_mean_abs_error"))
    out = out.unionByName(make(residual.where("error_concentration <> 'uniform'"), "error_concentration", "model_error", "medium",
                               "moderate", "supervised", text("Errors sit in the ", F.col("error_concentration")), worse, "Sample the weak range more"))
    if features is not None:
        f = features.orderBy(F.desc(F.abs("pearson_r")), "feature").limit(2)
        out = out.unionByName(make(f, text("residual_feature_corr_", F.col("feature")), "model_error", "medium", "moderate",
                                   "supervised", text("Residuals still follow '", F.col("feature"), "'"), F.col("pearson_r"),
                                   "Add non-linear forms of the feature"))
    return out


def cluster_findings(separation: DataFrame, balance: DataFrame, bipolar: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Main driver, size imbalance, one bipolar feature, anomalies gathered in one cluster."""
    f, p = F.col("feature"), F.col("impact_pct")
    out = make(separation.where("rank = 1"), "primary_segmentation_cause", "cluster_structure", "info",
               F.when(p > 25, "high").otherwise("moderate"), "unsupervised", text("'", f, "' separates the clusters most"), p,
               "Validate the meaning of the driver")
    r = F.col("imbalance_ratio")
    out = out.unionByName(make(balance.where(r >= 5), "cluster_size_imbalance", "cluster_structure",
                               F.when(r >= 10, "high").otherwise("medium"), "high", "unsupervised", "Cluster sizes are far apart", r,
                               "Inspect the small clusters"))
    one = bipolar.orderBy("feature").limit(1)
    out = out.unionByName(make(one, text("bipolar_feature_", f), "cluster_structure", "low", "moderate", "unsupervised",
                               text("'", f, "' splits clusters into high and low"), F.col("n_higher") + F.col("n_lower"), "Use the feature as a label axis"))
    if affected is not None:
        n = F.col("anomalies")
        out = out.unionByName(make(affected, "anomaly_cluster_concentration", "anomaly", F.when(n >= 5, "high").otherwise("medium"),
                                   "moderate", "unsupervised", text("Anomalies gather in cluster ", F.col("most_affected").cast("string")), n,
                                   "Review the profile of that cluster"))
    return out


def interaction_findings(rows: DataFrame) -> DataFrame:
    a, b, lift = F.col("feature_a"), F.col("feature_b"), F.col("interaction_lift")
    return make(rows.orderBy(F.desc("interaction_lift"), "feature_a", "feature_b").limit(3), text("interaction_", a, "_", b), "interaction",
                "medium", F.when(lift > 0.10, "moderate").otherwise("low"), "supervised",
                text("'", a, "' and '", b, "' act together"), lift, "Add the product of the two features")


def drift_findings(rows: DataFrame, target: str | None) -> DataFrame:
    f = F.col("feature")
    is_t = f == F.lit(target or "")
    return make(rows.where("drifted").orderBy(F.desc("normalised_shift"), "feature").limit(3), text("drift_", f), "drift", F.col("severity"),
                F.when(F.col("severity") == "high", "high").otherwise("moderate"), F.when(is_t, "supervised").otherwise("combined"),
                text(F.when(is_t, "Target").otherwise("Feature"), F.lit(" drift in '"), f, "'"), F.col("normalised_shift"), "Monitor drift and retrain")


def quality_findings(issues: DataFrame, important: DataFrame) -> DataFrame:
    """Six most pressing data-quality issues; severity only counts for the ten best features."""
    d = issues.orderBy(F.col("impact") != "high", severity_rank(F.col("severity")), "column_name", "issue_type").limit(6)
    keys = F.broadcast(important.where(F.col("rank") <= 10).select(F.col("feature").alias("column_name"), F.lit(True).alias("imp")))
    d = d.join(keys, "column_name", "left").withColumn("imp", F.coalesce("imp", F.lit(False)))
    c, kind = F.col("column_name"), F.col("issue_type")
    return make(d, text("dq_", kind, "_", c), "data_quality", F.when(F.col("imp"), F.col("severity")).otherwise("low"),
                F.when(F.col("imp"), "high").otherwise("moderate"), "combined", text("Data quality of '", c, "': ", kind), F.col("value"),
                "Review how the column is collected")


def rank_findings(d: DataFrame) -> DataFrame:
    """Severity first, then category, then id."""
    return number_rows(d, [severity_rank(F.col("severity")), "category", "finding_id"])


def priority_actions(ranked: DataFrame, top: int = 10) -> DataFrame:
    """First finding of each distinct action (by its first 60 characters), at most ten."""
    key = F.substring("action", 1, 60)
    d = ranked.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("rank"))).where("_r = 1").drop("_r")
    d = d.orderBy("rank").limit(top)
    return number_rows(d.select(F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title", F.lit(": "), "action").alias("entry"),
                                F.col("rank").alias("finding_rank")), ["finding_rank"], "place")


def overall_confidence(d: DataFrame, quality_level: str) -> DataFrame:
    share = F.count_if(F.col("confidence") == "high") / F.greatest(F.count("*"), F.lit(1))
    level = (F.when(F.lit(quality_level == "High") & (share >= 0.5), "high")
             .when(F.lit(quality_level in ("High", "Moderate")) & (share >= 0.3), "moderate").otherwise("low"))
    return d.agg(F.count("*").alias("n_findings"), F.round(share, 4).alias("high_share"), level.alias("confidence_level"))


def counts_by(d: DataFrame, col: str) -> DataFrame:
    return d.groupBy(col).agg(F.count("*").alias("n"))


def severity_summary(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n_total"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])


def causal_map(importance: DataFrame, correlations: DataFrame, inter: DataFrame) -> DataFrame:
    """Top ten features with their correlation and interaction evidence (all inputs one row per feature or pair)."""
    corr = correlations.where(F.col("type") == "feature_target").select(
        F.col("feature_a").alias("feature"), F.col("strength").alias("correlation_strength"), "pearson_r")
    pair = lambda a, b: F.struct(F.col(a).alias("feature"), F.col(b).alias("partner"), F.col("interaction_lift").alias("lift"))
    partners = (inter.select(F.inline(F.array(pair("feature_a", "feature_b"), pair("feature_b", "feature_a")))).groupBy("feature")
                .agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("lift")).alias("o"), "partner"))), 1, 2),
                                              lambda s: s["partner"]), ",").alias("interacts_with")))
    d = importance.where(F.col("rank") <= 10).join(F.broadcast(corr), "feature", "left").join(F.broadcast(partners), "feature", "left")
    return d.select("rank", "feature", F.col("impact_pct").alias("importance_pct"), "direction", F.lit("direct").alias("pathway"),
                    F.col("pearson_r").isNotNull().alias("corroborated_by_correlation"), "correlation_strength", "pearson_r",
                    F.col("interacts_with").isNotNull().alias("has_interaction_effect"), F.coalesce("interacts_with", F.lit("")).alias("interacts_with"))

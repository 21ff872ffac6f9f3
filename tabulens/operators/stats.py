"""Correlation, interaction, residual and between-cluster statistics.

Everything here is one or two aggregate passes; the results are tables with one row per
feature or pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pvalues import anova_p, correlation_p
from ..functions.scalars import band, importance_level, separation_level
from .quantiles import SMALL_ROWS, exact_quantiles
from .ranks import spearman

MIN_ROWS = 15
MODERATE, STRONG = 0.30, 0.55
PAIRS_PER_PASS = 400


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(feature_a, feature_b, n, r) over pairwise complete rows, one pass per 400 pairs."""
    out = None
    for i in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[i:i + PAIRS_PER_PASS]
        one = df.agg(*[x for j, (a, b) in enumerate(part) for x in (
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{j}"),
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{j}"))])
        rows = one.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                     F.col(f"n{j}").alias("n"), F.col(f"r{j}").alias("r")) for j, (a, b) in enumerate(part)])))
        out = rows if out is None else out.unionByName(rows)
    return out


def _graded(rows: DataFrame, kind: str, top: int | None) -> DataFrame:
    size = F.abs("r")
    d = (rows.where((F.col("n") >= MIN_ROWS) & ~F.isnan("r") & (size >= MODERATE)).select(
        "feature_a", "feature_b", "n", F.round("r", 4).alias("pearson_r"), F.round(size, 4).alias("abs_r"),
        band(size, [(STRONG, "strong")], "moderate").alias("strength"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"), F.lit(kind).alias("type")))
    d = d.orderBy(F.desc("abs_r"), "feature_a", "feature_b")
    return d if top is None else d.limit(top)


def feature_target(df: DataFrame, features: Sequence[str], target: str, top: int | None = 20) -> DataFrame:
    return _graded(pearson(df, [(f, target) for f in features if f != target]), "feature_target", top)


def feature_pairs(df: DataFrame, features: Sequence[str], top: int | None = 20) -> DataFrame:
    return _graded(pearson(df, list(combinations(features, 2))), "feature_feature", top)


def with_p(rows: DataFrame, r: str = "pearson_r") -> DataFrame:
    """Add two-sided p-values to a coefficient table (one row per pair)."""
    return rows.withColumn("p_value", F.round(correlation_p(F.col(r), F.col("n").cast("double")), 6))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long matrix (row, col, value), both triangles and the diagonal."""
    rows = pearson(df, list(combinations(features, 2))).select("feature_a", "feature_b", F.round("r", 4).alias("value"))
    cell = lambda a, b: F.struct(F.col(a).alias("row"), F.col(b).alias("col"), "value")
    both = rows.select(F.inline(F.array(cell("feature_a", "feature_b"), cell("feature_b", "feature_a"))))
    diag = df.agg(*[F.count(f).alias(f"n{i}") for i, f in enumerate(features)]).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("row"), F.lit(f).alias("col"), F.when(F.col(f"n{i}") > 1, 1.0).alias("value"))
        for i, f in enumerate(features)])))
    return both.unionByName(diag)


def pair_bands(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature pairs graded multicollinear (>= 0.80) or moderate (>= 0.35)."""
    rows = pearson(df, list(combinations(features, 2)))
    return (rows.withColumn("grade", band(F.abs("r"), [(0.80, "multicollinear"), (0.35, "moderate")], "weak"))
            .where("grade <> 'weak' and not isnan(r)")
            .select("feature_a", "feature_b", F.round("r", 4).alias("r"), "grade"))


def nonlinear(df: DataFrame, features: Sequence[str], target: str, rows: int | None = None) -> DataFrame:
    """Features whose rank correlation beats the linear one by more than 0.10."""
    pairs = [(f, target) for f in features]
    lin = pearson(df, pairs).select("feature_a", F.col("r").alias("pearson_r"))
    mono = spearman(df, pairs, rows)
    d = mono.join(F.broadcast(lin), "feature_a")  # one row per feature
    lift = F.abs("spearman_r") - F.abs("pearson_r")
    return d.select(F.col("feature_a").alias("feature"), "n", F.round("pearson_r", 4).alias("pearson_r"),
                    F.round("spearman_r", 4).alias("spearman_r"), F.round(lift, 4).alias("lift"),
                    ((lift > 0.10) & (F.abs("spearman_r") >= 0.35) & (F.col("n") >= MIN_ROWS)).alias("nonlinear"))


def interactions(df: DataFrame, target: str, features: Sequence[str], keep_all: bool = False,
                 top: int = 8) -> DataFrame:
    """Pairs whose centred product follows the target more than either feature alone."""
    pairs = list(combinations(list(features)[:6], 2))
    d = df.select(*[F.col(c).cast("double").alias(c) for c in {target, *features}])
    full = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(target).isNotNull()
    m = d.agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        F.avg(F.when(full(a, b), F.col(a))).alias(f"a{i}"), F.avg(F.when(full(a, b), F.col(b))).alias(f"b{i}"))]).first()
    cells = []
    for i, (a, b) in enumerate(pairs):
        ok = full(a, b)
        y = F.when(ok, F.col(target))
        term = (F.col(a) - F.lit(m[f"a{i}"])) * (F.col(b) - F.lit(m[f"b{i}"]))
        cells += [F.count_if(ok).alias(f"n{i}"), F.corr(F.col(a), y).alias(f"ra{i}"),
                  F.corr(F.col(b), y).alias(f"rb{i}"), F.corr(term, y).alias(f"ri{i}")]
    rows = d.agg(*cells).select(F.inline(F.array(*[F.struct(
        F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"n{i}").alias("n"),
        F.col(f"ra{i}").alias("ra"), F.col(f"rb{i}").alias("rb"), F.col(f"ri{i}").alias("ri"))
        for i, (a, b) in enumerate(pairs)])))
    lift = F.abs("ri") - F.greatest(F.abs("ra"), F.abs("rb"))
    found = (lift > 0.05) & (F.abs("ri") >= MODERATE) & (F.col("n") >= MIN_ROWS)
    out = rows.select("feature_a", "feature_b", "n", F.round("ra", 4).alias("r_a_target"),
                      F.round("rb", 4).alias("r_b_target"), F.round("ri", 4).alias("r_interaction_target"),
                      F.round(lift, 4).alias("interaction_lift"), found.alias("interacts"),
                      band(F.abs("ri"), [(STRONG, "strong")], "moderate").alias("strength"))
    if keep_all:
        return out
    return out.where("interacts").drop("interacts").orderBy(
        F.desc("interaction_lift"), "feature_a", "feature_b").limit(top)


def residuals(df: DataFrame, actual: str, predicted: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """One row: bias, spread, shape, normality, heteroscedasticity and where errors sit."""
    res = (F.col(actual) - F.col(predicted)).cast("double")
    d = df.select(res.alias("res"), F.col(predicted).cast("double").alias("pred")).where(
        "not isnan(res) and not isnan(pred) and abs(res) < double('Infinity') and abs(pred) < double('Infinity')")
    mid = exact_quantiles(d, ["pred"], [0.5], small_rows)["pred"][0]
    size, high = F.abs("res"), F.col("pred") >= F.lit(mid)
    one = d.agg(F.count("*").alias("n"), F.avg("res").alias("m"), F.stddev_pop("res").alias("s"),
                F.skewness("res").alias("g"), F.kurtosis("res").alias("k"), F.corr(F.col("pred"), size).alias("h"),
                F.coalesce(F.avg(F.when(high, size)), F.lit(0.0)).alias("hi"),
                F.coalesce(F.avg(F.when(~high, size)), F.lit(0.0)).alias("lo"), F.max(size).alias("mx"))
    jb = F.col("n") / 6 * (F.col("g") ** 2 + F.col("k") ** 2 / 4)
    return one.select(
        F.col("n").alias("n_samples"), F.round("m", 6).alias("mean_residual"), F.round("s", 6).alias("std_residual"),
        F.round("g", 4).alias("skewness"), F.round("k", 4).alias("kurtosis"),
        F.when(F.abs("m") > 0.1 * F.col("s"), F.when(F.col("m") < 0, "systematic_overprediction")
               .otherwise("systematic_underprediction")).otherwise("unbiased").alias("bias_type"),
        F.when(F.col("hi") > 1.3 * F.col("lo"), "high_value_range").when(F.col("lo") > 1.3 * F.col("hi"), "low_value_range")
        .otherwise("uniform").alias("error_concentration"),
        F.round(jb, 4).alias("jarque_bera"), (F.exp(-jb / 2) > 0.05).alias("normal"),
        F.round("h", 4).alias("hetero_r"), (F.abs("h") > 0.30).alias("heteroscedastic"),
        F.round("hi", 6).alias("high_pred_mean_abs_error"), F.round("lo", 6).alias("low_pred_mean_abs_error"),
        F.round("mx", 6).alias("max_abs_error"))


def residual_features(df: DataFrame, actual: str, predicted: str, features: Sequence[str], top: int = 10) -> DataFrame:
    """Features that still move with the residuals."""
    d = df.withColumn("_residual", F.col(actual) - F.col(predicted))
    rows = pearson(d, [(f, "_residual") for f in features])
    return (rows.where((F.col("n") >= MIN_ROWS) & (F.abs("r") >= MODERATE) & ~F.isnan("r"))
            .select(F.col("feature_a").alias("feature"), F.round("r", 4).alias("pearson_r"),
                    F.when(F.col("r") < 0, "over-prediction").otherwise("under-prediction").alias("reading"))
            .orderBy(F.desc(F.abs("pearson_r")), "feature").limit(top))


# --- statistics between clusters -----------------------------------------------------------

def cluster_moments(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """(cluster, feature, n, mean, var): one grouped pass, pre-aggregated on the map side."""
    cells = [x for i, f in enumerate(features) for x in (
        F.count(f).alias(f"n{i}"), F.avg(f).alias(f"m{i}"), F.var_samp(F.col(f).cast("double")).alias(f"v{i}"))]
    wide = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"), *cells)
    return wide.select("cluster", "size", F.inline(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").cast("double").alias("mean"),
        F.col(f"v{i}").alias("var")) for i, f in enumerate(features)])))


def _global(moments: DataFrame) -> DataFrame:
    """Add global mean, between and within sums and global variance per feature."""
    w = W.partitionBy("feature")
    d = moments.withColumn("n_all", F.sum("n").over(w)).withColumn(
        "gmean", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("n_all"))
    d = d.withColumns({"ssb": F.sum(F.col("n") * (F.col("mean") - F.col("gmean")) ** 2).over(w),
                       "ssw": F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).over(w)})
    return d.withColumn("gvar", (F.col("ssb") + F.col("ssw")) / F.nullif(F.col("n_all") - 1, F.lit(0)))


def separation(moments: DataFrame, top: int = 20) -> DataFrame:
    """Share of the between-cluster separation per feature, ranked."""
    one = _global(moments).groupBy("feature").agg(
        F.first("ssb").alias("b"), F.first("gvar").alias("v"), F.first("n_all").alias("n"))
    score = F.col("b") / F.greatest(F.col("v") * F.col("n"), F.lit(1e-9))
    d = one.where("v > 0").select("feature", score.alias("s"))
    share = F.round(100 * F.col("s") / F.sum("s").over(W.partitionBy(F.lit(1))), 4)  # one row per feature
    d = d.select("feature", F.round("s", 6).alias("importance"), share.alias("impact_pct"))
    rank = F.row_number().over(W.orderBy(F.desc("importance"), "feature")).cast("long")
    return d.withColumn("rank", rank).where(F.col("rank") <= top).withColumn(
        "importance_level", importance_level(F.col("impact_pct")))


def anova(moments: DataFrame) -> DataFrame:
    """One-way F per feature over clusters, with impact share and significance."""
    g = moments.where("n >= 2")
    one = _global(g).groupBy("feature").agg(F.first("ssb").alias("b"), F.first("ssw").alias("w"),
                                            F.first("n_all").alias("n"), F.count("*").alias("k")).where("k >= 2 and w > 0")
    one = one.select("feature", (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), "b", "w")
    d = one.withColumn("f", (F.col("b") / F.col("df1")) / (F.col("w") / F.col("df2")))
    impact = F.round(100 * F.col("f") / F.sum("f").over(W.partitionBy(F.lit(1))), 1)
    return d.select("feature", F.round("f", 4).alias("f_score"), "df1", "df2", impact.alias("impact"),
                    separation_level(impact).alias("importance_level"))


def anova_with_p(moments: DataFrame) -> DataFrame:
    d = anova(moments)
    p = anova_p(F.col("f_score"), F.col("df1").cast("double"), F.col("df2").cast("double"))
    return d.withColumn("p_value", F.round(p, 6)).withColumn("significant", F.col("p_value") < 0.05)


def cluster_delta(moments: DataFrame, top_features: int = 8) -> DataFrame:
    """Centroid z-scores of the best-separating features, with the severity of each cluster."""
    best = anova(moments).orderBy(F.desc("f_score"), "feature").limit(top_features).select("feature")
    d = _global(moments).join(F.broadcast(best), "feature", "left_semi")
    sd = F.sqrt("gvar")
    z = F.round((F.col("mean") - F.col("gmean")) / F.when(sd > 0, sd).otherwise(1.0), 3)
    d = d.select("cluster", "size", "feature", z.alias("z"))
    w = W.partitionBy("cluster")
    return d.select("cluster", "size", "feature", "z",
                    F.row_number().over(w.orderBy(F.desc(F.abs("z")), "feature")).cast("long").alias("place"),
                    band(F.max(F.abs("z")).over(w), [(2, "High"), (1, "Medium")], "Low", strict=True).alias("severity"),
                    F.concat(F.when(F.abs("z") > 1.5, "far ").otherwise("slightly "),
                             F.when(F.col("z") > 0, "above").otherwise("below")).alias("reading"))


# --- importance tables ----------------------------------------------------------------------

def importance_table(raw: DataFrame, weight: Column, signed: Column, top: int | None = None) -> DataFrame:
    """Ranked importance shares from a table with one row per `feature`."""
    total = F.sum(F.abs(weight)).over(W.partitionBy(F.lit(1)))
    pct = F.round(100 * F.abs(weight) / total, 2)
    d = raw.select("feature", F.round(F.abs(weight), 6).alias("importance"), pct.alias("impact_pct"),
                   F.when(signed > 0, "positive").when(signed < 0, "negative").otherwise("unknown").alias("direction"))
    d = d.withColumns({"importance_level": importance_level(F.col("impact_pct")),
                       "rank": F.row_number().over(W.orderBy(F.desc("impact_pct"), "feature")).cast("long")})
    return d if top is None else d.where(F.col("rank") <= top)


def correlation_importance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Importance as the share of absolute correlation with the target."""
    rows = pearson(df, [(f, target) for f in features]).select(F.col("feature_a").alias("feature"), "r")
    return importance_table(rows, F.col("r"), F.col("r"))


def cause_rules(profile: DataFrame, importance: DataFrame, correlations: DataFrame, contributions: DataFrame,
                top: int = 6) -> DataFrame:
    """Signals behind the top features; all inputs have one row per feature.

    contributions: feature, mean_c, std_c, positive_pct of the per-row model contributions.
    """
    d = (importance.where(F.col("rank") <= top)
         .join(F.broadcast(profile.withColumnRenamed("column_name", "feature")), "feature")
         .join(F.broadcast(correlations.select(F.col("feature_a").alias("feature"), F.round("r", 3).alias("corr"))), "feature")
         .join(F.broadcast(contributions), "feature"))
    cv = F.when(F.col("mean") != 0, F.round(F.col("std") / F.col("mean") * 100, 1)).otherwise(0.0)
    sk = F.round("skew_g1", 3)
    flags = {
        "many_outliers": (F.col("outlier_count") > F.col("n_rows") * 0.05, 2),
        "skewed": (F.abs(sk) > 1.5, 1),
        "extreme_variability": (F.abs(cv) > 80, 2),
        "context_dependent": ((F.col("std_c") > F.abs("mean_c") * 1.5) & (F.col("mean_c") != 0), 1),
        "linear_link": (F.abs("corr") > 0.75, 1),
        "weak_linear": (F.abs("corr") < 0.15, 1),
        "mostly_positive": (F.col("positive_pct") > 70, 0),
        "mostly_negative": (F.col("positive_pct") < 30, 0),
    }
    causes = F.filter(F.array(*[F.when(c, n) for n, (c, _) in flags.items()]), lambda x: x.isNotNull())
    score = sum((F.when(c, p).otherwise(0) for c, p in flags.values()), F.lit(0))
    return d.select("rank", "feature", "impact_pct", "importance_level", "corr",
                    F.when(F.size(causes) == 0, "stable").otherwise(F.array_join(causes, ",")).alias("causes"),
                    score.cast("long").alias("severity_score"))


def linear_contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Per feature: mean, spread and positive share of coef x (value - mean) over the rows."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    cells = []
    for i, (c, b) in enumerate(coefficients.items()):
        v = F.lit(float(b)) * (F.col(c) - F.lit(float(means[c])))
        cells += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.avg((v > 0).cast("int")).alias(f"p{i}")]
    return df.agg(*cells).select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.round(f"m{i}", 4).alias("mean_c"), F.round(f"s{i}", 4).alias("std_c"),
        F.round(F.col(f"p{i}") * 100, 1).alias("positive_pct")) for i, c in enumerate(coefficients)])))

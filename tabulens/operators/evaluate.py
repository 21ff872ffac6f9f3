"""Model evaluation from (actual, predicted) columns.

Rows are reduced once to the label-pair counts or to one row of sums; the rest works on that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import band, clamp01

MAX_LABELS = 2_000  # labels of which all pairs are shown


def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return (df.groupBy(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted"))
            .agg(F.count("*").alias("n")))


def confusion_matrix(pairs: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """Counts on the full label grid, zero cells included; with more than `most` labels the observed cells only."""
    labels = pairs.select(F.explode(F.array("actual", "predicted")).alias("x")).where("x is not null").distinct()
    seen = pairs.select("actual", "predicted", F.col("n").cast("long").alias("n"))
    if labels.limit(most + 1).count() > most:
        return seen
    whole = labels.agg(F.sort_array(F.collect_list("x")).alias("l"))  # at most `most` labels
    grid = whole.select("l", F.explode("l").alias("actual")).select("actual", F.explode("l").alias("predicted"))
    return grid.join(seen, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label (zero when undefined)."""
    side = lambda c: F.struct(F.col(c).alias("label"), F.col("n").alias("n"),
                              F.lit(c).alias("k"), (F.col("actual") == F.col("predicted")).alias("hit"))
    long = pairs.select(F.inline(F.array(side("actual"), side("predicted"))))
    d = long.groupBy("label").agg(
        F.coalesce(F.sum(F.when(F.col("k") == "actual", F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("k") == "predicted", F.col("n"))), F.lit(0)).alias("called"),
        F.coalesce(F.sum(F.when((F.col("k") == "actual") & F.col("hit"), F.col("n"))), F.lit(0)).alias("correct"))
    prec = F.coalesce(F.try_divide("correct", "called"), F.lit(0.0))
    rec = F.coalesce(F.try_divide("correct", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return d.select("label", "support", "called", "correct", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def classification_metrics(report: DataFrame) -> DataFrame:
    """One row of accuracy, balanced accuracy, weighted and macro scores."""
    n, s = F.sum("support"), F.col("support")
    return report.agg(
        F.round(F.sum("correct") / n, 4).alias("accuracy"),
        F.round(F.avg(F.when(s > 0, F.col("recall"))), 4).alias("balanced_accuracy"),
        F.round(F.sum(s * F.col("precision")) / n, 4).alias("precision_weighted"),
        F.round(F.sum(s * F.col("recall")) / n, 4).alias("recall_weighted"),
        F.round(F.sum(s * F.col("f1")) / n, 4).alias("f1_weighted"),
        F.round(F.avg("f1"), 4).alias("f1_macro"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, zero_as_one: bool = False) -> DataFrame:
    """One row of RMSE, MAE, R2 and MAPE; near-zero targets are left out of MAPE (or count as 1)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    small = F.abs(y) < 1e-9
    base = F.when(small, F.lit(1.0) if zero_as_one else F.lit(None)).otherwise(y)
    one = df.agg(F.count("*").alias("n"), F.sum((y - p) ** 2).alias("sse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.var_pop(y).alias("vy"), F.avg(F.abs((y - p) / base)).alias("mape"))
    r2 = F.when((F.col("n") > 1) & (F.col("vy") > 0), 1 - F.col("sse") / (F.col("vy") * F.col("n"))).otherwise(0.0)
    return one.select(F.round(F.sqrt(F.col("sse") / F.col("n")), 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                      F.round(r2, 4).alias("r2"), F.round(F.coalesce(F.col("mape") * 100, F.lit(0.0)), 4).alias("mape_pct"))


def confusion_pairs(pairs: DataFrame, top: int | None = 8) -> DataFrame:
    """Confused label pairs with rate, reverse count and direction (self join of the pair counts)."""
    total = F.sum("n").over(W.partitionBy("actual"))
    d = pairs.withColumn("row_total", total).where("actual <> predicted")
    back = pairs.select(F.col("actual").alias("predicted"), F.col("predicted").alias("actual"), F.col("n").alias("b"))
    d = d.join(back, ["actual", "predicted"], "left")
    rate = F.col("n") / F.greatest("row_total", F.lit(1))
    rev = F.coalesce("b", F.lit(0))
    ratio = F.col("n") / F.greatest(rev, F.lit(1))
    d = d.select("actual", "predicted", F.col("n").alias("confusion_count"), F.round(rate, 4).alias("confusion_rate"),
                 rev.alias("reverse_count"), F.round(ratio, 2).alias("asymmetry_ratio"),
                 (ratio > 3.0).alias("one_directional"), F.when(rate > 0.25, "high").otherwise("medium").alias("severity"))
    d = d.orderBy(F.desc("confusion_count"), "actual", "predicted")
    return d if top is None else d.limit(top)


def class_weakness(report: DataFrame) -> DataFrame:
    """Error rate and kind of weakness per class."""
    err = 1 - F.col("correct") / F.greatest("support", F.lit(1))
    return report.select(
        "label", F.col("support").alias("total_true"), "correct", F.round(err, 4).alias("error_rate"),
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")],
        F.when(F.col("recall") < 0.5, "low_recall").when(F.col("precision") < 0.5, "low_precision")
        .when(F.col("f1") < 0.5, "balanced_weakness").otherwise("acceptable").alias("weakness_type"))


def error_overview(pairs: DataFrame) -> DataFrame:
    wrong = F.sum(F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(0))
    return pairs.agg(wrong.cast("long").alias("total_misclassified"),
                     F.round(wrong / F.greatest(F.sum("n"), F.lit(1)), 4).alias("overall_error_rate"))


def weakest_class(report: DataFrame) -> DataFrame:
    return report.agg(F.min_by("label", F.struct("f1", "label")).alias("weakest_class"),
                      F.round(F.min("f1"), 4).alias("f1"))


def largest_errors(df: DataFrame, key: Sequence[str], actual: str = "actual", predicted: str = "predicted",
                   top: int = 10) -> DataFrame:
    d = df.withColumn("_e", F.abs(F.col(actual) - F.col(predicted))).orderBy(F.desc("_e"), *key).limit(top)
    return d.select(*key, actual, predicted, F.round("_e", 4).alias("absolute_error"),
                    F.round(F.col(actual) - F.col(predicted), 4).alias("residual"))


def misclassified(df: DataFrame, key: Sequence[str], actual: str = "actual", predicted: str = "predicted",
                  top: int = 20) -> DataFrame:
    """First wrongly labelled rows in key order (a report of bounded length)."""
    return df.where(F.col(actual) != F.col(predicted)).orderBy(*key).limit(top).select(*key, actual, predicted)


def reliability_classification(metrics: DataFrame) -> DataFrame:
    f, b = F.col("f1_macro"), F.col("balanced_accuracy")
    high = (f >= 0.80) & (b >= 0.80)
    level = F.when(high, "High").when(f >= 0.60, "Moderate").otherwise("Low")
    score = F.when(high, F.bround((f + b) / 2 * 100, 0)).otherwise(F.bround(f * 100, 0))
    return _policy(metrics.select(level.alias("level"), score.cast("long").alias("confidence_score")))


def reliability_regression(metrics: DataFrame) -> DataFrame:
    r, m = F.col("r2"), F.col("mape_pct")
    level = F.when((r >= 0.80) & (m <= 20), "High").when(r >= 0.55, "Moderate").otherwise("Low")
    return _policy(metrics.select(level.alias("level"), F.bround(clamp01(r) * 100, 0).cast("long").alias("confidence_score")))


def _policy(d: DataFrame) -> DataFrame:
    lv = F.col("level")
    return d.withColumns({"show_full_dashboard": lv.isin("High", "Moderate"), "allow_decision_language": lv == "High",
                          "caution_required": lv != "High", "mark_exploratory": lv == "Low"})


def confidence_band(score) -> object:
    return band(score, [(0.80, "High"), (0.60, "Moderate")], "Low")


def input_checks(df: DataFrame, target: str, task: str, text: str | None = None, min_rows: int = 10,
                 min_class: int = 3, min_tokens: float = 2.0) -> DataFrame:
    """(check, failed, value): the tests a table must pass before training."""
    from ..functions.text import strip, word_count

    c = F.col(target)
    cells = [F.count("*").alias("n"), (100.0 * F.count_if(c.isNull()) / F.count("*")).alias("miss")]
    txt = strip(F.col(text)) if text else F.lit(None).cast("string")
    cells += [F.avg(F.when(txt != "", word_count(txt))).alias("tok"), F.count_if(txt != "").alias("filled")]
    empties = [F.count_if(F.col(x).isNotNull()).alias(f"_f{i}") for i, x in enumerate(df.columns) if x != target]
    one = df.agg(*cells, *empties)
    sizes = df.where(c.isNotNull()).groupBy(c).agg(F.count("*").alias("k")).agg(
        F.count("*").alias("classes"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
    one = one.join(F.broadcast(sizes), F.lit(True))  # one row each
    n_empty = sum((F.when(F.col(f"_f{i}") == 0, 1).otherwise(0) for i, x in enumerate(df.columns) if x != target), F.lit(0))
    row = lambda name, bad, val: F.struct(F.lit(name).alias("check"), F.coalesce(bad, F.lit(False)).alias("failed"),
                                          F.round(val.cast("double"), 4).alias("value"))
    rows = [row("too_few_rows", F.col("n") < min_rows, F.col("n")), row("target_missing", F.col("miss") > 50, F.col("miss")),
            row("empty_features", n_empty > 0, n_empty)]
    if task == "classification":
        rows += [row("too_few_classes", F.col("classes") < 2, F.col("classes")),
                 row("all_classes_rare", F.col("largest") < min_class, F.col("largest"))]
    if text:
        rows += [row("text_blank", F.col("filled") == 0, F.col("filled")), row("text_too_short", F.col("tok") < min_tokens, F.col("tok"))]
    return one.select(F.inline(F.array(*rows)))

"""Supervised candidates, out-of-fold leaderboard, final fit, importance and scoring.

Features are prepared once by a Spark ML pipeline (medians and level lists are fitted from
the data and saved with the model); candidates then train on the cached vectors. Independent
candidates run as concurrent Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import evaluate as ev
from .quantiles import SMALL_ROWS, exact_quantiles
from .ranks import number_rows
from .sampling import hash_unit, key_hash, stratified_folds
from .stats import importance_table
from .trees import ExtraTrees, MultinomialBoosting, TreeModel

MAX_CLASSES = 1_000
SEED = 42
SPLIT_ROWS = 20_000  # rows of a split of a training frame
MOST_ROWS = 500_000  # rows of a split, where a table has several times as many splits as there are cores


@dataclass
class Spec:
    """What to predict from what."""

    target: str
    task: str  # classification or regression
    key: list[str]
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    trees: int = 80
    depth: int = 12
    rounds: int = 100


def class_sizes(df: DataFrame, label: str) -> dict:
    rows = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("l")).agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return {r["l"]: r["n"] for r in rows}


def add_class_weights(df: DataFrame, label: str, sizes: dict | None = None) -> DataFrame:
    """Balanced weights n / (k n_c), from a table of class counts that is joined; null without a class."""
    name = F.col(label).cast("string")
    if sizes is None:
        table = df.where(F.col(label).isNotNull()).groupBy(name.alias("_class")).agg(F.count("*").alias("_n"))
    else:
        table = df.sparkSession.createDataFrame(list(sizes.items()), "_class string, _n long")
    whole = table.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))  # one row
    table = table.join(F.broadcast(whole), F.lit(True)).select("_class", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(table, name == F.col("_class"), "left").drop("_class")


# --- features --------------------------------------------------------------------------------

def feature_pipeline(df: DataFrame, spec: Spec, small_rows: int = SMALL_ROWS) -> Pipeline:
    """Median fill, `Unknown` level, one-hot, one vector; fitted values are written into the stages."""
    med = {c: q[0] or 0.0 for c, q in exact_quantiles(df.select(*[F.col(c).cast("double") for c in spec.numeric]), spec.numeric, [0.5], small_rows).items()}
    cells = [f"coalesce(nanvl(cast(`{c}` as double), null), {float(m)!r}D) as `f_{c}`" for c, m in med.items()]
    cells += [f"coalesce(cast(`{c}` as string), 'Unknown') as `s_{c}`" for c in spec.categorical]
    stages = [SQLTransformer(statement=f"select *, {', '.join(cells)} from __THIS__")]
    for c in spec.categorical:
        stages.append(StringIndexer(inputCol=f"s_{c}", outputCol=f"i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
    if spec.categorical:
        stages.append(OneHotEncoder(inputCols=[f"i_{c}" for c in spec.categorical], outputCols=[f"o_{c}" for c in spec.categorical], dropLast=True, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[f"f_{c}" for c in spec.numeric] + [f"o_{c}" for c in spec.categorical], outputCol="features"))
    if spec.task == "classification":
        stages.append(SQLTransformer(statement=f"select *, cast(`{spec.target}` as string) as label_text from __THIS__"))
    return Pipeline(stages=stages)


def feature_names(frame: DataFrame) -> list[str]:
    """Names of the vector positions from the column metadata."""
    attrs = frame.schema["features"].metadata["ml_attr"]["attrs"]
    flat = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    return [n[2:] if n[:2] in ("f_", "o_") else n for _, n in flat]


# --- candidates ------------------------------------------------------------------------------

def _scaled(model) -> Pipeline:
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), model.setFeaturesCol("scaled")])


def classification_candidates(spec: Spec, n_classes: int, n: int) -> dict[str, Callable]:
    """Name to estimator builder; None marks a candidate that is skipped. Linear penalties are 1 on
    the sum of n losses, which is 1/n on Spark's mean."""
    penalty = 1.0 / max(n, 1)
    w = {"labelCol": "label", "weightCol": "weight"}
    out: dict[str, Callable | None] = {
        "RandomForest": lambda: RandomForestClassifier(numTrees=spec.trees, maxDepth=spec.depth, minInstancesPerNode=2, seed=SEED, **w),
        "ExtraTrees": lambda: ExtraTrees("classification", spec.trees, spec.depth, 2, weightCol="weight", seed=SEED + 1),
        "LogisticRegression": lambda: _scaled(LogisticRegression(maxIter=100, tol=1e-4, regParam=penalty, **w)),
    }
    svc = lambda: LinearSVC(maxIter=50, tol=1e-4, regParam=penalty, labelCol="label", weightCol="weight")
    gbt = lambda: GBTClassifier(maxIter=spec.rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.85, seed=SEED, labelCol="label")
    if n_classes == 2:
        out["LinearSVC"] = lambda: _scaled(svc())
        out["GradientBoosting"] = gbt
    else:
        out["LinearSVC"] = lambda: _scaled(OneVsRest(classifier=svc().setFeaturesCol("scaled"), labelCol="label", weightCol="weight"))
        out["GradientBoosting"] = lambda: MultinomialBoosting(spec.rounds, 4, 0.05, 0.85, weightCol="weight", seed=SEED)
    out["XGBoost"] = _xgboost("classification")
    return out


def regression_candidates(spec: Spec, n: int) -> dict[str, Callable]:
    return {
        "RandomForest": lambda: RandomForestRegressor(numTrees=spec.trees, maxDepth=spec.depth, minInstancesPerNode=3, seed=SEED, labelCol="label"),
        "ExtraTrees": lambda: ExtraTrees("regression", spec.trees, spec.depth, 3, seed=SEED + 1),
        "GradientBoosting": lambda: GBTRegressor(maxIter=spec.rounds, maxDepth=5, stepSize=0.05, subsamplingRate=0.85, seed=SEED, labelCol="label"),
        # ridge penalty 1.0 on the sum of squares is 1/n on the mean
        "Ridge": lambda: _scaled(LinearRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, labelCol="label")),
        "LinearRegression": lambda: _scaled(LinearRegression(labelCol="label")),
        "XGBoost": _xgboost("regression"),
    }


def text_candidates(n_classes: int, n: int) -> dict[str, Callable]:
    penalty = 1.0 / max(n, 1)
    w = {"labelCol": "label", "weightCol": "weight"}
    svc = lambda **k: LinearSVC(maxIter=30, tol=1e-4, regParam=penalty, labelCol="label", **k)
    return {
        "LogisticRegression": lambda: LogisticRegression(maxIter=50, tol=1e-4, regParam=penalty, **w),
        "LinearSVC": (lambda: svc(weightCol="weight")) if n_classes == 2 else (lambda: OneVsRest(classifier=svc(), labelCol="label", weightCol="weight")),
        "MultinomialNB": lambda: NaiveBayes(modelType="multinomial", smoothing=1.0, labelCol="label"),
    }


def _xgboost(task: str) -> Callable | None:
    try:
        from xgboost import spark as xs
    except ImportError:
        return None
    cls = xs.SparkXGBClassifier if task == "classification" else xs.SparkXGBRegressor
    return lambda: cls(n_estimators=120, max_depth=4, learning_rate=0.05, subsample=0.85, colsample_bytree=0.85,
                       label_col="label", features_col="features", random_state=SEED)


# --- leaderboard -----------------------------------------------------------------------------

def out_of_fold(frame: DataFrame, build: Callable, key: Sequence[str], folds: int, frames: dict[int, DataFrame] | None = None) -> DataFrame:
    """Predictions for every row by a model that never saw it (pooled over the folds). `frames` has
    the rows with each fold's own features, where those are fitted too."""
    out = None
    for f in range(folds):
        own = frame if frames is None else frames[f]
        model = build().fit(own.where(F.col("fold") != f))
        part = model.transform(own.where(F.col("fold") == f)).select(*key, F.col("label").cast("double").alias("actual"), F.col("prediction").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def score(pred: DataFrame, task: str) -> dict:
    if task == "classification":
        return ev.classification_metrics(ev.class_report(ev.pair_counts(pred, "actual", "predicted"))).first().asDict()
    return ev.regression_metrics(pred, "actual", "predicted").first().asDict()


CLS_METRICS = ["accuracy", "balanced_accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro"]
REG_METRICS = ["rmse", "mae", "r2", "mape_pct"]


def rank_classification(board: DataFrame) -> DataFrame:
    """Successful first, then macro F1, balanced accuracy, weighted F1, accuracy."""
    ok = (F.col("status") == "success")
    d = number_rows(board, [F.desc(ok), *[F.desc(c) for c in ("f1_macro", "balanced_accuracy", "f1_weighted", "accuracy")], "model_name"])
    return d.withColumn("selected", F.col("rank") == 1)


def rank_regression(board: DataFrame) -> DataFrame:
    """Successful first, then R2, RMSE, MAE, MAPE."""
    ok = (F.col("status") == "success")
    d = number_rows(board, [F.desc(ok), F.desc("r2"), F.asc_nulls_last("rmse"), F.asc_nulls_last("mae"), F.asc_nulls_last("mape_pct"), "model_name"])
    return d.withColumn("selected", F.col("rank") == 1)


def leaderboard(frame: DataFrame, candidates: dict[str, Callable | None], spec: Spec, folds: int = 3, workers: int = 3,
                frames: dict[int, DataFrame] | None = None) -> DataFrame:
    """One row per candidate with pooled out-of-fold metrics; a failing or skipped candidate keeps a failed row."""
    spark = frame.sparkSession
    names = CLS_METRICS if spec.task == "classification" else REG_METRICS

    def run(name: str):
        build = candidates[name]
        if build is None:
            return (name, "skipped", "not available", *[None] * len(names))
        try:
            m = score(out_of_fold(frame, build, spec.key, folds, frames), spec.task)
            return (name, "success", "", *[float(m[c]) for c in names])
        except Exception as e:  # noqa: BLE001  a broken candidate must not end the comparison
            return (name, "failed", str(e)[:200], *[None] * len(names))

    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(run), candidates))
    board = spark.createDataFrame(rows, "model_name string, status string, reason string, " + ", ".join(f"{c} double" for c in names))
    return rank_classification(board) if spec.task == "classification" else rank_regression(board)


# --- the whole run ---------------------------------------------------------------------------

@dataclass
class Prepared:
    spec: Spec
    features: PipelineModel
    labels: list[str]
    train: DataFrame
    test: DataFrame
    folds: int


def few_splits(df: DataFrame, rows: int, per_split: int = SPLIT_ROWS) -> DataFrame:
    """Iterative solvers run one job per step: a small table should not pay for many tiny tasks. A larger
    one is dealt out evenly, since its scan may have few splits. Every split sends sums for all open nodes of
    a forest, so beyond one split per core there are more only where they would hold over MOST_ROWS."""
    splits = min(rows // per_split, max(df.sparkSession.sparkContext.defaultParallelism, rows // MOST_ROWS))
    return df.repartition(splits) if splits > 1 else df.coalesce(1)


def prepare(df: DataFrame, spec: Spec, folds: int = 3, min_class: int = 3) -> Prepared:
    """Drop rows without target and rare classes, fit features, split 80/20, number folds; vectors are cached."""
    d = df.where(F.col(spec.target).isNotNull())
    labels: list[str] = []
    if spec.task == "classification":
        sizes = {c: n for c, n in class_sizes(d, spec.target).items() if n >= min_class}
        labels = sorted(sizes)
        code = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(spec.target).cast("string"))
        d = add_class_weights(d.where(F.col(spec.target).cast("string").isin(labels)), spec.target, sizes)
        d = d.withColumn("label", (code - 1).cast("double"))
        folds = max(2, min(folds, min(sizes.values())))
        from .sampling import holdout
        d = holdout(d, spec.key, "stratified", label="label")
        d = stratified_folds(d, "label", spec.key, folds, seed=7)
    else:
        d = d.withColumn("label", F.col(spec.target).cast("double"))
        d = d.withColumn("part", F.when(hash_unit(spec.key) < 0.20, "test").otherwise("train"))
        d = d.withColumn("fold", F.floor(hash_unit(spec.key, 7) * folds).cast("long"))
    pipe = feature_pipeline(d.where("part = 'train'"), spec).fit(d.where("part = 'train'"))
    cols = [*spec.key, "label", "part", "fold", "features"] + (["weight"] if spec.task == "classification" else [])
    frame = few_splits(pipe.transform(d).select(*cols), d.count()).persist()
    return Prepared(spec, pipe, labels, frame.where("part = 'train'"), frame.where("part = 'test'"), folds)


def candidates_for(p: Prepared) -> dict[str, Callable | None]:
    if p.spec.task == "classification":
        return classification_candidates(p.spec, len(p.labels), p.train.count())
    return regression_candidates(p.spec, p.train.count())


def best_name(board: DataFrame) -> str | None:
    row = board.where("selected and status = 'success'").select("model_name").first()
    return row[0] if row else None


def final_fit(p: Prepared, name: str):
    """Model on the whole training part, its test predictions and test metrics (one row)."""
    model = candidates_for(p)[name]().fit(p.train)
    pred = model.transform(p.test).select(*p.spec.key, F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    if p.spec.task == "classification":
        names = F.array(*[F.lit(x) for x in p.labels])
        pred = pred.withColumns({c: F.get(names, F.col(c).cast("int")) for c in ("actual", "predicted")})
        metrics = ev.classification_metrics(ev.class_report(ev.pair_counts(pred, "actual", "predicted")))
    else:
        metrics = ev.regression_metrics(pred, "actual", "predicted")
    return model, pred, metrics


def spread_warning(metrics: DataFrame, train: DataFrame) -> DataFrame:
    """Adds whether the test RMSE exceeds the spread of the training target."""
    sd = train.agg(F.stddev_samp("label").alias("sd"))
    return metrics.join(F.broadcast(sd), F.lit(True)).withColumn("worse_than_spread", F.col("rmse") > F.col("sd")).drop("sd")


def _core(model):
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    return stages[-1]


def importance(model, frame: DataFrame, top: int = 30) -> DataFrame:
    """Tree importances or mean absolute coefficients as ranked shares."""
    core, names = _core(model), feature_names(frame)
    if hasattr(core, "featureImportances"):
        raw = signed = core.featureImportances.toArray()
    elif hasattr(core, "coefficientMatrix"):
        mat = core.coefficientMatrix.toArray()
        raw, signed = abs(mat).mean(0), mat.mean(0)
    elif hasattr(core, "coefficients"):
        signed = core.coefficients.toArray()
        raw = abs(signed)
    else:
        parts = [m for m in core.models]
        pick = (lambda m: m.coefficients.toArray()) if hasattr(parts[0], "coefficients") else (lambda m: m.featureImportances.toArray())
        raw = sum(abs(pick(m)) for m in parts) / len(parts)
        signed = sum(pick(m) for m in parts) / len(parts)
    rows = [(n, float(r), float(s)) for n, r, s in zip(names, raw, signed)]
    d = frame.sparkSession.createDataFrame(rows, "feature string, w double, s double")
    return importance_table(d, F.col("w"), F.col("s"), top)


def shuffled(df: DataFrame, col: str, key: Sequence[str], buckets: int = 256) -> DataFrame:
    """`col` exchanged between rows: each row takes the value of the row before it in hash order inside a hash bucket."""
    d = df.withColumn("_h", key_hash(key, 99)).withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    w = W.partitionBy("_b").orderBy("_h", *key)
    prev = F.lag(col).over(w)
    last = F.last(col).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first_row = F.row_number().over(w) == 1
    return d.withColumn(col, F.when(first_row, last).otherwise(prev)).drop("_h", "_b")


def permutation_importance(raw: DataFrame, p: Prepared, model, rows_per_bucket: int = 100_000) -> DataFrame:
    """Loss of R2 or accuracy when one input column is exchanged between rows."""
    spec = p.spec
    test = raw.join(p.test.select(*spec.key, "label"), spec.key)

    def value(d: DataFrame) -> float:
        got = model.transform(p.features.transform(d)).select("label", "prediction")
        if spec.task == "regression":
            return ev.regression_metrics(got, "label", "prediction").first()["r2"]
        return got.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]

    base = value(test)
    buckets = max(16, p.test.count() // rows_per_bucket)
    rows = [(c, float(base - value(shuffled(test, c, spec.key, buckets)))) for c in [*spec.numeric, *spec.categorical]]
    d = raw.sparkSession.createDataFrame(rows, "feature string, drop double")
    return number_rows(d.withColumn("drop", F.round("drop", 6)), [F.desc("drop"), "feature"])


def score_new(features: PipelineModel, model, labels: Sequence[str], df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predicted value, or label with class id and confidence, for new rows."""
    d = model.transform(features.transform(df))
    if not labels:
        return d.select(*key, F.round("prediction", 6).alias("prediction"))
    out = [F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int")).alias("prediction"), F.col("prediction").cast("int").alias("class_id")]
    if "probability" in d.columns:
        out.append(F.round(F.array_max(vector_to_array("probability")), 6).alias("confidence"))
    return d.select(*key, *out)


def save(path: str, features: PipelineModel, model) -> None:
    features.write().overwrite().save(f"{path}/features")
    if isinstance(model, TreeModel):
        model.save(SparkSession.getActiveSession(), f"{path}/trees")
        return
    wrapped = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    wrapped.write().overwrite().save(f"{path}/model")


def load(path: str, trees: bool = False) -> tuple[PipelineModel, PipelineModel | TreeModel]:
    """Features and model; `trees` says that the model is one of this library's own."""
    return PipelineModel.load(f"{path}/features"), TreeModel.load(SparkSession.getActiveSession(), f"{path}/trees") if trees else PipelineModel.load(f"{path}/model")


@dataclass
class TextData:
    """Vectors of texts: all rows with what the training part taught, and its rows with each fold's own vocabulary."""

    frame: DataFrame
    frames: dict[int, DataFrame]
    labels: list[str]
    folds: int
    fitted: tuple[list[tuple[str, int]], int]


def text_vectors(d: DataFrame, key: str, text: str, fitted: tuple, *keep: str) -> DataFrame:
    """Unit-length TF-IDF vectors; a text without a known term has an empty one."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    from .vectorize import sparse_rows, tfidf

    size = len(fitted[0])
    # a sparse vector is a struct of (type 0, size, positions, values), read back from JSON in the JVM
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    raw = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), empty(F.col("j"), "int").alias("indices"), empty(F.col("x"), "double").alias("values"))
    vector = F.from_json(F.to_json(F.struct(raw.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]
    rows = sparse_rows(tfidf(d, key, text, size, lower=False, fitted=fitted), key)
    return d.select(key, *keep).join(rows, key, "left").select(key, *keep, vector.alias("features"))


def text_frame(df: DataFrame, key: str, text: str, target: str, max_features: int = 5000, folds: int = 3) -> TextData:
    """Labelled vectors with weight, part and fold. Equal texts stay in one part and fold; a fold's vocabulary and
    document counts come from the other folds only."""
    from .sampling import choose_split, holdout
    from .vectorize import fold_vocabularies

    one = df.agg(F.count("*").alias("n"), F.count_distinct(text).alias("u")).first()
    sizes = class_sizes(df, target)
    labels = sorted(c for c, n in sizes.items() if n >= 3)
    how = choose_split(one["u"] / max(one["n"], 1), min(sizes[c] for c in labels))
    d = df.where(F.col(target).cast("string").isin(labels))
    d = d.withColumn("label", (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(target).cast("string")) - 1).cast("double"))
    d = add_class_weights(d, target, {c: sizes[c] for c in labels})
    d = holdout(d, [key], how, label="label", group=text)
    d = d.withColumn("fold", F.floor(hash_unit([text], 7) * folds).cast("long")).persist()
    train = d.where("part = 'train'")
    fitted = fold_vocabularies(train, text, "fold", folds, max_features, 2 if how == "group" else 1, 0.95, lower=False)
    keep = ["label", "weight", "part", "fold"]
    # dealt out, not merged: a task that merges splits of these joins and windows holds the memory of all of them
    vectors = lambda rows, f: text_vectors(rows, key, text, fitted[f], *keep).repartition(max(1, one["n"] // SPLIT_ROWS)).persist()
    return TextData(vectors(d, None), {f: vectors(train, f) for f in range(folds)}, labels, folds, fitted[None])


def text_final(data: TextData, spec: Spec, name: str):
    """Model on the whole training part, its test predictions and test metrics (one row)."""
    train, test = data.frame.where("part = 'train'"), data.frame.where("part = 'test'")
    model = text_candidates(len(data.labels), train.count())[name]().fit(train)
    names = F.array(*[F.lit(x) for x in data.labels])
    pred = model.transform(test).select(*spec.key, *[F.get(names, F.col(c).cast("int")).alias(a) for c, a in (("label", "actual"), ("prediction", "predicted"))])
    return model, pred, ev.classification_metrics(ev.class_report(ev.pair_counts(pred, "actual", "predicted")))


def score_texts(data: TextData, model, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, prediction) for new texts, with the vocabulary of the training part."""
    names = F.array(*[F.lit(x) for x in data.labels])
    return model.transform(text_vectors(df, key, text, data.fitted)).select(key, F.get(names, F.col("prediction").cast("int")).alias("prediction"))

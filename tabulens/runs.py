"""A whole run over a raw table: routed, committed section by section, restartable.

A run has a folder and an id. Its first stage fixes the rows with a row id; every later stage reads
committed sections only. A stage commits by writing its sections and then one row of the manifest;
a stage that fails leaves a row with the reason, and stages that need it are skipped with one. A
run that is started again skips what is committed and tries the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flows
from .operators import (anomalies, charts, clusters, column_types as ct, drift, evaluate as ev, findings as fd, insights as ins, models, profile as pf, stats)
from .session import cut_lineage
from .sources.files import UnusableTable, require

ROW = "_row"
MANIFEST = "stage string, place int, status string, sections array<string>, reason string"
TASKS = ("classification", "regression")


@dataclass(frozen=True)
class Route:
    strategy: str  # supervised or unsupervised
    target: str | None
    task: str | None
    decided_by: str  # forced, request, configuration or inference


def choose_route(df: DataFrame, force: str | None = None, target: str | None = None, task: str | None = None, config: dict | None = None) -> Route:
    """Strategy, target and task: a forced strategy first, then the request's target, then the run configuration,
    then what the column names say; without a target the run is unsupervised.

    A request for a column that is not there is passed over; a configuration that names one is an error."""
    if force == "unsupervised":
        return Route("unsupervised", None, None, "forced")
    by = lambda t: ct.task_type(df, t).first()["task"]
    if target and target in df.columns:
        return Route("supervised", target, task if task in TASKS else by(target), "request")
    named = config or {}
    wanted, wanted_task = named.get("target_column"), named.get("task_type")
    if wanted and wanted not in df.columns:
        raise UnusableTable("the configured target is not a column", {"target": wanted}, ["check target_column", f"columns: {', '.join(df.columns[:20])}"])
    if wanted_task == "unsupervised":
        return Route("unsupervised", None, None, "configuration")
    if wanted:
        return Route("supervised", wanted, wanted_task if wanted_task in TASKS else by(wanted), "configuration")
    found = ct.target_by_name(pf.column_profile(df)).first()
    if found is None:
        return Route("unsupervised", None, None, "configuration" if wanted_task in TASKS else "inference")
    return Route("supervised", found["target"], wanted_task if wanted_task in TASKS else by(found["target"]), "inference")


class Run:
    """The sections and the manifest of one run."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/run_id={run_id}"
        self.state = {r["stage"]: r for r in self.manifest().collect()}  # one row per stage

    def manifest(self) -> DataFrame:
        """The last row of every stage, in the order of the stages."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, at timestamp").parquet(f"{self.folder}/manifest")
            rows = rows.groupBy("stage").agg(F.max_by(F.struct("place", "status", "sections", "reason"), "at").alias("s")).select("stage", "s.*")
        except AnalysisException:  # nothing is written yet
            rows = self.spark.createDataFrame([], MANIFEST)
        return rows.orderBy("place")

    def table(self, stage: str, section: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{stage}/{section}")

    def _note(self, stage: str, status: str, sections: Sequence[str], reason: str) -> None:
        place = list(STAGES).index(stage)
        row = self.spark.createDataFrame([(stage, place, status, list(sections), reason)], MANIFEST).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.state[stage] = {"status": status, "sections": list(sections), "reason": reason}

    def done(self, stage: str) -> bool:
        return stage in self.state and self.state[stage]["status"] == "committed"

    def stage(self, name: str, make: Callable[[], dict[str, DataFrame]], needs: Sequence[str] = ()) -> bool:
        """Runs and commits a stage unless it is committed; whether it is afterwards."""
        if self.done(name):
            return True
        missing = [n for n in needs if not self.done(n)]
        if missing:
            self._note(name, "skipped", [], f"needs {', '.join(missing)}")
            return False
        try:
            made = make()
            for section, d in made.items():
                d.write.mode("overwrite").parquet(f"{self.folder}/{name}/{section}")
        except Exception as e:  # noqa: BLE001  a failed stage is a row of the manifest, not the end of the run
            self._note(name, "failed", [], f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
            return False
        self._note(name, "committed", sorted(made), "")
        return True


# stages and what they need
STAGES = {"input": (), "routing": ("input",), "model": ("routing",), "scores": ("model",), "findings": ("model",), "insights": ("model",), "charts": ("model", "findings")}


@dataclass
class _Context:
    """What the stages share; everything comes from committed sections."""

    run: Run
    order_by: list[str]

    @property
    def rows(self) -> DataFrame:
        return self.run.table("input", "rows")

    @property
    def route(self) -> Route:
        r = self.run.table("routing", "route").first()
        return Route(r["strategy"], r["target"], r["task"], r["decided_by"])

    def columns(self, role: str) -> list[str]:
        return [r["column_name"] for r in self.run.table("routing", "roles").where(F.col("role") == role).orderBy("ordinal").collect()]

    @property
    def order(self) -> list[str]:
        return [*self.order_by, ROW]

    def spec(self) -> models.Spec:
        route = self.route
        levels = {r["column_name"]: r["n_unique"] for r in self.run.table("routing", "roles").collect()}
        return models.Spec(route.target, route.task, [ROW], self.columns("numeric"), [c for c in self.columns("categorical") if (levels[c] or 0) <= 50])


def run(df: DataFrame, folder: str, run_id: str, force: str | None = None, target: str | None = None, task: str | None = None, config: dict | None = None,
        order_by: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """Everything that can be said about a raw table; returns the manifest. `only` limits the candidates."""
    spark = df.sparkSession
    r = Run(spark, folder, run_id)
    c = _Context(r, list(order_by))

    def rows():
        require(df, 10, 2)
        return {"rows": df.dropDuplicates().withColumn(ROW, F.monotonically_increasing_id())}

    def routing():
        route = choose_route(c.rows.drop(ROW), force, target, task, config)
        cfg = config or {}
        roles = ct.column_roles(pf.column_profile(c.rows.drop(ROW)), route.target, cfg.get("col_types"), cfg.get("excluded_id_cols") or ())
        return {"route": spark.createDataFrame([(route.strategy, route.target, route.task, route.decided_by)], "strategy string, target string, task string, decided_by string"),
                "roles": roles, "record": ct.routing(roles, route.task or "clustering")}

    def staged(name: str, supervised: Callable, unsupervised: Callable) -> bool:
        return r.stage(name, lambda: (supervised if c.route.strategy == "supervised" else unsupervised)(c, only), STAGES[name])

    r.stage("input", rows)
    r.stage("routing", routing, STAGES["routing"])
    staged("model", _supervised, _unsupervised)
    staged("scores", _scores, _assignments)
    staged("findings", _findings, _cluster_findings)
    staged("insights", _insights, _cluster_insights)
    staged("charts", _charts, _cluster_charts)
    return r.manifest()


# --- supervised -------------------------------------------------------------------------------

def _supervised(c: _Context, only) -> dict[str, DataFrame]:
    route, spec = c.route, c.spec()
    texts = c.columns("text")
    if not spec.numeric and not spec.categorical and texts and route.task == "classification":
        return _text_model(c, texts[0])
    out = flows.supervised(c.rows, spec, only)
    models.save(f"{c.run.folder}/model/fitted", out.prepared.features, out.model)
    labels = c.run.spark.createDataFrame([(i, x) for i, x in enumerate(out.prepared.labels)], "class_id int, label string")
    return {"leaderboard": out.leaderboard, "metrics": out.metrics, "predictions": out.predictions, "importance": out.importance, "reliability": out.reliability, "labels": labels}


def _text_model(c: _Context, text: str) -> dict[str, DataFrame]:
    """Texts alone: one text column, candidates on TF-IDF vectors with each fold's own vocabulary."""
    spec = models.Spec(c.route.target, "classification", [ROW])
    data = models.text_frame(c.rows.where(F.col(text).isNotNull()), ROW, text, spec.target)
    train = data.frame.where("part = 'train'")
    board = models.leaderboard(train, models.text_candidates(len(data.labels), train.count()), spec, data.folds, frames=data.frames)
    best = models.best_name(board)
    if best is None:
        raise RuntimeError("no candidate could be trained")
    model, pred, metrics = models.text_final(data, spec, best)
    core = models._core(model)
    weights = core.theta.toArray() if hasattr(core, "theta") else core.coefficientMatrix.toArray() if hasattr(core, "coefficientMatrix") else core.coefficients.toArray()[None, :] if hasattr(core, "coefficients") else None
    terms = [t for t, _ in data.fitted[0]]
    spread = [0.0] * len(terms) if weights is None else (weights.max(0) - weights.min(0) if len(weights) > 1 else abs(weights[0])).tolist()
    imp = stats.importance_table(c.run.spark.createDataFrame(list(zip(terms, spread)), "feature string, w double"), F.col("w"), F.col("w"), 30)
    scores = models.score_texts(data, model, c.rows, ROW, text)
    labels = c.run.spark.createDataFrame([(i, x) for i, x in enumerate(data.labels)], "class_id int, label string")
    return {"leaderboard": board, "metrics": metrics, "predictions": pred, "importance": imp, "reliability": ev.reliability_classification(metrics), "labels": labels, "scores": scores}


def _scores(c: _Context, only) -> dict[str, DataFrame]:
    """Predictions for every row of the table."""
    if "scores" in c.run.state["model"]["sections"]:
        return {"scores": c.run.table("model", "scores")}
    board = c.run.table("model", "leaderboard").where("selected").first()
    own = board["model_name"] == "ExtraTrees" or (board["model_name"] == "GradientBoosting" and c.run.table("model", "labels").count() > 2)
    features, model = models.load(f"{c.run.folder}/model/fitted", trees=own)
    labels = [r["label"] for r in c.run.table("model", "labels").orderBy("class_id").collect()]  # one row per class
    return {"scores": models.score_new(features, model, labels, c.rows, [ROW])}


def _findings(c: _Context, only) -> dict[str, DataFrame]:
    route, imp = c.route, c.run.table("model", "importance")
    ranked = cut_lineage(flows.root_cause(c.rows, route.target, imp, c.order, c.run.table("model", "predictions"), route.task))
    out = _finding_tables(ranked, c.run.table("model", "reliability").first()["level"])
    numeric = set(c.columns("numeric"))
    feats = [r["feature"] for r in imp.where("rank <= 10").collect() if r["feature"] in numeric]
    if route.task == "regression" and len(feats) >= 2:
        out["causal_map"] = fd.causal_map(imp, stats.feature_target(c.rows, feats, route.target), stats.interactions(c.rows, route.target, feats))
    return out


def _finding_tables(ranked: DataFrame, level: str) -> dict[str, DataFrame]:
    return {"findings": ranked, "actions": fd.priority_actions(ranked), "summary": fd.severity_summary(ranked), "confidence": fd.overall_confidence(ranked, level)}


def _insights(c: _Context, only) -> dict[str, DataFrame]:
    route, d = c.route, c.rows
    imp, metrics, rely = (c.run.table("model", s) for s in ("importance", "metrics", "reliability"))
    numeric = c.columns("numeric")
    conc = cut_lineage(ins.concentration(imp))
    layers = [ins.performance_classification(metrics, rely) if route.task == "classification" else ins.performance_regression(metrics), ins.feature_layer(conc)]
    if numeric:
        layers.append(ins.population_layer(ins.population_shape(d, numeric), route.target))
    if len(numeric) >= 2:
        goal = route.target if route.task == "regression" else None
        layers.append(ins.pattern_layer(stats.pair_bands(d, numeric[:20]), stats.nonlinear(d, numeric[:20], goal) if goal else None))
    none = d.limit(0)
    shifts = drift.drift(d, [*numeric[:8]], c.order) if numeric else None
    if numeric:
        layers.append(ins.temporal_layer(drift.trends(d, numeric[:8], c.order, route.target)))
        rate = none.agg(F.lit(0.0).alias("anomaly_pct"), F.lit(0).cast("long").alias("anomaly_count"), F.lit("Low").alias("level"))
        layers.append(ins.risk_layer(conc, rely, rate, shifts))
    ranked = cut_lineage(ins.combine(layers))
    out = {"insights": ranked, "layers": ins.layer_summary(ranked), "flags": ins.risk_flags(ranked)}
    if route.task == "classification":
        report = ev.class_report(ev.pair_counts(c.run.table("model", "predictions"), "actual", "predicted"))
        out["cards"] = ins.supervised_cards(rely, conc, report, ins.target_summary(d, route.target, route.task))
    return out


def _charts(c: _Context, only) -> dict[str, DataFrame]:
    route, imp, pred = c.route, c.run.table("model", "importance"), c.run.table("model", "predictions")
    out = {f"importance_{k}": charts.importance_series(imp, k) for k in ("bars", "doughnut", "decay", "cumulative")}
    out["severity"] = charts.severity_series(c.run.table("findings", "findings"))
    score = "f1_macro" if route.task == "classification" else "r2"
    out["leaderboard"] = charts.leaderboard_series(c.run.table("model", "leaderboard"), "model_name", score)
    spread = imp.agg(F.stddev_pop("impact_pct").alias("impact_std"))
    out["suggested"] = charts.suggestions(ins.concentration(imp), spread, c.rows.agg(F.count("*").alias("n_rows")))
    if route.task == "classification":
        out["confusion"] = ev.pair_counts(pred, "actual", "predicted")
    else:
        out["actual_vs_predicted"] = charts.scatter_sample(pred, "actual", "predicted", [ROW], 300)
        out["errors"] = charts.histogram(pred.withColumn("error", F.col("actual") - F.col("predicted")), "error", 20)
    numeric = [f for f in c.columns("numeric")]
    if route.task == "regression" and numeric:
        out["correlations"] = charts.correlation_bars(c.rows, numeric, route.target)
    return out


# --- unsupervised -----------------------------------------------------------------------------

def _unsupervised(c: _Context, only) -> dict[str, DataFrame]:
    drop = [*c.columns("identifier"), *c.columns("empty"), *c.columns("text"), *c.columns("datetime")]
    options = {} if only is None else {"families": tuple(only), "density": None if "DBSCAN" not in only else clustering_grid()}
    u = flows.unsupervised(c.rows.drop(*drop), ROW, **options)
    features = [x for x in u.rows.columns if x not in (ROW, "cluster")]
    return {"leaderboard": u.leaderboard, "rows": u.rows, "profiles": u.profiles, "quality": u.quality, "separation": u.separation, "anomalies": u.anomalies,
            "features": c.run.spark.createDataFrame([(i, f) for i, f in enumerate(features)], "ordinal int, feature string")}


def clustering_grid():
    from .operators.dbscan import EPS, MIN_SAMPLES

    return EPS, MIN_SAMPLES


def _clustered(c: _Context) -> flows.Unsupervised:
    t = lambda s: c.run.table("model", s)
    best = t("leaderboard").where("selected").first()
    return flows.Unsupervised(t("leaderboard"), f"{best['algorithm']} {best['params']}", t("rows"), t("profiles"), t("quality"), t("separation"), t("anomalies"))


def _assignments(c: _Context, only) -> dict[str, DataFrame]:
    return {"assignments": c.run.table("model", "rows").select(ROW, F.col("cluster").alias("cluster_label"))}


def _cluster_findings(c: _Context, only) -> dict[str, DataFrame]:
    u = _clustered(c)
    return _finding_tables(cut_lineage(flows.unsupervised_findings(u, ROW)), u.quality.first()["level"])


def _cluster_evidence(c: _Context):
    u = _clustered(c)
    features = [r["feature"] for r in c.run.table("model", "features").orderBy("ordinal").collect()]  # one row per feature
    flagged = u.rows.join(u.anomalies, ROW)
    moments = stats.cluster_moments(u.rows, "cluster", features)
    return u, features, flagged, moments


def _cluster_insights(c: _Context, only) -> dict[str, DataFrame]:
    u, features, flagged, moments = _cluster_evidence(c)
    sizes = cut_lineage(clusters.cluster_sizes(u.rows, "cluster"))
    rate = cut_lineage(anomalies.rate(flagged, "is_anomaly"))
    layers = [ins.segment_layer(u.quality, sizes, clusters.segment_contrast(clusters.distinctive_features(moments))),
              ins.anomaly_layer(rate, anomalies.drivers(flagged, "is_anomaly", features), anomalies.most_affected(anomalies.per_cluster(flagged, "is_anomaly", "cluster"))),
              ins.population_layer(ins.population_shape(u.rows, features))]
    if len(features) >= 2:
        layers.append(ins.pattern_layer(stats.pair_bands(u.rows, features[:20])))
    ranked = cut_lineage(ins.combine(layers))
    return {"insights": ranked, "layers": ins.layer_summary(ranked), "flags": ins.risk_flags(ranked), "cards": ins.cluster_cards(u.quality, u.separation, sizes, rate)}


def _cluster_charts(c: _Context, only) -> dict[str, DataFrame]:
    u, features, flagged, _ = _cluster_evidence(c)
    out = {"sizes": clusters.cluster_sizes(u.rows, "cluster"), "severity": charts.severity_series(c.run.table("findings", "findings")),
           "leaderboard": charts.leaderboard_series(u.leaderboard, "algorithm", "main_score"), "anomaly_scores": charts.histogram(u.anomalies, "anomaly_score", 20),
           "anomalies_per_cluster": anomalies.per_cluster(flagged, "is_anomaly", "cluster")}
    if len(features) >= 2:
        from .operators import encode, vectorize

        scaled = encode.standard_scale(u.rows, features)
        axes = vectorize.pca_fit(scaled, features, most=2).transform(scaled, [ROW, "cluster"]) if len(features) > 2 else scaled.select(ROW, "cluster", F.col(features[0]).alias("pc1"), F.col(features[1]).alias("pc2"))
        out["scatter"] = charts.scatter_sample(axes, "pc1", "pc2", [ROW], 400, "cluster")
    return out

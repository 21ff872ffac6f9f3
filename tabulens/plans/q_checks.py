"""Trained and iterative operators over whole tables, reduced to what a statement can say about them:
agreement with planted groups, counts of rows that break a law, metrics at or above a stated floor, a run's manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runs
from ..operators import clustering, encode, evaluate as ev, iforest, impute, models, stats, vectorize
from ..operators.birch import birch
from ..operators.charts import histogram
from ..operators.ranks import number_rows
from ..session import cut_lineage
from . import inputs as I
from .q_features import holes
from .q_flows import place
from .q_models import PRICE, QUALITY, fitted, price_table, quality_table
from .registry import query


# --- clusters ---------------------------------------------------------------------------------

def by_first(d: DataFrame, method: str) -> DataFrame:
    """Clusters numbered by their smallest id."""
    first = d.groupBy("cluster").agg(F.min("id").alias("first"))  # one row per cluster
    return d.join(F.broadcast(number_rows(first, ["first"]).select("cluster", (F.col("rank") - 1).alias("n"))), "cluster").select(F.lit(method).alias("method"), "id", F.col("n").alias("cluster"))


@query("clu_planted_agreement", f"""with {I.PLANTED.strip()}, near as (select * from planted where not far), g as (select cluster, dense_rank() over (order by min(id)) - 1 as n from near group by 1)
  select m as method, id, cast(n as bigint) as cluster from near join g using (cluster), (select unnest(['KMeans', 'GaussianMixture', 'BisectingKMeans', 'TwoPhaseWard', 'Birch']) as m)""")
def _(t):
    """Five methods find the three planted groups, row by row."""
    d = cut_lineage(encode.standard_scale(I.planted(t).where("not far"), ["f1", "f2"]).select("id", "f1", "f2"))
    cols = ["f1", "f2"]
    found = {"KMeans": clustering.kmeans(d, cols, 3)[1], "GaussianMixture": clustering.gaussian_mixture(d, cols, 3)[1], "BisectingKMeans": clustering.bisecting(d, cols, 3)[1],
             "TwoPhaseWard": clustering.two_phase_ward(d, cols, [3], ["id"])[3], "Birch": birch(d, cols, [3]).withColumn("cluster", F.get("clusters", F.lit(0)))}
    return reduce(DataFrame.unionByName, [by_first(x.select("id", "cluster"), m) for m, x in found.items()])


@query("clu08_candidates_check", """select f as algorithm, n as candidates from (values ('KMeans', 9), ('GaussianMixture', 9), ('BisectingKMeans', 9), ('Birch', 9), ('TwoPhaseWard', 5), ('DBSCAN', 24)) v(f, n) where exists (select 1 from customer)""")
def _(t):
    """Every method of the comparison has a row for each of its settings, ranked without gaps."""
    d = encode.standard_scale(I.planted(t), ["f1", "f2"]).select("id", "f1", "f2")
    board, _labelled = clustering.compare(d, ["f1", "f2"], ["id"])
    whole = board.agg((F.max("rank") == F.count("*")).alias("whole"))
    return board.groupBy("algorithm").agg(F.count("*").cast("int").alias("candidates")).join(F.broadcast(whole), F.lit(True)).where("whole").drop("whole")


@query("clu12_assignment_check", """select count(*) as n_rows, 0::bigint as farther from supplier""")
def _(t):
    """Every new row goes to the nearest centre."""
    cust = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    new = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    cols = ["balance", "nation"]
    fit = encode.moments(cust, cols)
    model, _rows = clustering.kmeans(encode.standard_scale(cust, cols, fit), cols, 4)
    got = model.transform(clustering.with_vector(encode.standard_scale(new, cols, fit), cols))
    gap = lambda c: (F.col("balance") - float(c[0])) ** 2 + (F.col("nation") - float(c[1])) ** 2
    gaps = F.array(*[gap(c) for c in model.clusterCenters()])
    return got.agg(F.count("*").alias("n_rows"), F.count_if(F.get(gaps, F.col("cluster")) > F.array_min(gaps) + 1e-9).alias("farther"))


@query("ano01_planted_check", f"with {I.PLANTED.strip()} select count(*) as n_rows, count(*) filter (far) as far_rows, count(*) filter (far) as found from planted")
def _(t):
    """Every planted far row is among the flagged ones."""
    d = I.planted(t)
    flags = iforest.detect(d, ["f1", "f2"], ["id"])
    return d.join(flags, "id").agg(F.count("*").alias("n_rows"), F.count_if("far").alias("far_rows"), F.count_if(F.col("far") & F.col("is_anomaly")).alias("found"))


# --- features ---------------------------------------------------------------------------------

@query("fea04_chained_check", """select count(*) as n_rows, 0::bigint as unfilled, 0::bigint as changed from lineitem""")
def _(t):
    """Chained regressions fill every hole and leave known values alone."""
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    d = cut_lineage(holes(t).withColumn("row", F.monotonically_increasing_id()))
    was = d.select("row", *[F.col(c).alias(f"was_{c}") for c in cols])
    both = impute.mice_fill(d, cols, rounds=4).join(was, "row")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])).alias("unfilled"),
                    F.count_if(reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c) - F.col(f"was_{c}")) > 1e-4, F.lit(False)) for c in cols])).alias("changed"))


@query("fea15_svd_check", """select count(*) as n_rows, 0::bigint as too_long, true as falling, true as share_fits from documents""")
def _(t):
    """Projections of unit vectors are no longer than one, and the directions stand in the order of their squares."""
    out, share = vectorize.text_svd(t.spread("documents", "doc_id"), "doc_id", "text")
    cols = [c for c in out.columns if c != "doc_id"]
    squares = [F.sum(F.col(c) * F.col(c)) for c in cols]
    falling = reduce(lambda a, b: a & b, [x >= y - 1e-6 for x, y in zip(squares, squares[1:])])
    return out.agg(F.count("*").alias("n_rows"), F.count_if(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)) > 1 + 1e-5).alias("too_long"), falling.alias("falling"), F.lit(0 < share <= 100).alias("share_fits"))


@query("fea17_pca_check", """select count(*) as n_rows, max(len(embedding))::double as total_variance, true as uncorrelated from embeddings""")
def _(t):
    """All axes together keep the variance of the scaled columns, and do not correlate."""
    d = vectorize.array_columns(t.embeddings, "embedding", "e")
    cols = [c for c in d.columns if c.startswith("e_")]
    d = encode.standard_scale(d, cols)
    pcs = vectorize.pca_fit(d, cols, variance=1.0).transform(d, ["vec_id"])
    names = [c for c in pcs.columns if c != "vec_id"]
    worst = F.greatest(*[F.abs(F.covar_pop(a, b)) for a, b in zip(names, names[1:])])
    return pcs.agg(F.count("*").alias("n_rows"), F.round(sum((F.var_pop(c) for c in names), F.lit(0.0)), 3).alias("total_variance"), (worst < 1e-3).alias("uncorrelated"))


# --- models -----------------------------------------------------------------------------------

FLOORS = {"RandomForest": 0.60, "ExtraTrees": 0.60, "GradientBoosting": 0.60, "Ridge": 0.75, "LinearRegression": 0.75}


@query("mod_regression_floors", f"select m as model_name, f as floor, true as reached from (values {', '.join(f'({k!r}, {v:.2f}::double)' for k, v in FLOORS.items())}) v(m, f) where exists (select 1 from part)")
def _(t):
    """Pooled out-of-fold R2 of every candidate on the price table, at or above a stated floor."""
    p = models.prepare(price_table(t), PRICE)
    cands = {n: c for n, c in models.candidates_for(p).items() if n in FLOORS}
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv]), F.col("model_name"))
    return models.leaderboard(p.train, cands, PRICE, p.folds).select("model_name", floor.alias("floor"), F.coalesce(F.col("r2") >= floor, F.lit(False)).alias("reached"))


SIX = models.Spec("kind", "classification", ["c_custkey"], ["x", "y", "noise"], trees=10, depth=6, rounds=4)


def six_classes(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", (k % 6).alias("kind"), (10.0 * (k % 3) + F.col("c_acctbal") / 10000).alias("x"), (5.0 * (k % 2) + F.col("c_nationkey") / 25.0).alias("y"), (F.col("c_acctbal") / 1000).alias("noise"))


@query("mod_six_class_floors", """select m as model_name, true as reached from (select unnest(['RandomForest', 'ExtraTrees', 'GradientBoosting', 'LogisticRegression', 'LinearSVC']) as m) where exists (select 1 from customer)""")
def _(t):
    """Six separable classes: macro F1 of the pooled out-of-fold predictions of every candidate is at least 0.9."""
    p = models.prepare(six_classes(t), SIX)
    cands = {n: c for n, c in models.candidates_for(p).items() if n != "XGBoost"}
    return models.leaderboard(p.train, cands, SIX, p.folds).select("model_name", F.coalesce(F.col("f1_macro") >= 0.9, F.lit(False)).alias("reached"))


@query("mod11_text_floors", """select m as model_name, true as reached from (select unnest(['LogisticRegression', 'LinearSVC', 'MultinomialNB']) as m) where exists (select 1 from documents)""")
def _(t):
    """Languages from words: macro F1 of every text candidate, each fold with its own vocabulary, is at least 0.9."""
    spec = models.Spec("lang", "classification", ["doc_id"])
    data = models.text_frame(t.documents.where("lang is not null and text is not null").select("doc_id", "lang", "text"), "doc_id", "text", "lang", max_features=1000)
    train = data.frame.where("part = 'train'")
    board = models.leaderboard(train, models.text_candidates(len(data.labels), train.count()), spec, data.folds, frames=data.frames)
    return board.select("model_name", F.coalesce(F.col("f1_macro") >= 0.9, F.lit(False)).alias("reached"))


@query("mod15_importance_check", """select count(*) > 0 as any_rows, 'p_size' as top_feature, 100.0::double as total from part""")
def _(t):
    """Importance shares of the price model add up to one hundred, the size comes first."""
    p, m, _pred, _metrics = fitted(t, PRICE, price_table(t), "RandomForest")
    imp = models.importance(m, p.train, top=None)
    return imp.agg((F.count("*") > 0).alias("any_rows"), F.min_by("feature", "rank").alias("top_feature"), F.round(F.sum("impact_pct"), 0).alias("total"))


@query("mod16_fit_check", """select count(*) > 0 as fitted, false as worse_than_spread from part""")
def _(t):
    p, _m, _pred, metrics = fitted(t, PRICE, price_table(t), "Ridge")
    return models.spread_warning(metrics, p.train).select((F.col("r2") > 0).alias("fitted"), "worse_than_spread")


@query("eva08_confidence_check", """select count(*) as rows_shown, 0::bigint as outside from documents join labels using (doc_id)""")
def _(t):
    """The histogram of confidences holds every scored row, none below one half with two classes."""
    d = quality_table(t)
    p, m, _pred, _metrics = fitted(t, QUALITY, d, "LogisticRegression")
    scored = models.score_new(p.features, m, p.labels, d, ["doc_id"])
    shown = histogram(scored, "confidence", 10).agg(F.sum("n").cast("long").alias("rows_shown"))
    return shown.join(F.broadcast(scored.agg(F.count_if(~F.col("confidence").between(0.5, 1.0)).alias("outside"))), F.lit(True))  # one row each


@query("eva09_r2_check", """select true as in_range, true as above_floor from part limit 1""")
def _(t):
    p = models.prepare(price_table(t), PRICE)
    pred = models.out_of_fold(p.train, models.candidates_for(p)["Ridge"], ["p_partkey"], p.folds)
    r2 = F.col("r2") * 100
    return ev.regression_metrics(pred, "actual", "predicted").select(r2.between(0, 100).alias("in_range"), (r2 >= 75).alias("above_floor"))


@query("sta12_significance", f"""with {I.SIGNALS}, r as (select f as feature, corr(v, y) as r, count(*) as n from ({" union all ".join(f"select '{c}' as f, {c} as v, y from sig" for c in I.SIGNAL_FEATURES)}) group by 1)
  select feature, abs(r) * sqrt((n - 2) / (1 - r * r)) > 1.96 as significant from r where abs(r) < 0.999999 and abs(r) >= 0.35 and n >= 1000""")
def _(t):
    """With a thousand rows and more, p is below 0.05 where t exceeds 1.96."""
    rows = stats.with_p(stats.feature_target(I.signals(t), I.SIGNAL_FEATURES, "y", None))
    return rows.where("abs(pearson_r) < 0.999999 and abs(pearson_r) >= 0.35 and n >= 1000").select(F.col("feature_a").alias("feature"), (F.col("p_value") < 0.05).alias("significant"))


# --- runs -------------------------------------------------------------------------------------

@query("run_whole_supervised", """with n as (select count(*) as n from part) select stage, place, 'committed' as status, case when stage in ('input', 'scores') then n.n end as n_rows
  from n, (values ('input', 0), ('routing', 1), ('model', 2), ('scores', 3), ('findings', 4), ('insights', 5), ('charts', 6)) v(stage, place)""")
def _(t):
    """The manifest of a whole run over the parts, with the rows of its fixed input and of its scores."""
    out = place(t, "whole")
    d = price_table(t).withColumn("weight", F.col("p_partkey") / 7.0).drop("p_partkey")  # rows stay different
    manifest = runs.run(d, out, "parts", target="goal", task="regression", only=["Ridge"])
    return with_rows(runs.Run(t.spark, out, "parts"), manifest, {"input": "rows", "scores": "scores"})


@query("run_whole_unsupervised", """with n as (select count(*) as n from customer) select stage, place, 'committed' as status, case when stage in ('input', 'scores') then n.n end as n_rows
  from n, (values ('input', 0), ('routing', 1), ('model', 2), ('scores', 3), ('findings', 4), ('insights', 5), ('charts', 6)) v(stage, place)""")
def _(t):
    """The manifest of a run without a target over the customers."""
    out = place(t, "whole")
    d = I.planted(t).select("f1", "f2", (F.col("f3") + F.col("id") / 1e6).alias("f3"))
    manifest = runs.run(d, out, "customers", force="unsupervised", only=["KMeans", "Birch"])
    return with_rows(runs.Run(t.spark, out, "customers"), manifest, {"input": "rows", "scores": "assignments"})


def with_rows(run: runs.Run, manifest: DataFrame, sections: dict[str, str]) -> DataFrame:
    n = F.lit(None).cast("long")
    for stage, section in sections.items():
        if run.done(stage):
            n = F.when(F.col("stage") == stage, run.table(stage, section).count()).otherwise(n)
    return manifest.select("stage", "place", "status", n.alias("n_rows"))

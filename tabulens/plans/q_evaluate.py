"""Evaluation, joins, clusters and anomalies for given labels and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies, charts, clusters, evaluate as ev, profile as pf, stats
from ..operators.findings import counts_by
from ..operators.ranks import number_rows
from . import inputs as I
from .q_profile import ISSUES_SQL, issue_input
from .q_stats import SEPARATION, moments_sql
from .registry import query

REPORT = f"""{I.PRED_CLS}, pc as (select actual, predicted, count(*) n from pred_cls group by 1, 2),
  lab as (select actual as label from pc union select predicted from pc),
  rep0 as (select label, coalesce((select sum(n) from pc where actual = label), 0)::bigint support, coalesce((select sum(n) from pc where predicted = label), 0)::bigint called,
    coalesce((select sum(n) from pc where actual = label and predicted = label), 0)::bigint correct from lab),
  rep1 as (select *, coalesce(correct * 1.0 / nullif(called, 0), 0) as precision, coalesce(correct * 1.0 / nullif(support, 0), 0) as recall from rep0),
  rep as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) f1 from rep1),
  met as (select round(sum(correct) * 1.0 / sum(support), 4) as accuracy, round(avg(case when support > 0 then recall end), 4) as balanced_accuracy,
    round(sum(support * precision) / sum(support), 4) as precision_weighted, round(sum(support * recall) / sum(support), 4) as recall_weighted,
    round(sum(support * f1) / sum(support), 4) as f1_weighted, round(avg(f1), 4) as f1_macro from rep)"""


def pairs(t):
    return ev.pair_counts(I.pred_cls(t), "actual", "predicted")


def report(t):
    return ev.class_report(pairs(t))


@query("eva01_classification_metrics", f"with {REPORT} select * from met")
def _(t):
    return ev.classification_metrics(report(t))


REGMET = f"""{I.PRED_REG}, regmet as (select round(sqrt(avg((actual - predicted) ** 2)), 4) as rmse, round(avg(abs(actual - predicted)), 4) as mae,
  round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 4) as r2, round(avg(abs((actual - predicted) / actual)) * 100, 4) as mape_pct from pred_reg)"""


@query("eva02_regression_metrics", f"with {REGMET} select * from regmet")
def _(t):
    return ev.regression_metrics(I.pred_reg(t), "actual", "predicted")


@query("eva03_confusion_matrix", f"with {REPORT} select a.label as actual, b.label as predicted, coalesce(n, 0) as n from lab a cross join lab b left join pc on pc.actual = a.label and pc.predicted = b.label")
def _(t):
    return ev.confusion_matrix(pairs(t))


@query("eva03_class_report", f"with {REPORT} select label, support, called, correct, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from rep")
def _(t):
    return report(t).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


CONFUSED = """cf0 as (select p.actual, p.predicted, p.n, sum(p.n) over (partition by p.actual) tot from pc p),
  cf as (select c.actual, c.predicted, c.n as confusion_count, round(c.n / tot, 4) as confusion_rate, coalesce(b.n, 0) as reverse_count,
   round(c.n * 1.0 / greatest(coalesce(b.n, 0), 1), 2) as asymmetry_ratio, c.n * 1.0 / greatest(coalesce(b.n, 0), 1) > 3 as one_directional, case when c.n / tot > 0.25 then 'high' else 'medium' end as severity
   from cf0 c left join pc b on b.actual = c.predicted and b.predicted = c.actual where c.actual <> c.predicted)"""


@query("eva04_confused_pairs", f"with {REPORT}, {CONFUSED} select * from cf order by confusion_count desc, actual, predicted limit 8")
def _(t):
    return ev.confusion_pairs(pairs(t))


@query("jon05_reverse_pairs", f"with {REPORT}, {CONFUSED} select actual, predicted, confusion_count, reverse_count, one_directional from cf")
def _(t):
    return ev.confusion_pairs(pairs(t), None).select("actual", "predicted", "confusion_count", "reverse_count", "one_directional")


WEAK = """weak as (select label, support as total_true, correct, round(1 - correct * 1.0 / greatest(support, 1), 4) as error_rate, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1,
  case when recall < 0.5 then 'low_recall' when precision < 0.5 then 'low_precision' when f1 < 0.5 then 'balanced_weakness' else 'acceptable' end as weakness_type from rep)"""


@query("eva04_class_weakness", f"with {REPORT}, {WEAK} select * from weak")
def _(t):
    return ev.class_weakness(report(t))


@query("eva04_error_overview", f"with {REPORT} select sum(case when actual <> predicted then n else 0 end)::bigint as total_misclassified, round(sum(case when actual <> predicted then n else 0 end) / sum(n), 4) as overall_error_rate from pc")
def _(t):
    return ev.error_overview(pairs(t))


@query("eva05_most_confused", f"with {REPORT}, {CONFUSED} select actual, predicted, confusion_count from cf order by confusion_count desc, actual, predicted limit 5")
def _(t):
    return ev.confusion_pairs(pairs(t), 5).select("actual", "predicted", "confusion_count")


@query("eva05_weakest_class", f"with {REPORT} select label as weakest_class, round(f1, 4) as f1 from rep order by rep.f1, label limit 1")
def _(t):
    return ev.weakest_class(report(t))


@query("eva06_residual_summary", f"with {I.PRED_REG} select round(avg(actual - predicted), 4) as mean, round(stddev_pop(actual - predicted), 4) as std, round(max(abs(actual - predicted)), 4) as max_abs_error from pred_reg")
def _(t):
    r = F.col("actual") - F.col("predicted")
    return I.pred_reg(t).agg(F.round(F.avg(r), 4).alias("mean"), F.round(F.stddev_pop(r), 4).alias("std"), F.round(F.max(F.abs(r)), 4).alias("max_abs_error"))


@query("eva06_misclassified_rows", f"with {I.PRED_CLS} select * from pred_cls where actual <> predicted order by o_orderkey limit 20")
def _(t):
    return ev.misclassified(I.pred_cls(t), ["o_orderkey"])


RELY = """rely as (select case when f1_macro >= 0.80 and balanced_accuracy >= 0.80 then 'High' when f1_macro >= 0.60 then 'Moderate' else 'Low' end as level,
  case when f1_macro >= 0.80 and balanced_accuracy >= 0.80 then round_even((f1_macro + balanced_accuracy) / 2 * 100, 0) else round_even(f1_macro * 100, 0) end::bigint as confidence_score from met)"""
POLICY = "level in ('High', 'Moderate') as show_full_dashboard, level = 'High' as allow_decision_language, level <> 'High' as caution_required, level = 'Low' as mark_exploratory"


@query("eva07_reliability_classification", f"with {REPORT}, {RELY} select *, {POLICY} from rely")
def _(t):
    return ev.reliability_classification(ev.classification_metrics(report(t)))


@query("eva07_reliability_regression", f"""with {REGMET}, rr as (select case when r2 >= 0.80 and mape_pct <= 20 then 'High' when r2 >= 0.55 then 'Moderate' else 'Low' end as level,
  round_even(least(1.0, greatest(0.0, r2)) * 100, 0)::bigint as confidence_score from regmet) select *, {POLICY} from rr""")
def _(t):
    return ev.reliability_regression(ev.regression_metrics(I.pred_reg(t), "actual", "predicted"))


@query("eva10_input_checks", f"""with {I.ORDERS_DIRTY}, g as (select status, count(*) k from orders_dirty where status is not null group by 1),
  s as (select count(*) n, round(100.0 * (count(*) - count(status)) / count(*), 4) miss, (select count(*) from g) cl, (select max(k) from g) mx,
   round(avg(case when trim(priority) <> '' then len(regexp_extract_all(priority, '\\S+')) end), 4) tok, count(case when trim(priority) <> '' then 1 end) f from orders_dirty)
  select 'too_few_rows' as "check", n < 10 as failed, n::double as value from s union all select 'target_missing', miss > 50, miss from s union all select 'empty_features', true, 1.0 from s
  union all select 'too_few_classes', cl < 2, cl::double from s union all select 'all_classes_rare', mx < 3, mx::double from s union all select 'text_blank', f = 0, f::double from s union all select 'text_too_short', tok < 2, tok from s""")
def _(t):
    return ev.input_checks(I.orders_dirty(t), "status", "classification", text="priority")


# --- look-ups and joins ----------------------------------------------------------------------

@query("jon03_issue_impact", f"select column_name, issue_type, impact from ({ISSUES_SQL})")
def _(t):
    top = stats.correlation_importance(issue_input(t).withColumn("goal", F.col("c_acctbal") * 2), ["c_acctbal", "c_custkey"], "goal").where("rank = 1")
    return pf.quality_issues(pf.column_profile(issue_input(t)), top).select("column_name", "issue_type", "impact")


@query("jon04_values_with_fields", """select o.o_orderkey as item, n.n_name as field_name, o.o_orderpriority as value from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey
  where o.o_orderstatus = 'F' order by 1, 2""")
def _(t):
    """Extracted values with their field names, for one job, in item order."""
    fields = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    names = t.nation.select("n_nationkey", F.col("n_name").alias("field_name"))
    return (t.orders.where("o_orderstatus = 'F'").join(fields, "o_custkey").join(names, "n_nationkey")
            .select(F.col("o_orderkey").alias("item"), "field_name", F.col("o_orderpriority").alias("value")).orderBy("item", "field_name"))


@query("jon10_keep_and_drop_lists", """select 'kept' as side, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)
  union all select 'dropped', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)""")
def _(t):
    keep = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    count = lambda d, s: d.agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return count(t.lineitem.join(keep, "l_suppkey", "left_semi"), "kept").unionByName(count(t.lineitem.join(keep, "l_suppkey", "left_anti"), "dropped"))


@query("mod13_class_weights", """select o_orderkey, round((select count(*) from orders) * 1.0 / ((select count(distinct o_orderpriority) from orders) * count(*) over (partition by o_orderpriority)), 6) as weight from orders""")
def _(t):
    from ..operators.models import add_class_weights
    return add_class_weights(t.orders, "o_orderpriority").select("o_orderkey", F.round("weight", 6).alias("weight"))


BOARD = """board0 as (select o_orderpriority as model_name, case when min(o_orderkey) = 0 then 'failed' else 'success' end as status, round(avg(o_totalprice) / 300000, 4) as f1_macro,
  round(median(o_totalprice) / 300000, 4) as balanced_accuracy, round(max(o_totalprice) / 600000, 4) as f1_weighted, round(min(o_totalprice) / 2000, 4) as accuracy from orders group by 1),
  board as (select *, row_number() over (order by status = 'success' desc, f1_macro desc, balanced_accuracy desc, f1_weighted desc, accuracy desc, model_name)::bigint as rank from board0)"""


def board(t):
    from ..operators.models import rank_classification
    p = F.col("o_totalprice")
    d = t.orders.groupBy(F.col("o_orderpriority").alias("model_name")).agg(
        F.when(F.min("o_orderkey") == 0, "failed").otherwise("success").alias("status"), F.round(F.avg(p) / 300000, 4).alias("f1_macro"),
        F.round(F.percentile(p, F.lit(0.5)) / 300000, 4).alias("balanced_accuracy"), F.round(F.max(p) / 600000, 4).alias("f1_weighted"), F.round(F.min(p) / 2000, 4).alias("accuracy"))
    return rank_classification(d)


@query("mod14_leaderboard_ranking", f"with {BOARD} select *, rank = 1 as selected from board")
def _(t):
    return board(t)


# --- clusters with given labels --------------------------------------------------------------

def planted_moments(t):
    return stats.cluster_moments(I.planted(t), "cluster", I.PLANTED_FEATURES)


DISTINCT = f"""{moments_sql('planted', I.PLANTED_FEATURES)}, ds as (select cluster, row_number() over (partition by cluster order by abs(m - g) desc, feature)::bigint as place, feature,
  round(m, 6) as cluster_mean, round(g, 6) as global_mean, round(m - g, 6) as difference, case when m > g then 'higher' else 'lower' end as direction from cm join gm using (feature))"""


@query("clu09_distinctive_features", f"with {I.PLANTED}, {DISTINCT} select * from ds where place <= 6")
def _(t):
    return clusters.distinctive_features(planted_moments(t))


SIZES = "sizes as (select cluster, count(*) as size, round(100.0 * count(*) / (select count(*) from planted), 2) as size_pct from planted group by 1)"


@query("clu09_cluster_profiles", f"""with {I.PLANTED}, {DISTINCT}, {SIZES} select cluster, size, size_pct, (select upper(direction[1]) || direction[2:] || ' ' || feature || ' segment' from ds where ds.cluster = sizes.cluster and place = 1) as label,
  (select string_agg(feature, ',' order by place) from ds where ds.cluster = sizes.cluster and place <= 6) as distinctive,
  (select string_agg(id, ',' order by id) from (select id, row_number() over (order by id) r from planted p where p.cluster = sizes.cluster) where r <= 10) as sample_keys from sizes""")
def _(t):
    return clusters.cluster_profiles(I.planted(t), "cluster", planted_moments(t), "id")


VEC_SCORES = f"""{I.VECTORS}, {I.long_sql('vec', I.VECTOR_FEATURES, 'vec_id, cluster,')}, ce as (select cluster, feature, avg(v) m, count(*) n from long group by 1, 2), ge as (select feature, avg(v) g from long group by 1),
  dist as (select vec_id, cluster, sum((v - m) ** 2) q from long join ce using (cluster, feature) group by 1, 2), sc as (select cluster, avg(sqrt(q)) s, sum(q) ss, count(*) n from dist group by 1),
  cd as (select a.cluster c1, b.cluster c2, sqrt(sum((a.m - b.m) ** 2)) d from ce a join ce b using (feature) where a.cluster <> b.cluster group by 1, 2),
  db as (select avg(r) v from (select c1, max((x.s + y.s) / d) r from cd join sc x on x.cluster = c1 join sc y on y.cluster = c2 group by 1)),
  kn as (select count(*) k, sum(n) n, sum(ss) w from sc), bt as (select sum(ce.n * (m - g) ** 2) b from ce join ge using (feature)),
  pw as (select a.vec_id, a.cluster c, b.cluster oc, sum((a.v - b.v) ** 2) d, b.vec_id bid from long a join long b using (feature) group by a.vec_id, a.cluster, b.vec_id, b.cluster),
  pm as (select vec_id, c, oc, case when c = oc then sum(d) / (count(*) - 1) else avg(d) end m from pw group by 1, 2, 3),
  si as (select vec_id, c, (min(case when c <> oc then m end) - max(case when c = oc then m end)) / greatest(min(case when c <> oc then m end), max(case when c = oc then m end)) s from pm group by 1, 2)"""


@query("clu07_silhouette_per_cluster", f"with {VEC_SCORES} select c as cluster, count(*) as n, round(avg(s), 5) + 0.0 as silhouette from si group by 1")
def _(t):
    s = clusters.silhouette(I.vectors(t), "cluster", I.VECTOR_FEATURES)
    return s.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("s"), 5).alias("silhouette"))


@query("clu07_separation_scores", f"with {VEC_SCORES} select k as n_clusters, round((select avg(s) from si), 4) + 0.0 as silhouette, round(db.v, 4) as davies_bouldin, round(b * (n - k) / (w * (k - 1)), 4) as calinski_harabasz from kn, bt, db")
def _(t):
    s = clusters.separation_scores(I.vectors(t), "cluster", I.VECTOR_FEATURES)
    d = t.spark.createDataFrame([(s["n_clusters"], s["silhouette"], s["davies_bouldin"], s["calinski_harabasz"])],
                                "n_clusters long, silhouette double, davies_bouldin double, calinski_harabasz double")
    return d.withColumns({c: F.round(c, 4) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")})


CAND = """cand0 as (select l_suppkey % 7 as params, 'rule' as algorithm, case when l_suppkey % 7 = 6 then 'failed' else 'success' end as status, round(avg(l_discount) * 5, 6) as silhouette, round(avg(l_tax) * 30, 6) as davies_bouldin,
  round(sum(l_quantity), 4) as calinski_harabasz from lineitem group by 1, 2, 3),
  cand as (select *, case when status = 'success' then round(0.60 * silhouette + 0.25 / (1 + greatest(davies_bouldin, 0)) + 0.15 * calinski_harabasz / max(case when status = 'success' then calinski_harabasz end) over (), 6) end as main_score from cand0)"""


@query("clu08_candidate_ranking", f"""with {CAND}, r as (select *, row_number() over (order by status = 'success' desc, main_score desc, silhouette desc, davies_bouldin, calinski_harabasz desc, algorithm, params)::bigint as rank from cand)
  select params::bigint as params, algorithm, status, silhouette, davies_bouldin, calinski_harabasz, main_score, rank, round(max(main_score) over () - main_score, 6) as gap, rank = 1 and status = 'success' as selected from r""")
def _(t):
    g = F.col("l_suppkey") % 7
    d = t.lineitem.groupBy(g.alias("params")).agg(F.round(F.avg("l_discount") * 5, 6).alias("silhouette"), F.round(F.avg("l_tax") * 30, 6).alias("davies_bouldin"),
                                                   F.round(F.sum("l_quantity"), 4).alias("calinski_harabasz"))
    return clusters.rank_candidates(d.withColumns({"algorithm": F.lit("rule"), "status": F.when(F.col("params") == 6, "failed").otherwise("success")}))


@query("clu10_quality_report", f"""with {VEC_SCORES}, sz as (select count(*) n from vec group by cluster), q as (select round((select avg(s) from si), 6) sil, round(db.v, 6) db, round(b * (n - k) / (w * (k - 1)), 6) ch, k from kn, bt, db)
  select case when sil >= 0.50 then 'High' when sil >= 0.25 then 'Moderate' else 'Low' end as level, least(100, greatest(0, round_even((sil + 1) / 2 * 100, 0)))::bigint as confidence_score, k as n_clusters,
  (select round(max(n) * 1.0 / min(n), 4) from sz) as cluster_size_imbalance_ratio, (select max(n) >= 10 * min(n) from sz) as imbalance_warning, sil >= 0.25 as show_full_dashboard, sil >= 0.50 as allow_decision_language,
  sil < 0.50 as caution_required, sil < 0.25 as mark_exploratory from q""")
def _(t):
    return vector_quality(t).drop("silhouette", "davies_bouldin", "calinski_harabasz")


def vector_quality(t):
    s = clusters.separation_scores(I.vectors(t), "cluster", I.VECTOR_FEATURES)
    d = t.spark.createDataFrame([(s["n_clusters"], s["silhouette"], s["davies_bouldin"], s["calinski_harabasz"])],
                                "n_clusters long, silhouette double, davies_bouldin double, calinski_harabasz double")
    return clusters.quality_report(d, clusters.cluster_sizes(I.vectors(t), "cluster"))


CONTRAST = """contrast as (select feature, round(max(cluster_mean) - min(cluster_mean), 4) as range, round((max(cluster_mean) - min(cluster_mean)) / greatest(abs(any_value(global_mean)), 1e-9), 4) as norm_range,
  arg_max(cluster, cluster_mean) as high_segment, arg_min(cluster, cluster_mean) as low_segment from ds where place <= 2 group by 1 having count(*) >= 2 and (max(cluster_mean) - min(cluster_mean)) / greatest(abs(any_value(global_mean)), 1e-9) > 0.30)"""


@query("jon06_segment_contrast", f"with {I.PLANTED}, {DISTINCT}, {CONTRAST} select * from contrast")
def _(t):
    return clusters.segment_contrast(clusters.distinctive_features(planted_moments(t)))


BIPOLAR = "bipolar as (select feature, count(case when direction = 'higher' then 1 end) as n_higher, count(case when direction = 'lower' then 1 end) as n_lower from ds where place <= 3 group by 1 having n_higher > 0 and n_lower > 0)"


@query("jon07_bipolar_features", f"with {I.PLANTED}, {DISTINCT}, {BIPOLAR} select * from bipolar")
def _(t):
    return clusters.bipolar_features(clusters.distinctive_features(planted_moments(t)))


# --- anomalies with a given flag -------------------------------------------------------------

SCORE = "f1 - f2"
ZLONG = f"""{I.long_sql('planted', I.PLANTED_FEATURES, 'id, cluster, far, f1 - f2 as score,', 'zl0')}, zs as (select feature, avg(v) a, stddev_pop(v) s from zl0 group by 1),
  zl as (select id, cluster, far, score, feature, abs((v - a) / case when s = 0 then 1 else s end) z from zl0 join zs using (feature))"""
TOP = f"""worst as (select id from planted where far order by {SCORE} desc, id limit 20),
  topa as (select id, cluster, round(score, 6) as anomaly_score, row_number() over (partition by id order by z desc, feature)::bigint as place, feature, round(z, 6) as abs_z_score from zl semi join worst using (id))"""


def scored(t):
    return I.planted(t).withColumn("score", F.col("f1") - F.col("f2"))


def top_rows(t):
    return anomalies.top_anomalies(scored(t), "far", "score", "id", I.PLANTED_FEATURES, extra=["cluster"])


@query("ano02_top_anomalies", f"with {I.PLANTED}, {ZLONG}, {TOP} select * from topa where place <= 5")
def _(t):
    return top_rows(t)


@query("ano02_feature_drivers", f"with {I.PLANTED}, {ZLONG} select feature, round(avg(z), 6) as mean_abs_z_score from zl where far group by 1")
def _(t):
    return anomalies.drivers(I.planted(t), "far", I.PLANTED_FEATURES)


RATE = "rate0 as (select count(case when far then 1 end) as anomaly_count, round(100.0 * count(case when far then 1 end) / count(*), 4) as anomaly_pct from planted), rate as (select *, case when anomaly_pct > 10 then 'High' when anomaly_pct > 4 then 'Moderate' else 'Low' end as level from rate0)"


@query("ano02_anomaly_rate", f"with {I.PLANTED}, {RATE} select * from rate")
def _(t):
    return anomalies.rate(I.planted(t), "far")


@query("ano03_anomaly_context", f"""with {I.PLANTED}, {DISTINCT}, {ZLONG}, {TOP}, own as (select cluster, list(feature) l from ds where place <= 2 group by 1),
  lab as (select cluster, upper(direction[1]) || direction[2:] || ' ' || feature || ' segment' as label from ds where place = 1),
  mine as (select id, cluster, any_value(anomaly_score) as anomaly_score, list(feature order by feature) m from topa where place <= 2 group by 1, 2)
  select id, cluster, label as cluster_label, anomaly_score, array_to_string(list_filter(m, lambda x: list_contains(l, x)), ',') as cluster_pattern_overlap,
  array_to_string(list_filter(m, lambda x: not list_contains(l, x)), ',') as novel_deviations,
  case when len(list_filter(m, lambda x: list_contains(l, x))) > 0 and len(list_filter(m, lambda x: not list_contains(l, x))) = 0 then 'cluster_consistent' else 'novel_pattern' end as reading
  from mine join own using (cluster) join lab using (cluster)""")
def _(t):
    d = clusters.distinctive_features(planted_moments(t))
    top = anomalies.top_anomalies(scored(t), "far", "score", "id", I.PLANTED_FEATURES, per_row=2, extra=["cluster"])
    return anomalies.with_cluster_context(top, d.where("place <= 2"), clusters.cluster_labels(d), "id")


@query("jon01_anomalies_with_profiles", f"""with {I.PLANTED}, {SIZES} select id, planted.cluster, size, size_pct from planted join sizes on sizes.cluster = planted.cluster where far""")
def _(t):
    d = I.planted(t)
    return d.where("far").join(F.broadcast(clusters.cluster_sizes(d, "cluster")), "cluster", "left").select("id", "cluster", "size", "size_pct")


@query("jon09_deviation_overlap", f"""with {I.PLANTED}, {ZLONG}, top2 as (select id, feature from (select id, feature, row_number() over (partition by id order by z desc, feature) r from zl where far) where r <= 2)
  select id, string_agg(case when feature in ('f1', 'f2') then feature end, ',' order by feature) as overlap, string_agg(case when feature not in ('f1', 'f2') then feature end, ',' order by feature) as novel from top2 group by 1""")
def _(t):
    d = anomalies.z_scores(I.planted(t), I.PLANTED_FEATURES).where("far")
    best = F.slice(F.sort_array(F.transform("z", lambda s: F.struct((-s["abs_z"]).alias("n"), s["feature"].alias("feature")))), 1, 2)
    names = F.sort_array(F.transform(best, lambda s: s["feature"]))
    known = F.array(F.lit("f1"), F.lit("f2"))
    return d.select("id", F.nullif(F.array_join(F.array_intersect(names, known), ","), F.lit("")).alias("overlap"),
                    F.nullif(F.array_join(F.array_except(names, known), ","), F.lit("")).alias("novel"))


AFFECTED = "ac as (select cluster, count(*) n from planted where far group by 1), affected as (select arg_max(cluster, n * 1000000 - cluster) as most_affected, max(n) as anomalies, count(*) as clusters_touched from ac)"


@query("agg18_anomalies_per_cluster", f"with {I.PLANTED}, {AFFECTED} select cluster, n as anomalies from ac")
def _(t):
    return anomalies.per_cluster(I.planted(t), "far", "cluster")


@query("agg18_most_affected_cluster", f"with {I.PLANTED}, {AFFECTED} select * from affected")
def _(t):
    return anomalies.most_affected(anomalies.per_cluster(I.planted(t), "far", "cluster"))


@query("agg21_kpi_row", f"""with {REPORT}, {RELY}, {I.PLANTED}, {RATE} select 1::bigint as position, 'Confidence Score' as title, confidence_score::double as value from rely union all select 2, 'F1 Macro', f1_macro from met
  union all select 3, 'Accuracy', accuracy from met union all select 4, 'Anomaly Rate', anomaly_pct from rate""")
def _(t):
    met = ev.classification_metrics(report(t))
    rely = ev.reliability_classification(met).select("confidence_score")
    one = met.join(F.broadcast(rely), F.lit(True)).join(F.broadcast(anomalies.rate(I.planted(t), "far").select("anomaly_pct")), F.lit(True))
    d = charts.metric_cards(one, [("Confidence Score", "confidence_score"), ("F1 Macro", "f1_macro"), ("Accuracy", "accuracy"), ("Anomaly Rate", "anomaly_pct")])
    return d.withColumn("position", F.col("position") + 1)

"""Findings, insights and chart series, each computed from the tables up."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import anomalies, charts, clusters, drift, evaluate as ev, findings as fd, insights as ins, profile as pf, stats
from . import inputs as I
from .q_evaluate import (AFFECTED, BIPOLAR, CONFUSED, CONTRAST, DISTINCT, RATE, REGMET, RELY, REPORT, SIZES, VEC_SCORES, WEAK, ZLONG, pairs, planted_moments,
                         report, vector_quality)
from .q_profile import ISSUES_SQL, issue_input
from .q_stats import CONC, DRIFT, NONLINEAR, RESIDUAL, SEPARATION, TRENDS, graded_sql, inter_sql, moments_sql, pairs_sql
from .registry import query

SHOW = ["finding_id", "category", "severity", "confidence", "source", "value"]
SHOW_I = ["insight_id", "layer", "severity", "value", "novelty_score", "source"]
IMP = I.SIGNAL_IMPORTANCE
GRADED = graded_sql([(f, "y") for f in I.IMPORTANT], "feature_target")


def correlations(t):
    return stats.feature_target(I.signals(t), I.IMPORTANT, "y")


def line_drift(t):
    return drift.drift(I.orders_trend(t), I.TREND_FEATURES, ["o_orderdate", "o_orderkey"])


FEATURE_F = """ff as (select 'feature_dominance' as finding_id, 'feature_signal' as category, case when impact_pct >= 55 then 'critical' else 'high' end as severity, 'high' as confidence, 'supervised' as source, round(impact_pct, 4) as value from importance where rank = 1 and impact_pct >= 35
  union all select 'top_driver_cluster', 'feature_signal', 'medium', 'high', 'supervised', round(sum(impact_pct), 4) from importance where rank <= 3 having count(*) >= 2
  union all select 'correlation_' || feature_a, 'feature_signal', 'low', 'moderate', 'supervised', pearson_r from (select * from graded order by abs_r desc, feature_a limit 3))"""


@query("fnd01_feature_signal", f"with {IMP}, {GRADED}, {FEATURE_F} select * from ff")
def _(t):
    return fd.feature_findings(I.signal_importance(t), correlations(t)).select(*SHOW)


LEAK_F = """lf as (select 'leakage_proxy_risk_' || nm as finding_id, 'leakage_risk' as category, case when impact_pct >= 50 or ov then 'critical' else 'high' end as severity,
  case when ov then 'high' else 'moderate' end as confidence, 'supervised' as source, impact_pct as value from (select *, replace(replace(lower(feature), '_', ''), '-', '') as nm, contains(replace(lower(feature), '_', ''), 'q') or contains('q', replace(lower(feature), '_', '')) as ov from importance) where rank <= 10
  and (ov or impact_pct >= 50 or (regexp_matches(nm, 'target|label|outcome|result|status|resolved|closed|final|prediction|actual|score|class|category') and impact_pct >= 25)))"""


@query("fnd02_leakage_risk", f"with {IMP}, {LEAK_F} select * from lf")
def _(t):
    return fd.leakage_findings(I.signal_importance(t), "Q").select(*SHOW)


CONF_F = """cff as (select 'primary_class_confusion' as finding_id, 'class_confusion' as category, case when confusion_rate > 0.4 then 'critical' when confusion_rate > 0.25 then 'high' else 'medium' end as severity, 'high' as confidence, 'supervised' as source, confusion_rate as value
   from (select * from cf order by confusion_count desc, actual, predicted limit 1)
  union all select 'weakest_class_rca', 'class_confusion', case when f1 < 0.35 then 'high' else 'medium' end, 'high', 'supervised', error_rate from (select * from weak where weakness_type <> 'acceptable' order by error_rate desc, label limit 1))"""


@query("fnd03_class_confusion", f"with {REPORT}, {CONFUSED}, {WEAK}, {CONF_F} select * from cff")
def _(t):
    return fd.confusion_findings(ev.confusion_pairs(pairs(t)), ev.class_weakness(report(t))).select(*SHOW)


@query("fnd03_weak_class", f"""with {I.PRED_CLS}, r as (select o_orderkey, actual, case when actual = '2-HIGH' then '1-URGENT' else predicted end as predicted from pred_cls), e as (select count(*) n, count(case when predicted <> actual then 1 end) w from r where actual = '2-HIGH')
  select 'weakest_class_rca' as finding_id, 'high' as severity, round(w * 1.0 / n, 4) as value from e""")
def _(t):
    d = I.pred_cls(t).withColumn("predicted", F.when(F.col("actual") == "2-HIGH", "1-URGENT").otherwise(F.col("predicted")))
    p = ev.pair_counts(d, "actual", "predicted")
    f = fd.confusion_findings(ev.confusion_pairs(p), ev.class_weakness(ev.class_report(p)))
    return f.where("finding_id = 'weakest_class_rca'").select("finding_id", "severity", "value")


RES_F = f"""rc as ({pairs_sql([(f, 'res') for f in ['l_quantity', 'l_discount', 'l_tax', 'actual']], '(select *, actual - predicted as res from pred_reg)')}),
 rf as (select 'systematic_bias' as finding_id, 'model_error' as category, 'high' as severity, 'high' as confidence, 'supervised' as source, round(mean_residual, 4) as value from residual where bias_type <> 'unbiased'
  union all select 'heteroscedasticity', 'model_error', 'medium', 'moderate', 'supervised', hetero_r from residual where heteroscedastic
  union all select 'error_concentration', 'model_error', 'medium', 'moderate', 'supervised', round(case when error_concentration = 'high_value_range' then high_pred_mean_abs_error else low_pred_mean_abs_error end, 4) from residual where error_concentration <> 'uniform'
  union all select 'residual_feature_corr_' || feature_a, 'model_error', 'medium', 'moderate', 'supervised', r4 from (select feature_a, round(r, 4) r4 from rc where abs(r) >= 0.30 order by abs(round(r, 4)) desc, feature_a limit 2))"""


@query("fnd04_model_error", f"with {RESIDUAL}, {RES_F} select * from rf")
def _(t):
    d = I.pred_reg(t)
    return fd.residual_findings(stats.residuals(d, "actual", "predicted"), stats.residual_features(d, "actual", "predicted", ["l_quantity", "l_discount", "l_tax", "actual"])).select(*SHOW)


BAL = "bal as (select max(size) * 1.0 / min(size) r from sizes)"
CLUSTER_F = """clf as (select 'primary_segmentation_cause' as finding_id, 'cluster_structure' as category, 'info' as severity, case when impact_pct > 25 then 'high' else 'moderate' end as confidence, 'unsupervised' as source, impact_pct as value from separation where rank = 1
  union all select 'cluster_size_imbalance', 'cluster_structure', case when r >= 10 then 'high' else 'medium' end, 'high', 'unsupervised', round(r, 4) from bal where r >= 5
  union all select 'bipolar_feature_' || feature, 'cluster_structure', 'low', 'moderate', 'unsupervised', (n_higher + n_lower)::double from (select * from bipolar order by feature limit 1)
  union all select 'anomaly_cluster_concentration', 'anomaly', case when anomalies >= 5 then 'high' else 'medium' end, 'moderate', 'unsupervised', anomalies::double from affected)"""
CLUSTER_CTES = f"{I.PLANTED}, {SEPARATION}, {DISTINCT.split(', ds as')[1] and 'ds as' + DISTINCT.split(', ds as')[1]}, {BIPOLAR}, {SIZES}, {BAL}, {AFFECTED}"


def cluster_findings(t):
    d, m = I.planted(t), planted_moments(t)
    best = clusters.distinctive_features(m)
    return fd.cluster_findings(stats.separation(m), clusters.size_balance(clusters.cluster_sizes(d, "cluster")), clusters.bipolar_features(best),
                               anomalies.most_affected(anomalies.per_cluster(d, "far", "cluster")))


@query("fnd05_cluster_structure", f"with {CLUSTER_CTES}, {CLUSTER_F} select * from clf")
def _(t):
    return cluster_findings(t).select(*SHOW)


INTER = inter_sql(["q", "d", "x", "p"], "w")
INTER_F = """itf as (select 'interaction_' || feature_a || '_' || feature_b as finding_id, 'interaction' as category, 'medium' as severity, case when interaction_lift > 0.10 then 'moderate' else 'low' end as confidence, 'supervised' as source, interaction_lift as value
  from inter_all where interacts order by interaction_lift desc, feature_a, feature_b limit 3)"""


@query("fnd06_interactions", f"with {I.SIGNALS}, {INTER}, {INTER_F} select * from itf")
def _(t):
    return fd.interaction_findings(stats.interactions(I.signals(t), "w", ["q", "d", "x", "p"])).select(*SHOW)


DRIFT_F = """df as (select 'drift_' || feature as finding_id, 'drift' as category, severity, case when severity = 'high' then 'high' else 'moderate' end as confidence, case when feature = 'grow' then 'supervised' else 'combined' end as source, normalised_shift as value
  from dr where drifted order by normalised_shift desc, feature limit 3)"""


@query("fnd06_drift", f"with {DRIFT}, {DRIFT_F} select * from df")
def _(t):
    return fd.drift_findings(line_drift(t), "grow").select(*SHOW)


QUALITY_F = f"""iss as ({ISSUES_SQL}), qf as (select 'dq_' || issue_type || '_' || column_name as finding_id, 'data_quality' as category, case when column_name = 'c_acctbal' then severity else 'low' end as severity,
  case when column_name = 'c_acctbal' then 'high' else 'moderate' end as confidence, 'combined' as source, value from iss
  order by impact <> 'high', case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, column_name, issue_type limit 6)"""


def quality_findings(t):
    important = stats.correlation_importance(issue_input(t).withColumn("goal", F.col("c_acctbal") * 2), ["c_acctbal"], "goal")
    return fd.quality_findings(pf.quality_issues(pf.column_profile(issue_input(t)), important), important)


@query("fnd06_data_quality", f"with {QUALITY_F} select * from qf")
def _(t):
    return quality_findings(t).select(*SHOW)


SEV = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end"


def all_findings(t):
    """Findings of several kinds in one table."""
    parts = [fd.feature_findings(I.signal_importance(t), correlations(t)), fd.leakage_findings(I.signal_importance(t), "Q"),
             fd.interaction_findings(stats.interactions(I.signals(t), "w", ["q", "d", "x", "p"])), fd.drift_findings(line_drift(t), "grow"), cluster_findings(t)]
    return ins.union(parts)


ALL_CTES = f"""{IMP}, {GRADED}, {FEATURE_F}, {LEAK_F}, {INTER}, {INTER_F}, {DRIFT.replace('long as', 'dlong as', 1).replace('from long group by', 'from dlong group by')}, {DRIFT_F}, {CLUSTER_CTES}, {CLUSTER_F},
  allf as (select * from ff union all select * from lf union all select * from itf union all select * from df union all select * from clf),
  ranked as (select *, row_number() over (order by {SEV}, category, finding_id)::bigint as rank from allf)"""


@query("fnd07_ranked_findings", f"with {ALL_CTES} select * from ranked")
def _(t):
    return fd.rank_findings(all_findings(t)).select(*SHOW, "rank")


@query("srt01_severity_order", f"with {ALL_CTES} select finding_id, severity, rank from ranked")
def _(t):
    return fd.rank_findings(all_findings(t)).select("finding_id", "severity", "rank")


@query("prj12_finding_filters", f"""with {ALL_CTES} select 'leakage' as list, finding_id from ranked where category = 'leakage_risk' union all select 'urgent', finding_id from ranked where severity in ('critical', 'high')
  union all select 'top_priority', finding_id from (select * from ranked where severity in ('critical', 'high') order by rank limit 3)""")
def _(t):
    r = fd.rank_findings(all_findings(t))
    urgent = r.where("severity in ('critical', 'high')")
    tag = lambda d, s: d.select(F.lit(s).alias("list"), "finding_id")
    return tag(r.where("category = 'leakage_risk'"), "leakage").unionByName(tag(urgent, "urgent")).unionByName(tag(urgent.orderBy("rank").limit(3), "top_priority"))


ACTION = """case when finding_id = 'feature_dominance' then 'Audit the dominant feature' when finding_id = 'top_driver_cluster' then 'Monitor the top features' when finding_id like 'correlation_%' then 'Validate the causal direction'
  when category = 'leakage_risk' then 'Audit the feature before deployment' when category = 'interaction' then 'Add the product of the two features' when category = 'drift' then 'Monitor drift and retrain'
  when finding_id = 'primary_segmentation_cause' then 'Validate the meaning of the driver' when finding_id = 'cluster_size_imbalance' then 'Inspect the small clusters' when category = 'anomaly' then 'Review the profile of that cluster' else 'Use the feature as a label axis' end"""


@query("fnd07_priority_actions", f"""with {ALL_CTES}, a as (select *, {ACTION} as action from ranked), o as (select *, row_number() over (partition by left(action, 60) order by rank) r from a)
  select action, rank as finding_rank, row_number() over (order by rank)::bigint as place from o where r = 1 order by rank limit 10""")
def _(t):
    d = fd.priority_actions(fd.rank_findings(all_findings(t)))
    return d.select(F.regexp_extract("entry", ": ([^:]*)$", 1).alias("action"), "finding_rank", "place")


@query("set01_distinct_by_prefix", f"""with {ALL_CTES}, o as (select left(finding_id, 8) as prefix, finding_id, rank, row_number() over (partition by left(finding_id, 8) order by rank) r from ranked) select prefix, finding_id, rank from o where r = 1""")
def _(t):
    from pyspark.sql import Window as W
    p = F.substring("finding_id", 1, 8)
    r = fd.rank_findings(all_findings(t)).withColumn("r", F.row_number().over(W.partitionBy(p).orderBy("rank")))
    return r.where("r = 1").select(p.alias("prefix"), "finding_id", "rank")


@query("set02_union_of_layers", f"with {ALL_CTES} select category, count(*) as n, max(rank) as last_rank from ranked group by 1")
def _(t):
    return fd.rank_findings(all_findings(t)).groupBy("category").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


@query("fnd07_overall_confidence", f"""with {ALL_CTES}, s as (select count(*) n, count(case when confidence = 'high' then 1 end) * 1.0 / count(*) h from ranked)
  select n as n_findings, round(h, 4) as high_share, case when h >= 0.5 then 'high' when h >= 0.3 then 'moderate' else 'low' end as confidence_level from s""")
def _(t):
    return fd.overall_confidence(all_findings(t), "High")


def causal(t):
    return fd.causal_map(I.signal_importance(t), correlations(t), stats.interactions(I.signals(t), "w", ["q", "d", "x", "p"]))


@query("fnd08_causal_map", f"""with {IMP}, {GRADED}, {INTER}, pr as (select feature_a f, feature_b p, interaction_lift l from inter_all where interacts union all select feature_b, feature_a, interaction_lift from inter_all where interacts),
  pa as (select f, string_agg(p, ',' order by l desc, p) w from (select *, row_number() over (partition by f order by l desc, p) r from pr) where r <= 2 group by 1)
  select rank, feature, impact_pct as importance_pct, direction, 'direct' as pathway, pearson_r is not null as corroborated_by_correlation, strength as correlation_strength, pearson_r, w is not null as has_interaction_effect, coalesce(w, '') as interacts_with
  from (select rank, feature, impact_pct, importance.direction from importance where rank <= 10) i left join (select feature_a, strength, pearson_r from graded) g on g.feature_a = i.feature left join pa on pa.f = i.feature""")
def _(t):
    return causal(t)


@query("jon02_causal_joins", f"""with {IMP}, {GRADED}, {INTER} select feature, pearson_r, (select count(*) from inter_all where interacts and (inter_all.feature_a = i.feature or inter_all.feature_b = i.feature)) > 0 as has_interaction_effect
  from importance i left join graded on graded.feature_a = i.feature""")
def _(t):
    return causal(t).select("feature", "pearson_r", "has_interaction_effect")


@query("fnd09_severity_summary", f"""with {ALL_CTES} select count(*) as n_total, count(case when severity = 'critical' then 1 end) as n_critical, count(case when severity = 'high' then 1 end) as n_high,
  count(case when severity = 'medium' then 1 end) as n_medium, count(case when severity = 'low' then 1 end) as n_low, count(case when severity = 'info' then 1 end) as n_info from ranked""")
def _(t):
    return fd.severity_summary(all_findings(t))


# --- insights --------------------------------------------------------------------------------

PERF_C = """pl as (select 'perf_classification_overview' as insight_id, 'performance' as layer, case level when 'High' then 'info' when 'Moderate' then 'medium' else 'critical' end as severity, f1_macro as value, 0.3 as novelty_score, 'supervised' as source from met, rely
  union all select 'perf_accuracy_masks_classes', 'performance', 'medium', round(accuracy - balanced_accuracy, 4), 0.3, 'supervised' from met where accuracy - balanced_accuracy > 0.08
  union all select 'perf_imbalance_gap', 'performance', 'high', round(f1_weighted - f1_macro, 4), case when f1_weighted - f1_macro > 0.15 then 0.65 else 0.55 end, 'supervised' from met where f1_weighted - f1_macro > 0.10 and f1_macro > 0)"""


def num(sql: str) -> str:
    """Column types as Spark returns them."""
    return f"select insight_id, layer, severity, value::double as value, novelty_score::double as novelty_score, source from ({sql})"


@query("ins01_performance_classification", f"with {REPORT}, {RELY}, {PERF_C} {num('select * from pl')}")
def _(t):
    m = ev.classification_metrics(report(t))
    return ins.performance_classification(m, ev.reliability_classification(m)).select(*SHOW_I)


@query("ins01_performance_regression", f"""with {REGMET}, p as (select 'perf_regression_overview' as insight_id, 'performance' as layer, case when r2 >= 0.80 then 'info' when r2 >= 0.55 then 'medium' else 'critical' end as severity, r2 as value,
  case when mae > 0 and rmse / mae > 2 then 0.45 else 0.3 end as novelty_score, 'supervised' as source from regmet) {num('select * from p')}""")
def _(t):
    return ins.performance_regression(ev.regression_metrics(I.pred_reg(t), "actual", "predicted")).select(*SHOW_I)


FEATURE_L = """fl as (select 'feature_driver_hierarchy' as insight_id, 'feature' as layer, 'info' as severity, coalesce(top3_pct, top_pct) as value, case when coalesce(top3_pct, top_pct) > 80 then 0.55 else 0.4 end as novelty_score, 'supervised' as source from conc
  union all select 'feature_concentration_risk', 'feature', 'high', n_for_80, 0.65, 'supervised' from conc where n_for_80 <= 2 and n_features > 5
  union all select 'feature_directional_split', 'feature', 'info', n_positive, 0.5, 'supervised' from conc where n_positive > 0 and n_negative > 0
  union all select 'feature_long_tail', 'feature', 'low', n_low, 0.4, 'supervised' from conc where n_low > n_features * 0.5)"""


@query("ins02_feature_layer", f"with {IMP}, {CONC}, {FEATURE_L} {num('select * from fl')}")
def _(t):
    return ins.feature_layer(ins.concentration(I.signal_importance(t))).select(*SHOW_I)


SHAPE = f"""{I.long_sql('customer_outliers', ['c_acctbal', 'c_nationkey', 'c_custkey'], '', 'slong')}, shp as (select feature, round(skewness(v), 3) sk, round(kurtosis_pop(v), 3) ku, round(stddev_samp(v) / greatest(abs(avg(v)), 1e-9), 3) cv, count(*) n from slong group by 1),
  pop as (select 'pop_skewed_features' as insight_id, 'population' as layer, 'medium' as severity, count(*) as value, case when count(*) > 4 then 0.55 else 0.45 end as novelty_score, 'combined' as source from shp where abs(sk) > 1.5 having count(*) > 0
  union all select 'pop_heavy_tails', 'population', 'medium', count(*), 0.5, 'combined' from shp where ku > 3 having count(*) > 0
  union all select 'pop_bimodality_hint', 'population', 'low', cv, 0.65, 'combined' from (select * from shp where cv > 0.6 and abs(sk) < 0.5 and n >= 40 order by feature limit 1)
  union all select 'pop_target_high_variance', 'population', 'medium', cv, 0.5, 'supervised' from shp where feature = 'c_acctbal' and cv > 1)"""


@query("ins03_population_layer", f"with {I.CUSTOMER_OUTLIERS}, {SHAPE} {num('select * from pop')}")
def _(t):
    return ins.population_layer(ins.population_shape(I.customer_outliers(t), ["c_acctbal", "c_nationkey", "c_custkey"]), "c_acctbal").select(*SHOW_I)


PATTERN = f"""bd as (select *, abs(r) a from ({pairs_sql(list(combinations(['q', 'd', 'x', 'q6', 'p', 'y'], 2)))})), pat as (
  select 'pattern_multicollinearity' as insight_id, 'pattern' as layer, 'high' as severity, count(*) as value, 0.60 as novelty_score, 'combined' as source from bd where a >= 0.80 having count(*) > 0
  union all select 'pattern_feature_correlations', 'pattern', 'low', count(*), 0.35, 'combined' from bd where a >= 0.35 and a < 0.80 having count(*) > 0
  union all select 'pattern_nonlinearity', 'pattern', 'medium', lift, case when lift > 0.20 then 0.75 else 0.65 end, 'supervised' from (select * from nonlin where nonlinear order by lift desc, feature limit 1))"""


@query("ins04_pattern_layer", f"with {I.SIGNALS}, {NONLINEAR}, {PATTERN} {num('select * from pat')}")
def _(t):
    d = I.signals(t)
    return ins.pattern_layer(stats.pair_bands(d, ["q", "d", "x", "q6", "p", "y"]), stats.nonlinear(d, I.IMPORTANT, "y")).select(*SHOW_I)


@query("ins05_segment_layer", f"""with {VEC_SCORES}, qq as (select round(avg(s), 6) sil from si), seg as (select 'segment_quality_overview' as insight_id, 'segment' as layer, case when sil >= 0.50 then 'info' when sil >= 0.25 then 'medium' else 'critical' end as severity,
  round(sil, 4) as value, 0.35 as novelty_score, 'unsupervised' as source from qq), {I.PLANTED}, {DISTINCT.replace('long as', 'plong as', 1).replace('from long', 'from plong')}, {CONTRAST}, {SIZES}
  {num('''select * from seg union all select 'segment_dominant_cluster', 'segment', 'medium', size_pct, 0.45, 'unsupervised' from (select * from sizes order by size desc, cluster limit 1) where size_pct > 50
  union all select 'segment_sharpest_contrast', 'segment', 'info', norm_range, 0.55, 'unsupervised' from (select * from contrast order by norm_range desc, feature limit 1)''')}""")
def _(t):
    d = clusters.distinctive_features(planted_moments(t))
    return ins.segment_layer(vector_quality(t), clusters.cluster_sizes(I.planted(t), "cluster"), clusters.segment_contrast(d)).select(*SHOW_I)


ANOMALY_L = """al as (select 'anomaly_rate_overview' as insight_id, 'anomaly' as layer, case level when 'High' then 'high' when 'Moderate' then 'medium' else 'info' end as severity, anomaly_pct as value, case level when 'High' then 0.7 else 0.5 end as novelty_score, 'unsupervised' as source from rate where anomaly_count > 0
  union all select 'anomaly_feature_drivers', 'anomaly', 'medium', round(m, 4), 0.60, 'unsupervised' from (select feature, round(avg(z), 6) m from zl where far group by 1 order by m desc, feature limit 1)
  union all select 'anomaly_cluster_colocation', 'anomaly', 'medium', anomalies, 0.60, 'unsupervised' from affected where anomalies >= 2)"""


def anomaly_layer(t):
    d = I.planted(t)
    return ins.anomaly_layer(anomalies.rate(d, "far"), anomalies.drivers(d, "far", I.PLANTED_FEATURES), anomalies.most_affected(anomalies.per_cluster(d, "far", "cluster")))


@query("ins06_anomaly_layer", f"with {I.PLANTED}, {RATE}, {ZLONG}, {AFFECTED}, {ANOMALY_L} {num('select * from al')}")
def _(t):
    return anomaly_layer(t).select(*SHOW_I)


TEMPORAL = """tl as (select 'temporal_trend_detected' as insight_id, 'temporal' as layer, case when is_target and abs(spearman_r) > 0.5 then 'high' else 'medium' end as severity, spearman_r as value, case when is_target then 0.75 else 0.60 end as novelty_score, 'combined' as source
   from (select * from trends where trending order by abs(spearman_r) desc, feature limit 1)
  union all select 'temporal_multi_feature_drift', 'temporal', 'medium', least(count(*), 3), 0.65, 'combined' from trends where trending and not is_target having count(*) >= 2)"""


@query("ins07_temporal_layer", f"with {TRENDS}, {TEMPORAL} {num('select * from tl')}")
def _(t):
    return ins.temporal_layer(drift.trends(I.orders_trend(t), I.TREND_FEATURES, ["o_orderdate", "o_orderkey"], target="grow")).select(*SHOW_I)


RISK = """rl as (select 'risk_leakage_warning' as insight_id, 'risk' as layer, 'critical' as severity, top_pct as value, 0.80 as novelty_score, 'supervised' as source from conc where top_pct > 50
  union all select 'risk_deployment_not_ready', 'risk', 'critical', confidence_score, 0.50, 'combined' from rely where level = 'Low'
  union all select 'risk_drift_performance_decay', 'risk', 'high', count(*), 0.65, 'combined' from dr where drifted having count(*) >= 2
  union all select 'opp_decision_automation', 'risk', 'info', confidence_score, 0.50, 'supervised' from rely where level = 'High'
  union all select 'opp_anomaly_investigation', 'risk', 'medium', anomaly_pct, 0.55, 'unsupervised' from rate where level in ('High', 'Moderate') and anomaly_pct > 0)"""
RISK_CTES = f"{IMP}, {CONC}, {REPORT}, {RELY}, {DRIFT}, {I.PLANTED}, {RATE}, {RISK}"


def risk_layer(t):
    rely = ev.reliability_classification(ev.classification_metrics(report(t)))
    return ins.risk_layer(ins.concentration(I.signal_importance(t)), rely, anomalies.rate(I.planted(t), "far"), line_drift(t))


@query("ins08_risk_layer", f"with {RISK_CTES} {num('select * from rl')}")
def _(t):
    return risk_layer(t).select(*SHOW_I)


COMBINED = f"""{RISK_CTES}, {PERF_C}, {FEATURE_L}, {ZLONG}, {AFFECTED}, {ANOMALY_L}, alli as (select * from rl union all select * from pl union all select * from fl union all select * from al),
  ir as (select *, row_number() over (order by {SEV}, novelty_score desc, layer, insight_id)::bigint as rank from alli)"""


def combined(t):
    m = ev.classification_metrics(report(t))
    return ins.combine([risk_layer(t), ins.performance_classification(m, ev.reliability_classification(m)), ins.feature_layer(ins.concentration(I.signal_importance(t))), anomaly_layer(t)])


@query("ins09_ranked_insights", f"with {COMBINED} select insight_id, layer, severity, value::double as value, novelty_score::double as novelty_score, source, rank from ir")
def _(t):
    return combined(t).select(*SHOW_I, "rank")


@query("ins09_layer_summary", f"with {COMBINED} select layer, count(*) as n, arg_min(insight_id, rank) as key_insight from ir group by 1")
def _(t):
    return combined(t).groupBy("layer").agg(F.count("*").alias("n"), F.min_by("insight_id", "rank").alias("key_insight"))


@query("ins09_risk_flags", f"""with {COMBINED} select case when severity in ('critical', 'high') then 'risk' else 'opportunity' end as kind, insight_id, severity from ir
  where layer = 'risk' and (severity in ('critical', 'high') or (insight_id like 'opp_%' and severity in ('info', 'low', 'medium')))""")
def _(t):
    return ins.risk_flags(combined(t)).drop("title")


@query("ins10_supervised_cards", f"""with {REPORT}, {RELY}, {IMP}, {CONC}, ms as (select min(n) * 100.0 / sum(n) s from (select count(*) n from orders group by o_orderpriority))
  select 'model_reliability' as card, level as shown, confidence_score::double as value, case level when 'High' then 'success' when 'Moderate' then 'warning' else 'danger' end as severity from rely
  union all select 'primary_driver', top_feature, top_pct, 'success' from conc union all (select 'weakest_class', label, round(f1, 4), 'warning' from rep order by f1, label limit 1)
  union all select 'class_imbalance', 'minority class', round(s, 2), 'warning' from ms where round(s, 2) < 10""")
def _(t):
    rep = report(t)
    return ins.supervised_cards(ev.reliability_classification(ev.classification_metrics(rep)), ins.concentration(I.signal_importance(t)), rep,
                                ins.target_summary(t.orders, "o_orderpriority", "classification"))


@query("ins10_cluster_cards", f"""with {I.PLANTED}, {SEPARATION}, {SIZES}, {RATE} select 'primary_cluster_driver' as card, feature as shown, impact_pct as value, 'success' as severity from separation where rank = 1
  union all select 'cluster_size_pattern', 'largest share', max(size_pct), case when max(size) >= 10 * min(size) then 'warning' else 'success' end from sizes
  union all select 'segment_balance', 'share gap', round(max(size_pct) - min(size_pct), 2), case when max(size_pct) - min(size_pct) > 50 then 'warning' else 'success' end from sizes
  union all select 'anomaly_detection', level, anomaly_pct, case level when 'High' then 'danger' when 'Moderate' then 'warning' else 'success' end from rate""")
def _(t):
    d = I.planted(t)
    return ins.cluster_cards(vector_quality(t), stats.separation(planted_moments(t)), clusters.cluster_sizes(d, "cluster"), anomalies.rate(d, "far")).where("card <> 'cluster_quality'")


# --- chart series ----------------------------------------------------------------------------

@query("chd01_importance_bars", f"with {IMP} select rank, feature as label, impact_pct as value from importance")
def _(t):
    return charts.importance_series(I.signal_importance(t), "bars")


@query("chd01_importance_doughnut", f"with {IMP} select rank, feature as label, impact_pct as value from importance where rank <= 6")
def _(t):
    return charts.importance_series(I.signal_importance(t), "doughnut")


@query("chd02_chart_choice", f"""with {IMP}, {CONC}, sd as (select stddev_pop(impact_pct) s from importance), n as (select count(*) n from lineitem),
  r as (select * from (values (0, 'impact_ranking', 'horizontalBar', 'critical'), (1, 'weight_allocation', 'doughnut', 'high'), (2, 'cumulative_power', 'line', 'high'), (3, 'decay_curve', 'line', 'medium'), (4, 'decision_profile', 'radar', 'high'),
    (5, 'top_interaction', 'scatter', 'medium'), (6, 'balanced_distribution', 'polarArea', 'medium'), (7, 'lever_comparison', 'bar', 'low')) v(seq, chart_id, chart_type, priority)),
  ok as (select r.* from r, conc, sd, n where case seq when 0 then n_features >= 1 when 1 then top2_pct > 50 and n_features >= 4 when 2 then n_features >= 4 when 3 then n_features >= 5 when 4 then n_features between 4 and 12
    when 5 then n >= 50 and n_features >= 2 when 6 then s < 15 and n_features >= 5 else n_features between 5 and 10 end)
  select chart_id, chart_type, priority, row_number() over (order by case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, seq)::bigint as place from ok order by place limit 8""")
def _(t):
    imp = I.signal_importance(t)
    return charts.suggestions(ins.concentration(imp), imp.agg(F.stddev_pop("impact_pct").alias("impact_std")), t.lineitem.agg(F.count("*").alias("n_rows")))


@query("srt05_unique_chart_list", """with c as (select l_shipdate, l_returnflag || l_linestatus as chart_id, min(l_orderkey * 10 + l_linenumber) as seq from lineitem group by 1, 2), o as (select chart_id, min(seq) s from c group by 1)
  select chart_id, row_number() over (order by s, chart_id)::bigint as place from o order by place limit 10""")
def _(t):
    d = t.lineitem.groupBy("l_shipdate", F.concat("l_returnflag", "l_linestatus").alias("chart_id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return charts.unique_charts(d).select("chart_id", "place")


@query("chd03_scatter_sample", """select o_orderkey, o_custkey::double as x, o_totalprice as y from orders order by md5(o_orderkey || '|42'), o_orderkey limit 300""")
def _(t):
    return charts.scatter_sample(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"], 300)


@query("chd03_cluster_scatter", f"""with {I.VECTORS} select vec_id, v0 as x, v1 as y, cluster as color from vec order by md5(vec_id || '|42'), vec_id limit 1000""")
def _(t):
    return charts.scatter_sample(I.vectors(t), "v0", "v1", ["vec_id"], 1000, "cluster")


@query("chd04_confusion_series", f"with {REPORT} select 'Actual: ' || a.label as label, 'Pred: ' || b.label as series, coalesce(n, 0) as value from lab a cross join lab b left join pc on pc.actual = a.label and pc.predicted = b.label")
def _(t):
    return ev.confusion_matrix(pairs(t)).select(F.concat(F.lit("Actual: "), "actual").alias("label"), F.concat(F.lit("Pred: "), "predicted").alias("series"), F.col("n").alias("value"))


@query("chd04_actual_vs_predicted", f"with {I.PRED_REG} select l_orderkey, l_linenumber, round(actual, 4) as x, round(predicted, 4) as y, round(predicted - actual, 4) as residual from pred_reg order by abs(actual - predicted) desc, l_orderkey, l_linenumber limit 200")
def _(t):
    d = ev.largest_errors(I.pred_reg(t), ["l_orderkey", "l_linenumber"], top=200)
    return d.select("l_orderkey", "l_linenumber", F.round("actual", 4).alias("x"), F.round("predicted", 4).alias("y"), (-F.col("residual")).alias("residual"))


@query("chd04_severity_series", f"with {ALL_CTES}, s as (select severity, count(*) as value from ranked group by 1) select upper(severity[1]) || severity[2:] as label, value, row_number() over (order by {SEV})::bigint as place from s")
def _(t):
    return charts.severity_series(all_findings(t))


@query("chd04_layer_series", f"with {COMBINED}, s as (select layer, count(*) as value from ir group by 1) select upper(layer[1]) || layer[2:] as label, value, row_number() over (order by layer)::bigint as place from s")
def _(t):
    return charts.count_series(combined(t), "layer")


@query("chd04_cluster_size_series", f"with {I.PLANTED}, {SIZES} select 'Cluster ' || cluster as label, size as value, size_pct from sizes")
def _(t):
    d = clusters.cluster_sizes(I.planted(t), "cluster")
    return d.select(F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("label"), F.col("size").alias("value"), "size_pct")


@query("chd04_metrics_series", f"with {REPORT} select 0::bigint as position, 'Accuracy' as title, accuracy as value from met union all select 1, 'Balanced Accuracy', balanced_accuracy from met union all select 2, 'F1 Macro', f1_macro from met union all select 3, 'F1 Weighted', f1_weighted from met")
def _(t):
    return charts.metric_cards(ev.classification_metrics(report(t)), [("Accuracy", "accuracy"), ("Balanced Accuracy", "balanced_accuracy"), ("F1 Macro", "f1_macro"), ("F1 Weighted", "f1_weighted")])


@query("chd05_error_histogram", f"""with {I.PRED_REG}, v as (select abs(actual - predicted) v from pred_reg), mm as (select min(v) lo, max(v) hi, (max(v) - min(v)) / 12 w from v), h as (select least(floor((v - lo) / w), 11)::bigint as bin, count(*) n from v, mm group by 1)
  select g.bin, round(lo + g.bin * w, 4) + 0.0 as lower, round(lo + (g.bin + 1) * w, 4) + 0.0 as upper, coalesce(n, 0) as n from (select unnest(range(12))::bigint as bin) g left join h using (bin), mm""")
def _(t):
    return charts.histogram(I.pred_reg(t).select(F.abs(F.col("actual") - F.col("predicted")).alias("e")), "e", 12)


@query("chd06_correlation_bars", f"with {I.SIGNALS}, c as ({pairs_sql([(f, 'y') for f in I.SIGNAL_FEATURES])}) select feature_a as label, round(abs(r), 4) as value from c order by value desc, label limit 10")
def _(t):
    return charts.correlation_bars(I.signals(t), I.SIGNAL_FEATURES, "y")

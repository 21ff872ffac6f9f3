"""Statistics, drift, windows and ranks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import charts, clusters, drift, insights, ranks, sampling, stats
from ..operators.quantiles import split_ends
from . import inputs as I
from .registry import query

PEARSON_BANDS = """case when abs(r) >= 0.55 then 'strong' else 'moderate' end as strength, case when r > 0 then 'positive' else 'negative' end as direction"""


def pairs_sql(pairs, table="sig"):
    return " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, count(case when {a} is not null and {b} is not null then 1 end) as n, corr({a}, {b}) as r from {table}" for a, b in pairs)


def graded_sql(pairs, kind, table="sig"):
    return f"""c as ({pairs_sql(pairs, table)}),
graded as (select feature_a, feature_b, n, round(r, 4) as pearson_r, round(abs(r), 4) as abs_r, {PEARSON_BANDS}, '{kind}' as type
  from c where abs(r) >= 0.30 and n >= 15 order by round(abs(r), 4) desc, feature_a, feature_b limit 20)"""


@query("sta01_feature_target_correlation", f"""with {I.SIGNALS}, {graded_sql([(f, 'y') for f in I.SIGNAL_FEATURES], 'feature_target')} select * from graded""")
def _(t):
    return stats.feature_target(I.signals(t), I.SIGNAL_FEATURES, "y")


@query("sta02_feature_pair_correlation", f"""with {I.SIGNALS}, {graded_sql(list(combinations(I.SIGNAL_FEATURES + ['y', 'w'], 2)), 'feature_feature')} select * from graded""")
def _(t):
    return stats.feature_pairs(I.signals(t), I.SIGNAL_FEATURES + ["y", "w"])


@query("sta02_pair_bands", f"""with {I.SIGNALS}, c as ({pairs_sql(list(combinations(['q', 'd', 'x', 'q6', 'p', 'y'], 2)))})
  select feature_a, feature_b, round(r, 4) as r, case when abs(r) >= 0.80 then 'multicollinear' else 'moderate' end as grade from c where abs(r) >= 0.35""")
def _(t):
    return stats.pair_bands(I.signals(t), ["q", "d", "x", "q6", "p", "y"])


@query("sta03_correlation_matrix", f"""with {I.SIGNALS}, c as ({pairs_sql(list(combinations(['q', 'd', 'x', 'q6', 'p'], 2)))})
  select feature_a as "row", feature_b as col, round(r, 4) + 0.0 as value from c union all select feature_b, feature_a, round(r, 4) + 0.0 from c
  union all select unnest(['q', 'd', 'x', 'q6', 'p']) as f, f, 1.0""")
def _(t):
    return stats.correlation_matrix(I.signals(t), ["q", "d", "x", "q6", "p"])


def spearman_sql(a: str, b: str, table: str) -> str:
    return f"""select '{a}' as feature_a, '{b}' as feature_b, count(*) as n, corr(ra, rb) as rho from (
  select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb
  from {table} where {a} is not null and {b} is not null)"""


@query("sta04_spearman", f"""with {I.SIGNALS}, s as ({' union all '.join(spearman_sql(f, 'y', 'sig') for f in I.SIGNAL_FEATURES)})
  select feature_a, feature_b, n, round(rho, 4) + 0.0 as spearman_r from s""")
def _(t):
    return ranks.spearman(I.signals(t), [(f, "y") for f in I.SIGNAL_FEATURES]).withColumn("spearman_r", F.round("spearman_r", 4))


NONLINEAR = f"""sp as ({' union all '.join(spearman_sql(f, 'y', 'sig') for f in ['q', 'd', 'x', 'q6', 'p'])}),
  pe as ({pairs_sql([(f, 'y') for f in ['q', 'd', 'x', 'q6', 'p']])}),
  nonlin as (select feature_a as feature, sp.n, round(r, 4) + 0.0 as pearson_r, round(rho, 4) + 0.0 as spearman_r, round(abs(rho) - abs(r), 4) + 0.0 as lift,
    abs(rho) - abs(r) > 0.10 and abs(rho) >= 0.35 as nonlinear from sp join pe using (feature_a))"""


@query("sta05_nonlinearity", f"with {I.SIGNALS}, {NONLINEAR} select * from nonlin")
def _(t):
    return stats.nonlinear(I.signals(t), I.IMPORTANT, "y")


def inter_sql(feats, y, table="sig"):
    rows = " union all ".join(f"""select '{a}' as feature_a, '{b}' as feature_b, n, corr(a, y) ra, corr(b, y) rb, corr((a - ma) * (b - mb), y) ri from (
   select {a} a, {b} b, {y} y, avg({a}) over () ma, avg({b}) over () mb, count(*) over () n from {table} where {a} is not null and {b} is not null and {y} is not null) group by n""" for a, b in combinations(feats, 2))
    return f"""it as ({rows}), inter_all as (select feature_a, feature_b, n, round(ra, 4) + 0.0 as r_a_target, round(rb, 4) + 0.0 as r_b_target, round(ri, 4) + 0.0 as r_interaction_target,
  round(abs(ri) - greatest(abs(ra), abs(rb)), 4) as interaction_lift, abs(ri) - greatest(abs(ra), abs(rb)) > 0.05 and abs(ri) >= 0.30 as interacts,
  case when abs(ri) >= 0.55 then 'strong' else 'moderate' end as strength from it)"""


@query("sta06_interaction_lift", f"with {I.SIGNALS}, {inter_sql(['q', 'd', 'x', 'p'], 'w')} select * from inter_all")
def _(t):
    return stats.interactions(I.signals(t), "w", ["q", "d", "x", "p"], keep_all=True)


ENDS = """pos as (select *, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from trend),
  ends as (select *, case when rn <= greatest(n // 5, 10) then 'early' when rn > n - greatest(n // 5, 10) then 'late' end as side from pos)"""
KS_P = "least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * lam * lam)))))"
DRIFT = f"""{I.ORDERS_TREND}, {ENDS}, {I.long_sql("(select * from ends where side is not null)", I.TREND_FEATURES, "side,")},
  freq as (select feature, v, count(case when side = 'early' then 1 end) e, count(case when side = 'late' then 1 end) l from long group by 1, 2),
  cum as (select feature, sum(e) over w * 1.0 / sum(e) over (partition by feature) fe, sum(l) over w * 1.0 / sum(l) over (partition by feature) fl from freq
    window w as (partition by feature order by v rows between unbounded preceding and current row)),
  ks as (select feature, max(abs(fe - fl)) d from cum group by 1),
  mo as (select feature, avg(case when side = 'early' then v end) me, avg(case when side = 'late' then v end) ml, stddev_samp(case when side = 'early' then v end) sd,
    count(case when side = 'early' then 1 end) ne, count(case when side = 'late' then 1 end) nl from long group by 1),
  dr0 as (select *, sqrt(ne * nl * 1.0 / (ne + nl)) * d as lam, abs(ml - me) / case when sd = 0 then 1 else sd end as norm from mo join ks using (feature)),
  dr as (select feature, round(d, 4) as ks_statistic, round(case when lam < 0.2 then 1.0 else {KS_P} end, 6) as p_value, round(me, 4) as mean_early, round(ml, 4) as mean_late,
    round(ml - me, 4) as mean_shift, round(norm, 4) as normalised_shift, case when ml > me then 'increased' else 'decreased' end as direction,
    case when norm > 1.0 then 'high' else 'medium' end as severity, case when lam < 0.2 then 1.0 else {KS_P} end < 0.05 and norm > 0.30 as drifted from dr0)"""


@query("sta07_drift", f"with {DRIFT} select * from dr")
def _(t):
    return drift.drift(I.orders_trend(t), I.TREND_FEATURES, ["o_orderdate", "o_orderkey"])


TRENDS = f"""{I.ORDERS_TREND}, {ENDS}, {I.long_sql("ends", I.TREND_FEATURES, "rn, side,")},
  rk as (select feature, side, v, rn, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 as rv from long),
  tr as (select feature, count(*) as n, corr(rn, rv) rho, avg(case when side = 'early' then v end) em, avg(case when side = 'late' then v end) lm from rk group by 1),
  trends as (select feature, n, round(rho, 4) as spearman_r, case when rho > 0 then 'upward' else 'downward' end as direction, round((lm - em) / greatest(abs(em), 1e-9) * 100, 2) as pct_change,
    round(em, 4) as early_mean, round(lm, 4) as late_mean, feature = 'grow' as is_target, abs(rho) >= 0.25 as trending from tr)"""


@query("sta08_trends", f"with {TRENDS} select * from trends")
def _(t):
    return drift.trends(I.orders_trend(t), I.TREND_FEATURES, ["o_orderdate", "o_orderkey"], target="grow")


RESIDUAL = f"""{I.PRED_REG}, r as (select actual - predicted as res, predicted as pred from pred_reg), md as (select median(pred) m from r),
  s as (select count(*) n, avg(res) m, stddev_pop(res) s, skewness(res) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) g, kurtosis_pop(res) k, corr(pred, abs(res)) h,
    avg(case when pred >= md.m then abs(res) end) hi, avg(case when pred < md.m then abs(res) end) lo, max(abs(res)) mx from r, md),
  residual as (select n as n_samples, round(m, 6) as mean_residual, round(s, 6) as std_residual, round(g, 4) as skewness, round(k, 4) as kurtosis,
    case when abs(m) > 0.1 * s then case when m < 0 then 'systematic_overprediction' else 'systematic_underprediction' end else 'unbiased' end as bias_type,
    case when hi > 1.3 * lo then 'high_value_range' when lo > 1.3 * hi then 'low_value_range' else 'uniform' end as error_concentration,
    round(n / 6.0 * (g * g + k * k / 4), 4) as jarque_bera, exp(-(n / 6.0 * (g * g + k * k / 4)) / 2) > 0.05 as normal, round(h, 4) as hetero_r, abs(h) > 0.30 as heteroscedastic,
    round(hi, 6) as high_pred_mean_abs_error, round(lo, 6) as low_pred_mean_abs_error, round(mx, 6) as max_abs_error from s)"""


@query("sta09_residual_analysis", f"with {RESIDUAL} select * exclude (jarque_bera, normal, mean_residual, std_residual, high_pred_mean_abs_error, low_pred_mean_abs_error), round(mean_residual, 4) as mean_residual, round(std_residual, 4) as std_residual, round(high_pred_mean_abs_error, 4) as high_pred_mean_abs_error, round(low_pred_mean_abs_error, 4) as low_pred_mean_abs_error from residual")
def _(t):
    d = stats.residuals(I.pred_reg(t), "actual", "predicted").drop("jarque_bera", "normal")
    return d.withColumns({c: F.round(c, 4) for c in ("mean_residual", "std_residual", "high_pred_mean_abs_error", "low_pred_mean_abs_error")})


@query("sta09_residual_features", f"""with {I.PRED_REG}, c as ({pairs_sql([(f, 'res') for f in ['l_quantity', 'l_discount', 'l_tax', 'actual']], '(select *, actual - predicted as res from pred_reg)')})
  select feature_a as feature, round(r, 4) as pearson_r, case when r < 0 then 'over-prediction' else 'under-prediction' end as reading from c where abs(r) >= 0.30""")
def _(t):
    return stats.residual_features(I.pred_reg(t), "actual", "predicted", ["l_quantity", "l_discount", "l_tax", "actual"])


@query("sta10_normality", f"with {RESIDUAL} select n_samples, round(jarque_bera, 1) as jarque_bera, normal from residual")
def _(t):
    return stats.residuals(I.pred_reg(t), "actual", "predicted").select("n_samples", F.round("jarque_bera", 1).alias("jarque_bera"), "normal")


def moments_sql(table, features, cluster="cluster"):
    return f"""{I.long_sql(table, features, cluster + ' as cluster,')}, cm as (select cluster, feature, count(*) n, avg(v) m, var_samp(v) vr from long group by 1, 2),
  gm as (select feature, count(*) na, avg(v) g, var_samp(v) gv from long group by 1)"""


ANOVA = f"""{moments_sql('vec', I.VECTOR_FEATURES)},
  an as (select feature, sum(n * (m - g) * (m - g)) b, sum((n - 1) * vr) w, count(*) k, sum(n) n from cm join gm using (feature) group by 1),
  anf as (select feature, (b / (k - 1)) / (w / (n - k)) f, (k - 1)::bigint df1, (n - k)::bigint df2 from an),
  anova as (select feature, round(f, 4) as f_score, df1, df2, round(100 * f / (select sum(f) from anf), 1) as impact from anf)"""


@query("sta11_anova", f"""with {I.VECTORS}, {ANOVA} select *, case when impact > 25 then 'Critical' when impact > 10 then 'High' else 'Standard' end as importance_level from anova""")
def _(t):
    return stats.anova(stats.cluster_moments(I.vectors(t), "cluster", I.VECTOR_FEATURES))


@query("sta12_p_values")
def _(t):
    """p-values of correlation, ANOVA and drift statistics."""
    a = stats.with_p(stats.feature_target(I.signals(t), I.SIGNAL_FEATURES, "y")).select(F.lit("pearson").alias("test"), F.col("feature_a").alias("feature"), "p_value")
    b = stats.anova_with_p(stats.cluster_moments(I.vectors(t), "cluster", I.VECTOR_FEATURES)).select(F.lit("anova").alias("test"), "feature", "p_value")
    c = drift.drift(I.orders_trend(t), I.TREND_FEATURES, ["o_orderdate", "o_orderkey"]).select(F.lit("ks").alias("test"), "feature", "p_value")
    return a.unionByName(b).unionByName(c)


SEPARATION = f"""{moments_sql('planted', I.PLANTED_FEATURES)},
  sp0 as (select feature, sum(n * (m - g) * (m - g)) / greatest(max(gv) * max(na), 1e-9) s from cm join gm using (feature) group by 1 having max(gv) > 0),
  separation as (select feature, round(s, 6) as importance, round(100 * s / (select sum(s) from sp0), 4) as impact_pct,
    row_number() over (order by round(s, 6) desc, feature)::bigint as rank from sp0)"""


@query("sta13_separation_share", f"""with {I.PLANTED}, {SEPARATION} select *, case when impact_pct >= 30 then 'Critical' when impact_pct >= 15 then 'High' when impact_pct >= 5 then 'Medium' else 'Low' end as importance_level from separation""")
def _(t):
    return stats.separation(stats.cluster_moments(I.planted(t), "cluster", I.PLANTED_FEATURES))


@query("sta14_cluster_delta", f"""with {I.VECTORS}, {ANOVA}, best as (select feature from anova order by f_score desc, feature limit 8),
  sz as (select cluster, count(*) as size from vec group by 1),
  z as (select cluster, feature, round((m - g) / sqrt(gv), 3) + 0.0 as z from cm join gm using (feature) semi join best using (feature))
  select cluster, size, feature, z, row_number() over (partition by cluster order by abs(z) desc, feature)::bigint as place,
  case when max(abs(z)) over (partition by cluster) > 2 then 'High' when max(abs(z)) over (partition by cluster) > 1 then 'Medium' else 'Low' end as severity,
  case when abs(z) > 1.5 then 'far ' else 'slightly ' end || case when z > 0 then 'above' else 'below' end as reading from z join sz using (cluster)""")
def _(t):
    return stats.cluster_delta(stats.cluster_moments(I.vectors(t), "cluster", I.VECTOR_FEATURES))


@query("sta15_cause_rules", f"""with {I.SIGNAL_IMPORTANCE}, {I.long_sql('sig', I.IMPORTANT)},
  st as (select feature, count(*) n, avg(v) av, stddev_samp(v) sd, skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1.0)) sk, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 from long group by 1),
  ot as (select feature, count(*) o from long join st using (feature) where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) group by 1),
  co as (select feature, case feature when 'q' then 2.0 when 'd' then -3.0 when 'p' then 0.0001 else 0.0 end * (v - av) cv0 from long join st using (feature)),
  cs as (select feature, 0.0 as mc, round(stddev_pop(cv0), 4) as sc, round(avg((cv0 > 0)::int) * 100, 1) pp from co group by 1),
  j as (select rank, feature, impact_pct, round(r, 3) + 0.0 as corr, coalesce(o, 0) > 0.05 * n as c1, abs(round(sk, 3)) > 1.5 as c2, abs(round(sd / av * 100, 1)) > 80 as c3,
    abs(round(r, 3)) > 0.75 as c5, abs(round(r, 3)) < 0.15 as c6, pp > 70 as c7, pp < 30 as c8 from importance join st using (feature) left join ot using (feature) join cs using (feature))
  select rank, feature, impact_pct, case when impact_pct >= 30 then 'Critical' when impact_pct >= 15 then 'High' when impact_pct >= 5 then 'Medium' else 'Low' end as importance_level, corr,
  coalesce(nullif(concat_ws(',', case when c1 then 'many_outliers' end, case when c2 then 'skewed' end, case when c3 then 'extreme_variability' end, case when c5 then 'linear_link' end,
    case when c6 then 'weak_linear' end, case when c7 then 'mostly_positive' end, case when c8 then 'mostly_negative' end), ''), 'stable') as causes,
  (2 * c1::int + c2::int + 2 * c3::int + c5::int + c6::int)::bigint as severity_score from j where rank <= 6""")
def _(t):
    from ..operators.profile import column_profile
    d = I.signals(t)
    contrib = stats.linear_contributions(d, {"q": 2.0, "d": -3.0, "x": 0.0, "q6": 0.0, "p": 0.0001})
    return stats.cause_rules(column_profile(d, I.IMPORTANT), I.signal_importance(t), stats.pearson(d, [(f, "y") for f in I.IMPORTANT]), contrib)


# --- windows and ranks -----------------------------------------------------------------------

@query("win01_cumulative_importance", f"""with {I.SIGNAL_IMPORTANCE} select rank, feature as label, round(sum(impact_pct) over (order by rank), 2) as value, 80.0::double as threshold,
  round(sum(impact_pct) over (order by rank), 4) >= 80 as reached from importance""")
def _(t):
    return charts.importance_series(I.signal_importance(t), "cumulative")


@query("win02_rank_numbers", f"""select row_number() over (order by n desc, o_orderpriority)::bigint as rank, o_orderpriority, n from (select o_orderpriority, count(*) n from orders where o_orderstatus <> 'P' group by 1)""")
def _(t):
    d = t.orders.where("o_orderstatus <> 'P'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return ranks.number_rows(d, [F.desc("n"), "o_orderpriority"])


@query("win03_first_and_last_rows", f"with {I.ORDERS_TREND}, {ENDS} select o_orderkey, side from ends where side is not null")
def _(t):
    return split_ends(I.orders_trend(t), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "side")


@query("win04_average_ranks", """select l_quantity as value, count(*) as cnt, min(r) + (count(*) - 1) / 2.0 as avg_rank from (select l_quantity, rank() over (order by l_quantity) r from lineitem) group by 1""")
def _(t):
    return ranks.average_ranks(t.lineitem, "l_quantity")


@query("win06_gap_to_leader", """select o_orderpriority, n, max(n) over () - n as gap from (select o_orderpriority, sum(o_totalprice) as s, round(avg(o_totalprice), 4) as n from orders group by 1)""")
def _(t):
    from pyspark.sql import Window as W
    d = t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("n"))
    return d.withColumn("gap", F.first("n").over(W.orderBy(F.desc("n"))) - F.col("n"))


@query("win07_chronological_split", f"""with {I.ORDERS_TREND}, {ENDS} select o_orderkey, case when rn <= floor(n * 0.8) then 'train' else 'test' end as part from ends""")
def _(t):
    return drift.chronological_split(I.orders_trend(t), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "part")


FOLD = "row_number() over (partition by o_orderpriority order by md5(o_orderkey || '|42'), o_orderkey) - 1"


@query("win08_stratified_folds", f"select o_orderkey, o_orderpriority, (({FOLD}) % 3)::bigint as fold from orders")
def _(t):
    return sampling.stratified_folds(t.orders, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "o_orderpriority", "fold")


@query("mod01_holdout_stratified", f"select o_orderkey, case when ({FOLD}) < ceil(count(*) over (partition by o_orderpriority) * 0.2) then 'test' else 'train' end as part from orders")
def _(t):
    return sampling.holdout(t.orders, ["o_orderkey"], "stratified", label="o_orderpriority").select("o_orderkey", "part")


@query("mod01_holdout_shuffle", "select o_orderkey, case when ('0x' || left(md5(o_orderkey || '|42'), 8))::bigint / 4294967296.0 < 0.2 then 'test' else 'train' end as part from orders")
def _(t):
    return sampling.holdout(t.orders, ["o_orderkey"]).select("o_orderkey", "part")


@query("mod01_holdout_group", "select doc_id, case when ('0x' || left(md5(text || '|42'), 8))::bigint / 4294967296.0 < 0.2 then 'test' else 'train' end as part from documents")
def _(t):
    return sampling.holdout(t.documents, ["doc_id"], "group", group="text").select("doc_id", "part")


@query("mod02_chronological_parts", """with e as (select event_type, row_number() over (order by ts, event_id) <= floor(count(*) over () * 0.8) as tr from events)
  select event_type, case when tr then 'train' else 'test' end as part, count(*) as n from e group by 1, 2""")
def _(t):
    d = drift.chronological_split(t.events, ["ts", "event_id"])
    return d.groupBy("event_type", "part").agg(F.count("*").alias("n"))


# --- histograms and concentration ------------------------------------------------------------

def hist_sql(value: str, table: str, bins: int) -> str:
    return f"""v as (select {value} v from {table}), mm as (select min(v) lo, max(v) hi, least({bins}, count(v)) k, (max(v) - min(v)) / least({bins}, count(v)) w from v),
  h as (select least(floor((v - lo) / w), k - 1)::bigint as bin, count(*) n from v, mm group by 1)
  select g.bin, round(lo + g.bin * w, 4) + 0.0 as lower, round(lo + (g.bin + 1) * w, 4) + 0.0 as upper, coalesce(n, 0) as n from (select unnest(range({bins}))::bigint as bin) g left join h using (bin), mm"""


@query("agg09_histogram", f"with {hist_sql('l_extendedprice', 'lineitem', 10)}")
def _(t):
    return charts.histogram(t.lineitem, "l_extendedprice", 10)


@query("agg09_histogram_with_gaps", f"with {I.CUSTOMER_OUTLIERS}, {hist_sql('c_acctbal', 'customer_outliers', 12)}")
def _(t):
    return charts.histogram(I.customer_outliers(t), "c_acctbal", 12)


CONC = """cumi as (select *, round(sum(impact_pct) over (order by rank), 4) c from importance),
  conc as (select count(*) as n_features, round(sum(case when rank <= 2 then impact_pct end), 2) as top2_pct, round(sum(case when rank <= 3 then impact_pct end), 2) as top3_pct,
   coalesce(min(case when c >= 80 then rank end), count(*)) as n_for_80, count(case when impact_pct < 1 then 1 end) as n_low, round(coalesce(sum(case when impact_pct < 1 then impact_pct end), 0), 2) as low_pct,
   count(case when direction = 'positive' and rank <= 8 then 1 end) as n_positive, count(case when direction = 'negative' and rank <= 8 then 1 end) as n_negative,
   max(case when rank = 1 then feature end) as top_feature, max(case when rank = 1 then impact_pct end) as top_pct from cumi)"""


@query("agg15_concentration", f"with {I.SIGNAL_IMPORTANCE}, {CONC} select * from conc")
def _(t):
    return insights.concentration(I.signal_importance(t))


@query("agg20_cluster_size_balance", f"""with {I.PLANTED}, s as (select case when id % 20 = 0 then 9 else cluster end as c, count(*) n from planted group by 1)
  select count(*) as n_clusters, max(n) as largest, min(n) as smallest, round(max(n) * 1.0 / min(n), 4) as imbalance_ratio, count(case when n * 100.0 / (select sum(n) from s) < 5 then 1 end) as small_clusters from s""")
def _(t):
    d = I.planted(t).withColumn("cluster", F.when(F.col("id") % 20 == 0, 9).otherwise(F.col("cluster")))
    return clusters.size_balance(clusters.cluster_sizes(d, "cluster"))


@query("srt03_top_by_absolute_value", f"with {I.SIGNALS}, {graded_sql(list(combinations(I.SIGNAL_FEATURES + ['y', 'w'], 2)), 'feature_feature')} select feature_a, feature_b, abs_r from graded order by abs_r desc, feature_a, feature_b limit 3")
def _(t):
    return stats.feature_pairs(I.signals(t), I.SIGNAL_FEATURES + ["y", "w"], top=3).select("feature_a", "feature_b", "abs_r")

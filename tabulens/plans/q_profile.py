"""Profiles, types, target and routing, cleaning, small sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.scalars import band, finite, sanitize, separation_level
from ..operators import clean, column_types as ct, encode, impute, profile as pf
from ..operators.quantiles import exact_quantiles
from . import inputs as I
from .registry import query

WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in L.MISSING_TOKENS)


def num_profile_sql(table: str, cols: list[str], ctes: str = "") -> str:
    """Numeric profile of each column, as SQL."""
    parts = []
    for c in cols:
        parts.append(f"""
select '{c}' as column_name, n as n_rows, n - cnt as null_count, round(100.0 * (n - cnt) / n, 1) as null_pct,
  nu as n_unique, round(mn, 4) as min, round(mx, 4) as max, round(av, 4) as mean, round(med, 4) as median,
  round(sd, 4) as std, round(sk * (cnt - 2) / sqrt(cnt * (cnt - 1.0)), 3) + 0.0 as skew, round(q1, 4) as q1, round(q3, 4) as q3, round(q3 - q1, 4) as iqr,
  (select count(*) from {table} where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count
from (select count(*) n, count({c}) cnt, count(distinct {c}) nu, min({c})::double mn, max({c})::double mx, avg({c}) av,
  quantile_cont({c}::double, 0.5) med, stddev_samp({c}) sd, skewness({c}) sk,
  quantile_cont({c}::double, 0.25) q1, quantile_cont({c}::double, 0.75) q3 from {table})""")
    return (f"with {ctes} " if ctes else "") + " union all ".join(parts)


def numeric_part(p):
    return p.where(F.col("mean").isNotNull()).select(
        "column_name", "n_rows", "null_count", F.round("null_pct", 1).alias("null_pct"), "n_unique",
        *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std")],
        F.round("skew_g1", 3).alias("skew"), *[F.round(c, 4).alias(c) for c in ("q1", "q3", "iqr")], "outlier_count")


@query("agg01_column_profile", num_profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def _(t):
    return numeric_part(pf.column_profile(t.orders))


@query("agg01_column_profile_dirty", num_profile_sql("customer_outliers", ["c_custkey", "c_nationkey", "c_acctbal"],
                                                     I.CUSTOMER_OUTLIERS))
def _(t):
    return numeric_part(pf.column_profile(I.customer_outliers(t)))


@query("agg01_text_profile", """
select c as column_name, count(*) as n_rows, count(v) as filled, count(distinct v) as n_unique,
  coalesce(bool_or(regexp_matches(v, '[\\x{0600}-\\x{06FF}]')), false) as has_arabic,
  round(avg(length(v)), 1) as avg_length, round(avg(len(regexp_extract_all(v, '\\S+'))), 1) as avg_words
from (select 'text' as c, text as v from documents union all select 'lang', lang from documents
      union all select 'source', source from documents) group by 1""")
def _(t):
    p = pf.column_profile(t.documents, ["text", "lang", "source"])
    return p.select("column_name", "n_rows", (F.col("n_rows") - F.col("null_count")).alias("filled"), "n_unique",
                    "has_arabic", F.round("avg_length", 1).alias("avg_length"), F.round("avg_words", 1).alias("avg_words"))


@query("agg02_readiness_check", f"""with {I.ORDERS_CLEAN}, m as (select count(*) n,
  {', '.join(f"1 - count({c}) * 1.0 / count(*) as m_{c}" for c in ['o_orderkey','o_custkey','price_txt','status','priority','o_orderdate','fixed','nothing','holes'])}
  from orders_clean), d as (select count(*) - (select count(*) from (select distinct * from orders_clean)) as dup from orders_clean)
select 'before' as label, 'WARNING' as status, n as n_rows, 9::bigint as n_cols, dup as n_duplicates,
  round(greatest(m_price_txt, m_status, m_nothing, m_holes), 4) as max_missing_ratio, 'nothing' as high_missing_cols,
  'nothing' as empty_cols, (2 + (n < 30)::int + (dup > n * 0.1)::int)::bigint as n_warnings from m, d""")
def _(t):
    return pf.readiness(clean.standardize_missing(I.orders_dirty(t)), "before")


@query("agg03_value_counts", """select o_orderpriority as value, count(*) as n from orders group by 1""")
def _(t):
    return pf.value_counts(t.orders, "o_orderpriority")


@query("agg03_top_values", """select * from (
  select 'o_custkey' as column_name, cast(o_custkey as varchar) as value, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 5)""")
def _(t):
    return (t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(5)
            .select(F.lit("o_custkey").alias("column_name"), F.col("o_custkey").cast("string").alias("value"), "n"))


ISSUES_SQL = f"""with {I.CUSTOMER_OUTLIERS}, d as (
  select c_custkey, c_acctbal, case when c_custkey % 4 = 0 then c_nationkey end as sparse,
    case when c_custkey % 3 = 0 then 1 end as half, 7 as fixed from customer_outliers),
l as (select 'c_custkey' as c, c_custkey::double v from d union all select 'c_acctbal', c_acctbal from d
  union all select 'sparse', sparse from d union all select 'half', half from d union all select 'fixed', fixed from d),
s as (select c, count(*) n, count(v) cnt, stddev_samp(v) sd, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 from l group by c),
k as (select c, skewness(v) sk from l where c not in ('half', 'fixed') group by c),
x as (select l.c, count(*) e from l join s using (c) where v < q1 - 3 * (q3 - q1) or v > q3 + 3 * (q3 - q1) group by l.c),
a as (select s.*, sk, coalesce(e, 0) e, round(100.0 * (n - cnt) / n, 2) miss from s left join k using (c) left join x using (c))
select c as column_name, 'high_missingness' as issue_type, case when miss > 50 then 'high' else 'medium' end as severity, miss as value,
  case when c = 'c_acctbal' then 'high' else 'low' end as impact from a where miss > 20
union all select c, 'zero_variance', 'medium', 0.0, 'low' from a where cnt >= 5 and sd = 0
union all select c, 'extreme_skewness', 'medium', round(sk, 2), case when c = 'c_acctbal' then 'high' else 'low' end from a where sd > 0 and abs(sk) > 3
union all select c, 'outlier_concentration', case when 100.0 * e / cnt > 10 then 'high' else 'medium' end, round(100.0 * e / cnt, 2),
  case when c = 'c_acctbal' then 'high' else 'low' end from a where sd > 0 and q3 > q1 and round(100.0 * e / cnt, 2) > 3"""


def issue_input(t):
    k = F.col("c_custkey")
    return I.customer_outliers(t).select(
        "c_custkey", "c_acctbal", F.when(k % 4 == 0, F.col("c_nationkey")).alias("sparse"),
        F.when(k % 3 == 0, 1).alias("half"), F.lit(7).alias("fixed"))


@query("agg04_quality_issues", ISSUES_SQL)
def _(t):
    important = t.spark.createDataFrame([("c_acctbal",)], "feature string")
    return pf.quality_issues(pf.column_profile(issue_input(t)), important).drop("ordinal")


@query("agg05_repeated_ids", """select 'l_orderkey' as column_name, count(*) as repeated_values,
  sum(c)::bigint as rows_involved from (select count(*) c from lineitem group by l_orderkey having count(*) > 1)""")
def _(t):
    return clean.repeated_ids(t.lineitem, "l_orderkey")


@query("agg06_duplicate_rows", f"""with {I.LINEITEM_DUPS} select (select count(*) from lineitem_dups) as n_rows,
  count(*) as n_distinct, (select count(*) from lineitem_dups) - count(*) as n_duplicates
  from (select distinct * from lineitem_dups)""")
def _(t):
    return pf.duplicate_rows(I.lineitem_dups(t))


@query("agg07_integrity_score", f"""with {I.ORDERS_CLEAN}, m as (select count(*) n,
  (9 * count(*) - count(o_orderkey) - count(o_custkey) - count(price_txt) - count(status) - count(priority) - count(o_orderdate)
   - count(fixed) - count(nothing) - count(holes))::bigint miss from orders_clean),
  d as (select (select count(*) from orders_clean) - count(*) dup from (select distinct * from orders_clean))
select n as n_rows, miss as n_missing, dup as n_duplicates, round(100.0 * miss / (n * 9), 1) as missing_pct,
  greatest(0, round(100 - round(100.0 * miss / (n * 9), 1) * 2 - (dup > 0)::int))::bigint as quality,
  case when greatest(0, round(100 - round(100.0 * miss / (n * 9), 1) * 2 - (dup > 0)::int)) >= 85 then 'high'
       when greatest(0, round(100 - round(100.0 * miss / (n * 9), 1) * 2 - (dup > 0)::int)) >= 60 then 'acceptable' else 'low' end as band
from m, d""")
def _(t):
    return pf.integrity_score(clean.standardize_missing(I.orders_dirty(t)))


TYPED_COLS = ["o_orderkey", "o_custkey", "price_txt", "status", "priority", "o_orderdate", "fixed", "nothing", "holes"]


def typed_orders(t):
    return ct.infer_types(pf.column_profile(clean.standardize_missing(I.orders_dirty(t))))


def types_sql(inner: str) -> str:
    """Type rules for orders_clean and documents columns written out in SQL."""
    parts = []
    for i, (c, kind) in enumerate(zip(TYPED_COLS, ["int", "int", "string", "string", "string", "timestamp", "string", "string", "float"])):
        s = f"cast({c} as varchar)"
        parts.append(f"""select {i}::bigint as ordinal, '{c}' as column_name, '{kind}' as kind, count(*) n, count({c}) cnt, count(distinct {c}) nu,
  avg(length({s})) al, count(try_cast(replace(trim({s}), ',', '') as double)) nn,
  count(case when try_cast(replace(trim({s}), ',', '') as double) % 1 = 0 then 1 end) ni,
  coalesce(bool_or(regexp_matches({s}, '[\\x{{0600}}-\\x{{06FF}}]')), false) ar from orders_clean""")
    return f"""with {I.ORDERS_CLEAN}, s as ({' union all '.join(parts)}),
typed as (select *, case when cnt = 0 then 'empty'
  when kind = 'timestamp' or regexp_matches('_' || column_name || '_', '_(date|time|datetime|timestamp|created|updated|modified|start|end|due)_') then 'datetime'
  when regexp_matches('_' || column_name || '_', '_(id|index|key|no|number|num|code|ref)_') or (cnt > 20 and nu >= 0.95 * cnt and kind in ('int','string')) then 'id'
  when kind in ('int','float') then case when nu <= 2 then 'bool' else kind end
  when nn >= 0.95 * cnt then case when ni = nn then 'int' else 'float' end
  when nu <= 2 then 'bool' when al > 30 and nu > 0.5 * cnt then 'text' when nu <= 50 or nu < 0.3 * cnt then 'categorical'
  when al > 15 then 'text' else 'categorical' end as col_type from s)
{inner}"""


@query("typ03_column_types", types_sql("select column_name, col_type, n - cnt as null_count, nu as n_unique from typed"))
def _(t):
    return typed_orders(t).select("column_name", "col_type", "null_count", "n_unique")


@query("typ01_datetime_columns", """select 'status_date' as column_name, true as by_name, false as by_value, true as is_datetime
union all select 'when_txt', false, true, true union all select 'o_orderkey', false, false, false
union all select 'o_orderpriority', false, false, false""")
def _(t):
    """Name rule, and value rule on text that holds dates."""
    d = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("status_date"),
                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("when_txt"))
    p = pf.column_profile(d)
    by_name = ct.name_has(F.col("column_name"), L.DATE_KEYWORDS)
    by_value = F.coalesce(F.col("date_share") >= 0.90, F.lit(False))
    return p.select("column_name", by_name.alias("by_name"), by_value.alias("by_value"), ct.is_datetime().alias("is_datetime"))


@query("typ02_identifier_columns", """with s as (
 select 'o_orderkey' as column_name, count(*) n, count(distinct o_orderkey) nu, 'int' as kind from orders
 union all select 'o_custkey', count(*), count(distinct o_custkey), 'int' from orders
 union all select 'o_totalprice', count(*), count(distinct o_totalprice), 'float' from orders
 union all select 'o_orderpriority', count(*), count(distinct o_orderpriority), 'string' from orders
 union all select 'ticket_no', count(*), count(distinct o_orderkey), 'int' from orders)
select column_name, column_name = 'ticket_no' or (n > 20 and nu >= 0.95 * n and kind in ('int','string')) as by_profile_rule,
 (regexp_matches(column_name, 'id|key|index|row|record|ticket|case|req|pr|po|email|phone|mobile') and nu >= 0.70 * n)
   or (nu >= 0.98 * n and kind <> 'float') as by_cluster_rule,
 regexp_matches(column_name, '^(id|ticket|key|code)$|_(id|ticket|key|code)$|^(id|ticket|key|code)_')
   or (n >= 20 and nu > 0.95 * n and (regexp_matches(column_name, 'id|number') or column_name = 'no')) as by_routing_rule from s""")
def _(t):
    d = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.col("o_orderkey").alias("ticket_no"))
    return pf.column_profile(d).select(
        "column_name", ct.is_identifier().alias("by_profile_rule"),
        ct.is_cluster_identifier().alias("by_cluster_rule"), ct.is_route_identifier().alias("by_routing_rule"))


@query("typ04_numeric_coercion", f"""with {I.ORDERS_DIRTY} select o_orderkey,
  try_cast(replace(trim(case when price_txt = 'N/A' then price_txt else concat(' ', price_txt[1:1], ',', price_txt[2:], ' ') end), ',', '') as double) as price
  from orders_dirty""")
def _(t):
    from ..functions.scalars import parse_number
    p = F.col("price_txt")
    messy = F.when(p == "N/A", p).otherwise(F.concat(F.lit(" "), F.substring(p, 1, 1), F.lit(","), F.expr("substring(price_txt, 2)"), F.lit(" ")))
    return I.orders_dirty(t).select("o_orderkey", parse_number(messy).alias("price"))


@query("typ05_free_text_columns", """with s as (select c as column_name, avg(length(v)) al, count(distinct v) * 1.0 / count(v) ur from (
  select 'text' as c, text v from documents union all select 'lang', lang from documents union all select 'source', source from documents) group by 1)
select column_name, al >= 35 and ur >= 0.30 as is_text, ur < 0.95 and al > 3 as is_text_by_prototype from s""")
def _(t):
    p = pf.column_profile(t.documents, ["text", "lang", "source"])
    return p.select("column_name", ct.is_free_text().alias("is_text"), ct.is_free_text(True).alias("is_text_by_prototype"))


SCORE = """case when regexp_matches(column_name, 'label|target|class|category|output|result|outcome|status|type|grade|risk') then 10 else 0 end
  + case col_type when 'categorical' then 5 when 'bool' then 4 when 'int' then 2 when 'float' then 2 else 0 end
  + case when (n - cnt) < 0.05 * n then 3 when (n - cnt) > 0.40 * n then -8 else 0 end
  + case when nu between 2 and 30 then 2 when nu > 100 then -2 else 0 end"""


@query("typ06_target_scores", types_sql(f"select column_name, col_type, ({SCORE})::bigint as score from typed where col_type not in ('id','datetime','empty')"))
def _(t):
    return ct.score_targets(typed_orders(t)).select("column_name", "col_type", "score")


@query("typ06_target_choice", types_sql(f"""select column_name as target, col_type, ({SCORE})::bigint as score, nu as n_unique,
  case when col_type in ('categorical','bool') or nu <= 30 then 'classification' when col_type in ('int','float') and nu > 10 then 'regression' else 'classification' end as task
  from typed where col_type not in ('id','datetime','empty') order by score desc, ordinal limit 1"""))
def _(t):
    return ct.pick_target(typed_orders(t))


@query("typ07_target_by_name", """select 'l_linestatus' as target, 'keyword' as matched_by
  where (select count(distinct l_linestatus) < 0.98 * count(*) from lineitem)""")
def _(t):
    return ct.target_by_name(pf.column_profile(t.lineitem))


@query("typ08_task_type", """select 'l_extendedprice' as target, count(l_extendedprice) as n, count(distinct l_extendedprice) as n_unique,
  case when count(distinct l_extendedprice) > greatest(20, floor(0.15 * count(*))) then 'regression' else 'classification' end as task from lineitem
union all select 'l_returnflag', count(l_returnflag), count(distinct l_returnflag), 'classification' from lineitem""")
def _(t):
    return ct.task_type(t.lineitem, "l_extendedprice").unionByName(ct.task_type(t.lineitem, "l_returnflag"))


@query("typ09_routing", """with s as (select avg(length(text)) al, count(distinct text) * 1.0 / count(text) ur from documents)
select 'classification' as task_type, 'lang' as target, 'n_chars' as numeric_columns, 'source' as categorical_columns, '' as datetime_columns,
  case when al >= 35 and ur >= 0.30 then 'text' else '' end as text_columns, 'doc_id' as identifier_columns,
  case when al >= 50 and ur >= 0.30 then 'text_heavy' else 'tabular' end as modality from s""")
def _(t):
    return ct.routing(ct.column_roles(pf.column_profile(t.documents), "lang"), "classification")


@query("typ09_routing_declared", """select 'regression' as task_type, 'l_extendedprice' as target,
  'l_discount,l_linenumber,l_partkey,l_quantity,l_suppkey,l_tax' as numeric_columns, 'l_linestatus,l_returnflag' as categorical_columns,
  'l_shipdate' as datetime_columns, '' as text_columns, 'l_orderkey' as identifier_columns, 'tabular' as modality
  from (select count(*) c from lineitem) where c > 0""")
def _(t):
    roles = ct.column_roles(pf.column_profile(t.lineitem), "l_extendedprice",
                            {"l_returnflag": "categorical", "l_shipdate": "datetime"}, ["l_orderkey"])
    return ct.routing(roles, "regression")


@query("typ12_modality", """with s as (select bool_or(regexp_matches(text, '[\\x{0600}-\\x{06FF}]')) ar from documents)
select 'text_heavy' as modality, case when ar then 'arabic' else 'english' end as dominant_language,
  ar::int::bigint as arabic_columns, 1::bigint as text_columns from s""")
def _(t):
    return ct.modality(ct.infer_types(pf.column_profile(t.documents.drop("doc_id"))))


@query("typ13_recommendations", types_sql("""select column_name, col_type,
  case when col_type in ('int','float') then case when column_name = 'x' then 'median' else 'mean' end end as fill_strategy,
  case when col_type in ('categorical','bool') then case when nu <= 2 then 'binary' when nu <= 10 then 'onehot' when nu <= 50 then 'label' else 'frequency' end end as encoding_strategy
  from typed"""))
def _(t):
    return ct.recommendations(typed_orders(t))


# --- projections and filters ---------------------------------------------------------------

@query("prj01_preview", """select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority from orders order by orders.o_orderkey limit 8""")
def _(t):
    return clean.preview(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


@query("prj02_missing_tokens", f"""with {I.ORDERS_DIRTY} select o_orderkey,
  case when lower(trim(price_txt)) in ({WORDS}) then null else price_txt end as price_txt, status from orders_dirty""")
def _(t):
    return clean.standardize_missing(I.orders_dirty(t).select("o_orderkey", "price_txt", "status"))


@query("prj02_missing_token_counts", f"""with {I.ORDERS_DIRTY} select 'price_txt' as column_name,
  count(case when lower(trim(price_txt)) in ({WORDS}) then 1 end) as cells from orders_dirty
  union all select 'status', count(case when lower(trim(status)) in ({WORDS}) then 1 end) from orders_dirty
  union all select 'priority', count(case when lower(trim(priority)) in ({WORDS}) then 1 end) from orders_dirty""")
def _(t):
    return clean.missing_token_counts(I.orders_dirty(t).select("price_txt", "status", "priority"))


@query("prj03_exclude_columns", f"""with {I.ORDERS_CLEAN} select o_custkey, price_txt, status, priority, o_orderdate, fixed, holes from orders_clean""")
def _(t):
    d = clean.standardize_missing(I.orders_dirty(t))
    drop = [r[0] for r in ct.infer_types(pf.column_profile(d)).where("col_type in ('id', 'empty')").select("column_name").collect()]
    return d.drop(*drop)


@query("prj04_low_quality_columns", f"""with {I.ORDERS_CLEAN},
 s as (select 'priority' as c, count(priority) cnt from orders_clean)
 select 'fixed' as column_name, 'drop' as action, 'constant' as reason from s where cnt > 0
 union all select 'nothing', 'drop', 'all_empty' from s
 union all select 'holes', 'flag', 'high_uniqueness' from (select count(distinct holes) nu, count(holes) c from orders_clean) where nu > 0.95 * c
 union all select 'price_txt', 'flag', 'high_uniqueness' from (select count(distinct price_txt) nu, count(price_txt) c from orders_clean)
   where nu > 0.95 * c and nu < 0.95 * c
 union all select 'mostly', 'flag', 'near_constant' from s""")
def _(t):
    d = clean.standardize_missing(I.orders_dirty(t)).withColumn("mostly", F.when(F.col("o_orderkey") % 200 == 0, "b").otherwise("a"))
    typed = ct.infer_types(pf.column_profile(d))
    return clean.low_quality(d, typed, "status")


@query("prj05_sparse_columns", f"""with {I.ORDERS_CLEAN} select 'nothing' as column_name from orders_clean having count(nothing) < 0.4 * count(*)
  union all select 'holes' from orders_clean having count(holes) < 0.4 * count(*)""")
def _(t):
    return clean.sparse_columns(pf.column_profile(clean.standardize_missing(I.orders_dirty(t))), "status")


@query("prj06_drop_missing_target", f"""with {I.ORDERS_DIRTY} select o_orderkey, status from orders_dirty where status is not null""")
def _(t):
    return clean.drop_missing_target(I.orders_dirty(t), "status").select("o_orderkey", "status")


@query("prj07_drop_duplicates", f"""with {I.LINEITEM_DUPS} select distinct l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag from lineitem_dups""")
def _(t):
    return I.lineitem_dups(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").dropDuplicates()


@query("prj08_drop_blank", """select conv_id, turn, role from conversations where trim(text) <> '' and trim(role) <> ''""")
def _(t):
    return clean.drop_blank(t.conversations, ["text", "role"]).select("conv_id", "turn", "role")


@query("prj09_drop_rare_classes", """with c as (select p_name, p_brand, p_partkey from part),
  k as (select p_name from c group by 1 having count(*) >= 3) select p_partkey, p_name from c semi join k using (p_name)""")
def _(t):
    return clean.keep_common_classes(t.part, "p_name").select("p_partkey", "p_name")


@query("prj09_drop_rare_text_classes", """with k as (select source from documents group by 1 having count(distinct text) >= 3)
  select doc_id, source from documents semi join k using (source)""")
def _(t):
    return clean.keep_common_classes(t.documents, "source", "text").select("doc_id", "source")


@query("prj10_finite_or_zero", """select event_id, case when event_id % 5 = 0 or event_id % 7 = 0 then 0 else value end as value from events""")
def _(t):
    k = F.col("event_id")
    bad = t.events.select("event_id", F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).otherwise(F.col("value")).alias("value"))
    return clean.finite_or_zero(bad, ["value"])


@query("prj11_search", """select p_partkey, p_name, p_brand from part where contains(lower(p_name), 'small') or contains(lower(p_brand), 'small') or contains(lower(p_type), 'small')""")
def _(t):
    return clean.search(t.part, "Small", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query("prj13_exclude_noise", f"""with {I.PLANTED} select id, f1 from planted where case when far then -1 else cluster end >= 0""")
def _(t):
    d = I.planted(t).withColumn("label", F.when(F.col("far"), -1).otherwise(F.col("cluster")))
    return d.where("label >= 0").select("id", "f1")


@query("prj14_row_limit", """select event_id, value from events order by value desc, event_id limit 25""")
def _(t):
    return clean.first_rows(t.events, [F.desc("value"), "event_id"], 25).select("event_id", "value")


# --- more aggregates -----------------------------------------------------------------------

@query("agg08_missing_summary", f"""with {I.ORDERS_CLEAN} select count(*) as original_rows, 9::bigint as original_cols,
  count(status) as cleaned_rows, count(*) - count(status) as rows_removed,
  (select (bool_or(price_txt is null)::int + bool_or(status is null)::int + bool_or(nothing is null)::int + bool_or(holes is null)::int)::bigint from orders_clean) as n_missing_cols,
  false as is_incident_like from orders_clean""")
def _(t):
    d = clean.standardize_missing(I.orders_dirty(t))
    some = sum((F.bool_or(F.col(c).isNull()).cast("long") for c in d.columns), F.lit(0))
    return d.agg(F.count("*").alias("original_rows"), F.lit(len(d.columns)).cast("long").alias("original_cols"),
                 F.count("status").alias("cleaned_rows"), F.count_if(F.col("status").isNull()).alias("rows_removed"),
                 some.alias("n_missing_cols"), F.lit(ct.is_incident_like([c for c in d.columns if c not in ("price_txt", "priority")])).alias("is_incident_like"))


@query("agg10_population_shape", f"""with {I.CUSTOMER_OUTLIERS}, l as (select 'c_acctbal' as feature, c_acctbal v from customer_outliers
  union all select 'c_nationkey', c_nationkey from customer_outliers union all select 'c_custkey', c_custkey from customer_outliers),
 s as (select feature, count(v) n, skewness(v) sk, kurtosis_pop(v) ku, stddev_samp(v) / greatest(abs(avg(v)), 1e-9) cv from l group by 1)
 select feature, round(sk, 3) as skew, round(ku, 3) as kurtosis, round(cv, 3) as cv, abs(sk) > 1.5 as skewed, ku > 3 as heavy_tail,
  cv > 0.6 and abs(sk) < 0.5 and n >= 40 as bimodal_hint, cv > 1 as high_variance from s""")
def _(t):
    from ..operators.insights import population_shape
    return population_shape(I.customer_outliers(t), ["c_acctbal", "c_nationkey", "c_custkey"])


@query("agg11_feature_profile", """with l as (""" + " union all ".join(
    f"select '{c}' as feature, {c}::double v from lineitem" for c in I.LINE_FEATURES) + """),
 s as (select feature, count(v) n, avg(v) av, stddev_samp(v) sd, min(v) mn, max(v) mx, skewness(v) sk, kurtosis_pop(v) ku,
   quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 from l group by 1),
 o as (select feature, count(*) c from l join s using (feature) where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) group by 1)
 select feature, round(av, 4) as mean, round(sd, 4) as std, round(mn, 4) as min, round(mx, 4) as max,
  round(sk * (n - 2) / sqrt(n * (n - 1.0)), 3) as skew, round(ku, 3) as kurtosis, coalesce(c, 0) as outliers,
  round(sd / av * 100, 1) as cv from s left join o using (feature)""")
def _(t):
    p = pf.column_profile(t.lineitem, I.LINE_FEATURES)
    return p.select(F.col("column_name").alias("feature"), *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")],
                    F.round("skew_g1", 3).alias("skew"), F.round("kurtosis", 3).alias("kurtosis"),
                    F.col("outlier_count").alias("outliers"), F.round(F.try_divide("std", "mean") * 100, 1).alias("cv"))


@query("agg12_target_summary", """select 'l_returnflag' as target, count(*) as n_classes, round(min(c) * 100.0 / sum(c), 2) as minority_share_pct,
  null::double as mean, null::double as std, null::double as min, null::double as max, null::double as skew from (select count(*) c from lineitem group by l_returnflag)
 union all select 'l_extendedprice', null, null, round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4),
  min(l_extendedprice), max(l_extendedprice), round(skewness(l_extendedprice), 6) from lineitem""")
def _(t):
    from ..operators.insights import target_summary
    d = t.lineitem
    return target_summary(d, "l_returnflag", "classification").unionByName(target_summary(d, "l_extendedprice", "regression"))


@query("agg13_class_distribution", """select o_orderpriority as label, count(*) as n from orders group by 1 order by 1""")
def _(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n")).orderBy("label")


@query("agg14_target_volatility", """select round(stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100, 1) as cv,
  round(stddev_samp(l_extendedprice), 3) as std, round(skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 2) as skew,
  case when round(stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100, 1) > 60 then 'high'
       when round(stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100, 1) > 30 then 'moderate' else 'stable' end as band from lineitem""")
def _(t):
    c = "l_extendedprice"
    one = t.lineitem.agg(F.round(F.stddev_samp(c) / F.avg(c) * 100, 1).alias("cv"), F.round(F.stddev_samp(c), 3).alias("std"),
                         F.round(F.skewness(c), 2).alias("skew"))
    return one.withColumn("band", band(F.col("cv"), [(60, "high"), (30, "moderate")], "stable", strict=True))


@query("agg16_counts_by_severity", f"""{ISSUES_SQL.replace("select c as column_name, 'high_missingness'", "select severity, count(*) as n from (select c as column_name, 'high_missingness'", 1)}) group by 1""")
def _(t):
    from ..operators.findings import counts_by
    important = t.spark.createDataFrame([("c_acctbal",)], "feature string")
    return counts_by(pf.quality_issues(pf.column_profile(issue_input(t)), important), "severity")


@query("agg19_column_language", """with c as (select case when ar + la = 0 then 'unknown' when ar * 1.0 / (ar + la) >= 0.60 then 'arabic'
   when ar * 1.0 / (ar + la) <= 0.15 then 'english' else 'mixed' end as lang_found from (
   select len(regexp_extract_all(v, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]+')) ar, len(regexp_extract_all(v, '[a-zA-Z]')) la
   from (select case when doc_id % 4 = 0 then 'شكوى من الخدمة' when doc_id % 4 = 1 then 'خدمة ok' else text end as v from documents)))
 select 'text' as column_name, count(*) as cells, round(avg((lang_found = 'arabic')::int), 4) as arabic_share,
  round(avg((lang_found = 'english')::int), 4) as english_share,
  case when avg((lang_found = 'arabic')::int) >= 0.15 and avg((lang_found = 'english')::int) >= 0.15 then 'mixed' else 'x' end as language from c""")
def _(t):
    from ..operators.textstats import column_language
    k = F.col("doc_id")
    d = t.documents.select(F.when(k % 4 == 0, "شكوى من الخدمة").when(k % 4 == 1, "خدمة ok").otherwise(F.col("text")).alias("text"))
    return column_language(d, "text")


# --- sorting and sets ----------------------------------------------------------------------

@query("srt02_mixed_sort", """select row_number() over (order by try_cast(v as double) asc nulls last, lower(v), k)::bigint as place, k, v from (
  select c_custkey as k, case when c_custkey % 2 = 0 then cast(c_custkey * 37 % 1000 as varchar) else c_name end as v from customer)""")
def _(t):
    k = F.col("c_custkey")
    d = t.customer.select(k.alias("k"), F.when(k % 2 == 0, (k * 37 % 1000).cast("string")).otherwise(F.col("c_name")).alias("v"))
    from ..operators.ranks import ordered_places
    return ordered_places(d, [*clean.mixed_order("v"), F.col("k")])


@query("srt04_largest_errors", f"""with {I.PRED_REG} select l_orderkey, l_linenumber, round(abs(actual - predicted), 4) as absolute_error from pred_reg
  order by abs(actual - predicted) desc, l_orderkey, l_linenumber limit 10""")
def _(t):
    from ..operators.evaluate import largest_errors
    return largest_errors(I.pred_reg(t), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "absolute_error")


@query("set03_feature_sets", """with a as (select p_brand from part where p_size > 25), b as (select p_brand from part where p_retailprice < 1200)
  select 'both' as part, p_brand from (select distinct p_brand from a intersect select p_brand from b)
  union all select 'only_first', p_brand from (select p_brand from a except select p_brand from b)""")
def _(t):
    a = t.part.where("p_size > 25").select("p_brand")
    b = t.part.where("p_retailprice < 1200").select("p_brand")
    return (a.intersect(b).select(F.lit("both").alias("part"), "p_brand")
            .unionByName(a.subtract(b).select(F.lit("only_first").alias("part"), "p_brand")))


@query("set05_pivot_wide", """select o_custkey, max(case when o_orderstatus = 'F' then p end) as "F", max(case when o_orderstatus = 'O' then p end) as "O",
  max(case when o_orderstatus = 'X' then p end) as "X" from (select o_custkey, o_orderstatus, min(o_orderpriority) as p from orders group by 1, 2) group by 1""")
def _(t):
    from ..operators.extract import long_to_wide
    one = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderpriority").alias("p"))
    return long_to_wide(one, ["o_custkey"], "o_orderstatus", "p", ["F", "O", "X"])

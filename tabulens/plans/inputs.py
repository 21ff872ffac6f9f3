"""Inputs derived from the given tables, once for Spark and once as SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

ORDERS_DIRTY = """
orders_dirty as (select o_orderkey, o_custkey,
  case o_orderkey % 11 when 0 then 'N/A' when 1 then '?' when 2 then 'بدون' when 3 then ' missing '
    else cast(cast(round(o_totalprice / 100) as bigint) as varchar) end as price_txt,
  case when o_orderkey % 13 = 0 then null else o_orderstatus end as status,
  o_orderpriority as priority, o_orderdate,
  'same' as fixed, cast(null as varchar) as nothing,
  case when o_orderkey % 3 = 0 then null else o_totalprice end as holes
  from orders)"""


def orders_dirty(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.when(k % 11 == 0, "N/A").when(k % 11 == 1, "?").when(k % 11 == 2, "بدون").when(k % 11 == 3, " missing ")
    return t.spread("orders", "o_orderkey").select(
        "o_orderkey", "o_custkey",
        words.otherwise(F.round(F.col("o_totalprice") / 100).cast("long").cast("string")).alias("price_txt"),
        F.when(k % 13 != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"), "o_orderdate",
        F.lit("same").alias("fixed"), F.lit(None).cast("string").alias("nothing"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("holes"))


ORDERS_CLEAN = ORDERS_DIRTY + """,
orders_clean as (select o_orderkey, o_custkey,
  case when lower(trim(price_txt)) in ('n/a','?','بدون','missing') then null else price_txt end as price_txt,
  status, priority, o_orderdate, fixed, nothing, holes from orders_dirty)"""


CUSTOMER_OUTLIERS = """
customer_outliers as (select c_custkey, c_name, c_nationkey, c_mktsegment,
  case when c_custkey % 97 = 0 then c_acctbal * 50 else c_acctbal end as c_acctbal from customer)"""


def customer_outliers(t: Tables) -> DataFrame:
    return t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 97 == 0, F.col("c_acctbal") * 50)
                                 .otherwise(F.col("c_acctbal")))


LINEITEM_DUPS = """
lineitem_dups as (select l.* from lineitem l, generate_series(1, 2) g(i)
  where g.i = 1 or l.l_orderkey % 50 = 0)"""


def lineitem_dups(t: Tables) -> DataFrame:
    copies = F.when(F.col("l_orderkey") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.lineitem.withColumn("_i", F.explode(copies)).drop("_i")


PRED_CLS = """
pred_cls as (select o_orderkey, o_orderpriority as actual,
  case when o_orderkey % 7 = 0 then '1-URGENT' when o_orderkey % 11 = 0 then '5-LOW'
       when o_orderkey % 5 < 2 and o_orderstatus = 'F' then '3-MEDIUM' else o_orderpriority end as predicted
  from orders)"""


def pred_cls(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("actual"),
                           F.when(k % 7 == 0, "1-URGENT").when(k % 11 == 0, "5-LOW")
                           .when((k % 5 < 2) & (F.col("o_orderstatus") == "F"), "3-MEDIUM")
                           .otherwise(F.col("o_orderpriority")).alias("predicted"))


PRED_REG = """
pred_reg as (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
  l_extendedprice as actual, 1500.0 * l_quantity as predicted from lineitem)"""


def pred_reg(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                             F.col("l_extendedprice").alias("actual"),
                             (F.lit(1500.0) * F.col("l_quantity")).alias("predicted"))


# three separated groups by key plus one percent far points
PLANTED = """
planted as (select c_custkey as id, cast(c_custkey % 3 as bigint) as cluster,
  10.0 * (c_custkey % 3) + c_acctbal / 10000.0 + case when c_custkey % 101 = 0 then 60 else 0 end as f1,
  case c_custkey % 3 when 0 then 5.0 when 1 then -5.0 else 0.0 end + c_nationkey / 25.0
    - case when c_custkey % 101 = 0 then 40 else 0 end as f2,
  c_acctbal / 1000.0 as f3, c_nationkey * 1.0 as f4,
  c_custkey % 101 = 0 as far from customer)"""


def planted(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    far = k % 101 == 0
    return t.customer.select(
        k.alias("id"), (k % 3).cast("long").alias("cluster"),
        (10.0 * (k % 3) + F.col("c_acctbal") / 10000.0 + F.when(far, 60).otherwise(0)).alias("f1"),
        (F.when(k % 3 == 0, 5.0).when(k % 3 == 1, -5.0).otherwise(0.0) + F.col("c_nationkey") / 25.0
         - F.when(far, 40).otherwise(0)).alias("f2"),
        (F.col("c_acctbal") / 1000.0).alias("f3"), (F.col("c_nationkey") * 1.0).alias("f4"), far.alias("far"))


# feature importance as the share of absolute correlation with the line price
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey"]
LINE_TARGET = "l_extendedprice"

IMPORTANCE = "importance0 as (" + " union all ".join(
    f"select '{c}' as feature, corr({c}, {LINE_TARGET}) as r from lineitem" for c in LINE_FEATURES) + """),
importance as (select feature, round(abs(r), 6) as importance,
  round(100 * abs(r) / (select sum(abs(r)) from importance0), 2) as impact_pct,
  case when r > 0 then 'positive' when r < 0 then 'negative' else 'unknown' end as direction,
  row_number() over (order by round(100 * abs(r) / (select sum(abs(r)) from importance0), 2) desc, feature) as rnk
  from importance0)"""


# line items with a linear, a monotone non-linear and an interaction signal
SIGNALS = """
sig as (select l_orderkey, l_linenumber, l_quantity as q, l_discount * 100 as d, l_tax * 100 as x,
  power(l_quantity, 6) / 1000000.0 as q6, l_extendedprice as p,
  2.0 * l_quantity + l_extendedprice / 10000.0 - l_discount * 300 as y, (l_quantity - 25) * (l_tax * 100 - 4) + l_extendedprice / 5000.0 as w,
  case when l_orderkey % 9 = 0 then null else l_quantity end as q_holes from lineitem)"""
SIGNAL_FEATURES = ["q", "d", "x", "q6", "p", "q_holes"]


def signals(t: Tables) -> DataFrame:
    q, d, x, p = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice")
    return t.spread("lineitem", "l_orderkey").select(
        "l_orderkey", "l_linenumber", q.alias("q"), d.alias("d"), x.alias("x"), (F.pow(q, F.lit(6)) / 1000000.0).alias("q6"),
        p.alias("p"), (2.0 * q + p / 10000.0 - F.col("l_discount") * 300).alias("y"), ((q - 25) * (x - 4) + p / 5000.0).alias("w"),
        F.when(F.col("l_orderkey") % 9 != 0, q).alias("q_holes"))


# share of absolute correlation with y as importance of the signal features
SIGNAL_IMPORTANCE = SIGNALS + """,
imp0 as (""" + " union all ".join(f"select '{c}' as feature, corr({c}, y) as r from sig" for c in ["q", "d", "x", "q6", "p"]) + """),
importance as (select feature, round(abs(r), 6) as importance, round(100 * abs(r) / (select sum(abs(r)) from imp0), 2) as impact_pct,
  case when r > 0 then 'positive' when r < 0 then 'negative' else 'unknown' end as direction, r,
  row_number() over (order by round(100 * abs(r) / (select sum(abs(r)) from imp0), 2) desc, feature)::bigint as rank from imp0)"""
IMPORTANT = ["q", "d", "x", "q6", "p"]


def signal_importance(t: Tables) -> DataFrame:
    from ..operators.stats import correlation_importance

    return correlation_importance(signals(t), IMPORTANT, "y")


# orders whose price grows, and a second value that falls, over time
ORDERS_TREND = """
trend as (select o_orderkey, o_orderdate, o_totalprice as flat, o_totalprice + 200.0 * date_diff('day', timestamp '1992-01-01', o_orderdate) as grow,
  o_totalprice / 10.0 - 30.0 * date_diff('day', timestamp '1992-01-01', o_orderdate) as fall from orders)"""
TREND_FEATURES = ["flat", "grow", "fall"]


def orders_trend(t: Tables) -> DataFrame:
    days = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return t.spread("orders", "o_orderkey").select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("flat"),
                           (F.col("o_totalprice") + 200.0 * days).alias("grow"), (F.col("o_totalprice") / 10.0 - 30.0 * days).alias("fall"))


# embeddings as sixteen summed dimensions with their given label as cluster
VECTORS = "vec as (select vec_id, label::bigint as cluster, " + ", ".join(
    f"(embedding[{4 * i + 1}]::double + embedding[{4 * i + 2}]::double + embedding[{4 * i + 3}]::double + embedding[{4 * i + 4}]::double) as v{i}"
    for i in range(16)) + " from embeddings)"
VECTOR_FEATURES = [f"v{i}" for i in range(16)]


def vectors(t: Tables) -> DataFrame:
    e = lambda j: F.col("embedding")[j].cast("double")
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("cluster"),
                               *[(e(4 * i) + e(4 * i + 1) + e(4 * i + 2) + e(4 * i + 3)).alias(f"v{i}") for i in range(16)])


PLANTED_FEATURES = ["f1", "f2", "f3", "f4"]


def long_sql(table: str, features: list[str], keep: str = "", name: str = "long") -> str:
    """Unpivot of features as SQL: (keep, feature, v)."""
    return f"{name} as (" + " union all ".join(f"select {keep} '{c}' as feature, {c}::double as v from {table}" for c in features) + ")"

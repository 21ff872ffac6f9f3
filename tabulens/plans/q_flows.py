"""Sinks, history, streaming and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import flows
from ..operators import impute
from ..session import shared_folder
from ..sinks import history, tables as sk
from ..streaming import windows as win
from . import inputs as I
from .q_features import holes
from .q_models import PRICE, price_table, scaled_planted
from .registry import query


def place(t, name: str) -> str:
    """Fresh folder under the shared checkpoint folder."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


NEAR = """(select a.c_custkey, round(avg(v), 4) as v from (select a.c_custkey, d.{want} as v, row_number() over (partition by a.c_custkey order by (d.{by} - a.{by}) ** 2, d.{want}) as r
  from b a join b d on a.{want} is null and a.{by} is not null and d.{want} is not null and d.{by} is not null) a where r <= 5 group by 1)"""


@query("fea03_nearest_neighbour_fill", f"""with b as (select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end as x, case when c_custkey % 5 <> 0 then cast(c_nationkey as double) end as y from customer),
  fx as {NEAR.format(want='x', by='y')}, fy as {NEAR.format(want='y', by='x')}
  select b.c_custkey, round(coalesce(x, fx.v, (select avg(x) from b)), 4) as c_acctbal, round(coalesce(y, fy.v, (select avg(y) from b)), 4) as nation from b left join fx using (c_custkey) left join fy using (c_custkey)""")
def _(t):
    k = F.col("c_custkey")
    d = t.customer.select("c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 5 != 0, F.col("c_nationkey").cast("double")).alias("nation"))
    return impute.knn_fill(d, ["c_acctbal", "nation"], ["c_custkey"]).withColumns({c: F.round(c, 4) for c in ("c_acctbal", "nation")})


@query("snk01_cleaned_tables", """select 'csv' as fmt, count(*) as rows, round(sum(o_totalprice), 2) as total from orders union all select 'parquet', count(*), round(sum(o_totalprice), 2) from orders""")
def _(t):
    out = place(t, "cleaned")
    d = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    sk.write_table(d, f"{out}/csv", "csv")
    sk.write_table(d, f"{out}/parquet")
    back = {"csv": t.spark.read.option("header", True).schema("o_orderkey long, o_totalprice double, o_orderdate string").csv(f"{out}/csv"), "parquet": t.spark.read.parquet(f"{out}/parquet")}
    one = lambda k: back[k].agg(F.lit(k).alias("fmt"), F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return one("csv").unionByName(one("parquet"))


@query("snk02_result_sections", """select 'second' as run_id, o_orderpriority, count(*) as n from orders group by 2 union all select 'first', o_orderpriority, count(*) from orders where o_orderstatus = 'F' group by 2""")
def _(t):
    out = place(t, "sections")
    counts = lambda d: d.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    sk.write_sections({"classes": counts(t.orders.where("o_orderstatus = 'F'"))}, out, "first")
    sk.write_sections({"classes": counts(t.orders)}, out, "second")
    return t.spark.read.parquet(f"{out}/classes").select("run_id", "o_orderpriority", "n")


@query("snk03_assignments", f"with {I.PLANTED} select id, cluster as cluster_label from planted")
def _(t):
    out = place(t, "assignments")
    sk.write_assignments(I.planted(t), ["id"], "cluster", out)
    return t.spark.read.parquet(out)


@query("snk05_model_round_trip", "select count(*) as n_rows, 0::bigint as differing from part")
def _(t):
    """A saved and reloaded model scores every row like the original."""
    from ..operators import models
    d = price_table(t)
    p = models.prepare(d, PRICE)
    model, _pred, _metrics = models.final_fit(p, "Ridge")
    out = place(t, "model")
    models.save(out, p.features, model)
    feats, again = models.load(out)
    a = models.score_new(p.features, model, [], d, ["p_partkey"])
    b = models.score_new(feats, again, [], d, ["p_partkey"]).withColumnRenamed("prediction", "reloaded")
    return a.join(b, "p_partkey").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("prediction").eqNullSafe(F.col("reloaded"))).alias("differing"))


HIST = "hist as (select event_id as id, ts as timestamp, user_id, value from events), kept as (select * from hist where id not in (select event_id from events where event_type = 'error') order by timestamp desc, id limit 50)"


@query("snk07_run_history", f"with {HIST} select id, user_id, value from kept")
def _(t):
    d = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id", "value")
    gone = t.events.where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return history.newest(history.without_runs(d, gone)).select("id", "user_id", "value")


@query("snk04_audit_log", f"""with {I.ORDERS_CLEAN}, c as (select o_custkey, price_txt, status, priority, o_orderdate, holes from orders_clean), u as (select distinct * from c)
  select 'missing_tokens' as step, (select count(*) from orders_dirty where o_orderkey % 11 < 4)::double as value
  union all select 'input', count(*)::double from orders_clean union all select 'duplicates', (select count(*) from c)::double - count(*) from u
  union all select 'target_missing', count(*)::double from u where status is null""")
def _(t):
    r = flows.preprocess(I.orders_dirty(t), target="status")
    return r.audit.where("step in ('missing_tokens', 'input', 'duplicates', 'target_missing')").select("step", "value")


@query("run_preprocess")
def _(t):
    return flows.preprocess(I.orders_dirty(t), target="status").model_ready


@query("run_supervised")
def _(t):
    r = flows.supervised(price_table(t), PRICE)
    return r.leaderboard.drop("reason")


@query("run_unsupervised")
def _(t):
    return flows.unsupervised(t.customer, "c_custkey").profiles


@query("run_root_cause")
def _(t):
    d = I.orders_trend(t)
    from ..operators.stats import correlation_importance
    return flows.root_cause(d, "grow", correlation_importance(d, ["flat", "fall"], "grow"), ["o_orderdate", "o_orderkey"])


WINDOWS = """select date_trunc('hour', ts) as window_start, event_type, count(*) as n, 0.0::double as null_share, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std from events group by 1, 2"""


@query("strx1_window_profile", WINDOWS)
def _(t):
    d = win.windowed_profile(t.events, "ts", "event_type", "value")
    return d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("strx1_streamed_profile", f"with w as ({WINDOWS}), m as (select max(ts) - interval 10 minutes as mark from events) select w.* from w, m where window_start + interval 1 hour <= mark")
def _(t):
    """The same profile computed as a stream: windows that the watermark has closed."""
    out = place(t, "stream")
    stream = win.windowed_profile(win.event_stream(t.spark, t._folder, "events"), "ts", "event_type", "value")
    win.run_to_parquet(stream, f"{out}/data", f"{out}/checkpoint")
    d = t.spark.read.parquet(f"{out}/data")
    return d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

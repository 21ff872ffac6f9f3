"""File scans as round trips of the given tables, guards, and drift on streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import files, workbook
from ..streaming import drift, windows as win
from .q_flows import place
from .registry import query


@query("src01_csv_encodings", """select c_custkey, case when c_custkey % 3 = 0 then 'شكوى ' || c_name else c_name end as label, c_acctbal from customer""")
def _(t):
    """A folder with files in two encodings read back, each file by its own."""
    d = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("شكوى "), F.col("c_name"))).otherwise(F.col("c_name")).alias("label"), "c_acctbal")
    out = place(t, "csv")
    d.where("c_custkey % 2 = 0").write.option("header", True).csv(f"{out}/a")
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        d.where("c_custkey % 2 = 1").write.option("header", True).option("encoding", "windows-1256").csv(f"{out}/b")
    finally:
        t.spark.conf.unset("spark.sql.legacy.javaCharsets")
    return files.read_mixed_csv(t.spark, [f"{out}/a", f"{out}/b"])


@query("src02_workbooks", """select c_custkey, c_name, c_acctbal, c_nationkey > 12 as east, case when c_custkey % 7 <> 0 then c_mktsegment end as segment from customer""")
def _(t):
    """The customers written as workbooks of some hundred rows each, and read back."""
    d = t.customer.select("c_custkey", "c_name", "c_acctbal", (F.col("c_nationkey") > 12).alias("east"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.floor(F.col("c_custkey") / 500).alias("part"))

    def book(rows: pa.Table) -> pa.Table:
        names = [c for c in rows.column_names if c != "part"]
        return pa.table({"path": [f"part-{rows.column('part')[0].as_py()}.xlsx"], "content": pa.array([workbook.write_workbook(names, [[r[c] for c in names] for r in rows.to_pylist()])], pa.binary())})

    return workbook.table_of(d.groupBy("part").applyInArrow(book, "path string, content binary"))


@query("src08_size_guards", """select 'orders' as name, 'usable' as status, '' as reason union all select 'no rows', 'failed', 'table is empty' from (select count(*) as n from orders where o_orderkey < 0) where n = 0
  union all select 'one row', 'failed', 'too few rows' from (select count(*) as n from region where r_regionkey = 0) where n < 2
  union all select 'one column', 'failed', 'too few usable columns' from (select count(*) from nation)""")
def _(t):
    """Tables that can and cannot be analysed, with the reason of the failure record."""
    cases = {"orders": (t.orders, 2, 2), "no rows": (t.orders.where("o_orderkey < 0"), 2, 1), "one row": (t.region.where("r_regionkey = 0"), 2, 1), "one column": (t.nation.select("n_name"), 2, 2)}
    out = None
    for name, (d, rows, cols) in cases.items():
        try:
            files.require(d, rows, cols)
            row = t.spark.createDataFrame([(name, "usable", "")], "name string, status string, reason string")
        except files.UnusableTable as e:
            row = e.row(t.spark).select(F.lit(name).alias("name"), "status", "reason")
        out = row if out is None else out.unionByName(row)
    return out


EDGES = (0, 1, 2, 5, 10, 20, 50, 100)


@query("strx1_streamed_drift", f"""with mark as (select max(ts) - interval 10 minutes as m from events), v as (select event_type as key, date_trunc('day', ts) as start, value from events where value is not null),
  w as (select key, start, count(*) as n, avg(value) as mean, stddev_samp(value) as sd from v group by all), r as (select key, min(start) as start from w group by 1),
  share as (select key, start, e, count(*) filter (value <= e) / count(*) as p from v, (select unnest({list(EDGES)}) as e) group by all),
  ks as (select own.key, own.start, max(abs(own.p - ref.p)) as ks from share own join r using (key) join share ref on ref.key = r.key and ref.start = r.start and ref.e = own.e group by all)
  select w.key, case when w.start = r.start then 'reference' else 'window' end as kind, w.start::timestamp as window_start, w.n, round(w.mean, 6) as mean,
    case when w.start > r.start then round(w.mean - b.mean, 6) end as shift, case when w.start > r.start then round(abs(w.mean - b.mean) / b.sd, 6) end as normalised_shift, case when w.start > r.start then round(ks.ks, 6) end as ks
  from w join r using (key) join w b on b.key = r.key and b.start = r.start join ks on ks.key = w.key and ks.start = w.start, mark where w.start + interval 1 day <= m""")
def _(t):
    """Shifts of the daily windows that the watermark has closed, as the stream told them."""
    out = place(t, "drift")
    stream = drift.drift_stream(win.event_stream(t.spark, t._folder, "events"), "ts", "event_type", "value", edges=EDGES)
    win.run_to_parquet(stream, f"{out}/data", f"{out}/checkpoint")
    near = [F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) for c in ("mean", "shift", "normalised_shift", "ks")]
    return t.spark.read.parquet(f"{out}/data").where("kind <> 'silent'").select("key", "kind", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", *near)

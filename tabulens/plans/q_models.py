"""Training, clustering, anomaly detection and extraction: iterative or Python-backed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean, clustering, clusters, dbscan as db, encode, evaluate as ev, extract, iforest, models, stats
from ..operators.birch import birch
from ..operators.ranks import number_rows
from . import inputs as I
from .registry import query

FIELDS = [{"name": "title", "selector": "a", "type": "text"}, {"name": "link", "selector": "a", "type": "link"}, {"name": "badge", "selector": ".badge", "type": "text"}]


# --- supervised ------------------------------------------------------------------------------

def quality_table(t):
    """Labelled documents with simple features."""
    d = t.documents.join(t.labels, "doc_id")
    c = F.col("text")
    return d.select("doc_id", "quality", "lang", "source", "text", F.col("n_chars").cast("double").alias("n_chars"), X.word_count(c).cast("double").alias("n_words"),
                    (F.regexp_count(c, F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(F.length(c), F.lit(1))).alias("mark_share"),
                    (F.regexp_count(c, F.lit("\n")) + 1).cast("double").alias("n_lines"))


QUALITY = models.Spec("quality", "classification", ["doc_id"], ["n_chars", "n_words", "mark_share", "n_lines"], ["lang", "source"])
PRICE = models.Spec("goal", "regression", ["p_partkey"], ["p_size", "noise"], ["p_brand"])


def price_table(t):
    """Parts with a target that depends on size, brand and the retail price."""
    return t.part.select("p_partkey", "p_size", "p_brand", (F.col("p_partkey") % 17).cast("double").alias("noise"),
                         (15.0 * F.col("p_size") + F.length("p_brand") * 20.0 + F.when(F.col("p_brand").endswith("5"), 200.0).otherwise(0.0)
                          + F.col("p_retailprice") / 10.0).alias("goal"))


LINEAR = ["LogisticRegression", "LinearSVC"]


@query("mod04_leaderboard_classification")
def _(t):
    p = models.prepare(quality_table(t), QUALITY)
    return models.leaderboard(p.train, models.candidates_for(p), QUALITY, p.folds)


@query("mod04_leaderboard_regression")
def _(t):
    p = models.prepare(price_table(t), PRICE)
    return models.leaderboard(p.train, models.candidates_for(p), PRICE, p.folds)


@query("mod11_text_leaderboard")
def _(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "quality", X.normalize_english(F.col("text")).alias("text"))
    spec = models.Spec("quality", "classification", ["doc_id"])
    data = models.text_frame(d, "doc_id", "text", "quality")
    train = data.frame.where("part = 'train'")
    return models.leaderboard(train, models.text_candidates(len(data.labels), train.count()), spec, data.folds, frames=data.frames)


def fitted(t, spec, table, name):
    p = models.prepare(table, spec)
    return p, *models.final_fit(p, name)


def _single(task, name):
    def run(t):
        spec, table = (QUALITY, quality_table(t)) if task == "classification" else (PRICE, price_table(t))
        _p, _m, pred, _metrics = fitted(t, spec, table, name)
        return pred

    return run


query("mod05_random_forest")(_single("classification", "RandomForest"))
query("mod06_extra_trees")(_single("regression", "ExtraTrees"))
query("mod07_gradient_boosting")(_single("regression", "GradientBoosting"))
query("mod09_logistic_regression")(_single("classification", "LogisticRegression"))
query("mod10_linear_svm")(_single("classification", "LinearSVC"))
query("mod12_ridge")(_single("regression", "Ridge"))
query("mod12_least_squares")(_single("regression", "LinearRegression"))


@query("mod08_optional_boosting")
def _(t):
    """Boosted trees of the optional library: a result when it is installed, a skipped row when not."""
    p = models.prepare(price_table(t), PRICE)
    return models.leaderboard(p.train, {"XGBoost": models.candidates_for(p)["XGBoost"], "Ridge": models.candidates_for(p)["Ridge"]}, PRICE, p.folds)


@query("mod15_feature_importance")
def _(t):
    p, m, _pred, _metrics = fitted(t, PRICE, price_table(t), "RandomForest")
    return models.importance(m, p.train)


@query("mod15_permutation_importance")
def _(t):
    d = price_table(t)
    p, m, _pred, _metrics = fitted(t, PRICE, d, "Ridge")
    return models.permutation_importance(d, p, m)


@query("mod15_linear_contributions", """with m as (select avg(l_quantity) a, avg(l_discount) b from lineitem), r as (select 2.0 * (l_quantity - a) q, -3.0 * (l_discount - b) d from lineitem, m)
  select 'l_quantity' as feature, round(stddev_pop(q), 4) as std_c, round(avg((q > 0)::int) * 100, 1) as positive_pct from r union all select 'l_discount', round(stddev_pop(d), 4), round(avg((d > 0)::int) * 100, 1) from r""")
def _(t):
    return stats.linear_contributions(t.lineitem, {"l_quantity": 2.0, "l_discount": -3.0}).drop("mean_c")


@query("mod16_final_fit")
def _(t):
    p, _m, _pred, metrics = fitted(t, PRICE, price_table(t), "Ridge")
    return models.spread_warning(metrics, p.train)


@query("mod17_score_new_rows", "select count(*) as n_rows, count(*) as known_class, count(*) as fitting_id, count(*) as sure from documents join labels using (doc_id)")
def _(t):
    """Every new row gets a known class, the class's number and a confidence between 1 / classes and 1."""
    d = quality_table(t)
    p, m, _pred, _metrics = fitted(t, QUALITY, d, "LogisticRegression")
    got = models.score_new(p.features, m, p.labels, d.drop("quality").withColumn("quality", F.lit(None).cast("int")), ["doc_id"])
    return got.agg(F.count("*").alias("n_rows"), F.count_if(F.col("prediction").isin("0", "1")).alias("known_class"),
                   F.count_if(F.col("prediction") == F.col("class_id").cast("string")).alias("fitting_id"), F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") <= 1)).alias("sure"))


@query("eva08_confidence_histogram")
def _(t):
    from ..operators.charts import histogram
    d = quality_table(t)
    p, m, _pred, _metrics = fitted(t, QUALITY, d, "LogisticRegression")
    return histogram(models.score_new(p.features, m, p.labels, d, ["doc_id"]), "confidence", 10)


@query("eva09_cross_validated_r2")
def _(t):
    p = models.prepare(price_table(t), PRICE)
    pred = models.out_of_fold(p.train, models.candidates_for(p)["Ridge"], ["p_partkey"], p.folds)
    return ev.regression_metrics(pred, "actual", "predicted").select(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("r2") * 100)), 1).alias("model_r2"))


# --- clustering ------------------------------------------------------------------------------

def scaled_planted(t):
    return encode.standard_scale(I.planted(t), I.PLANTED_FEATURES).select("id", *I.PLANTED_FEATURES)


@query("clu01_kmeans")
def _(t):
    return clustering.kmeans(scaled_planted(t), I.PLANTED_FEATURES, 4)[1].select("id", "cluster")


@query("clu02_gaussian_mixture")
def _(t):
    return clustering.gaussian_mixture(scaled_planted(t), I.PLANTED_FEATURES, 4)[1].select("id", "cluster")


@query("clu03_two_phase_ward")
def _(t):
    return clustering.two_phase_ward(scaled_planted(t), I.PLANTED_FEATURES, [4], ["id"])[4].select("id", "cluster")


@query("clu03_birch", f"""with {I.PLANTED.strip()}, g as (select cluster, far, dense_rank() over (order by min(id)) - 1 as label from planted group by all)
  select id, cast(label as bigint) as cluster from planted join g using (cluster, far)""")
def _(t):
    """Birch finds the planted groups; clusters are numbered by their smallest id."""
    d = scaled_planted(t)
    k = I.planted(t).select("cluster", "far").distinct().count()
    got = birch(d, ["f1", "f2"], [k]).select("id", F.get("clusters", F.lit(0)).alias("c"))
    first = got.groupBy("c").agg(F.min("id").alias("first"))  # one row per cluster
    names = number_rows(first, ["first"]).select("c", (F.col("rank") - 1).alias("cluster"))
    return got.join(F.broadcast(names), "c").select("id", "cluster")


@query("clu04_bisecting_kmeans")
def _(t):
    return clustering.bisecting(scaled_planted(t), I.PLANTED_FEATURES, 4)[1].select("id", "cluster")


DBSCAN_SQL = f"""with recursive {I.PLANTED.strip()},
pt as (select id, (f1 - avg(f1) over ()) / stddev_pop(f1) over () as a, (f2 - avg(f2) over ()) / stddev_pop(f2) over () as b from planted),
e as (select unnest([0.3::double, 0.5::double, 0.8::double, 1.0::double, 1.5::double, 2.0::double]) as eps), ms as (select unnest([4, 5, 8, 10]) as m),
near as (select eps, x.id as i, y.id as j, (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) as d from pt x, pt y, e where (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= eps * eps),
core as (select eps, m, i from (select eps, i, count(*) as c from near group by all), ms where c >= m),
edge as (select near.eps, x.m, near.i, near.j from near join core x on near.eps = x.eps and near.i = x.i join core y on near.eps = y.eps and near.j = y.i and x.m = y.m),
lab(eps, m, i, l) using key (eps, m, i) as (select eps, m, i, i from core union
  select edge.eps, edge.m, edge.i, min(lab.l) from edge join lab on edge.eps = lab.eps and edge.m = lab.m and edge.j = lab.i
  join recurring.lab cur on cur.eps = edge.eps and cur.m = edge.m and cur.i = edge.i group by edge.eps, edge.m, edge.i, cur.l having min(lab.l) < cur.l),
num as (select eps, m, i, dense_rank() over (partition by eps, m order by l) - 1 as label from lab),
edgeless as (select e.eps, ms.m, pt.id from e, ms, pt anti join core on core.eps = e.eps and core.m = ms.m and core.i = pt.id),
border as (select o.eps, o.m, o.id, coalesce(arg_min(num.label, (near.d, num.label)), -1) as label from edgeless o left join near on near.eps = o.eps and near.i = o.id
  left join num on num.eps = o.eps and num.m = o.m and num.i = near.j group by all),
every as (select eps, m, i as id, label from num union all select eps, m, id, label from border),
state as (select eps, m, case when max(label) + 1 < 2 or round(avg((label < 0)::int) * 100, 4) > 60 then 'rejected' else 'candidate' end as status from every group by all)
select eps, m as min_samples, id, cast(label as bigint) as label, status from every join state using (eps, m)"""


@query("clu06_dbscan", DBSCAN_SQL)
def _(t):
    """Labels and verdict of all 24 settings."""
    labels = db.dbscan_grid(scaled_planted(t), ["f1", "f2"], "id")
    return labels.join(F.broadcast(db.grid_status(labels).select("eps", "min_samples", "status")), ["eps", "min_samples"])  # one row per setting


@query("clu08_candidate_comparison")
def _(t):
    board, _labelled = clustering.compare(scaled_planted(t), I.PLANTED_FEATURES, ["id"])
    return board


@query("clu12_assign_new_rows")
def _(t):
    """Suppliers scaled like the customers and put into the customer clusters."""
    cust = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    new = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    cols = ["balance", "nation"]
    fit = encode.moments(cust, cols)
    model, _rows = clustering.kmeans(encode.standard_scale(cust, cols, fit), cols, 4)
    scaled = encode.standard_scale(encode.align(new, {"balance": 0.0, "nation": 0.0}, {}, ["id"]), cols, fit)
    return model.transform(clustering.with_vector(scaled, cols)).select("id", F.col("cluster").cast("long").alias("cluster"))


@query("ano01_isolation_forest")
def _(t):
    return iforest.detect(I.planted(t), I.PLANTED_FEATURES, ["id"]).select("id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("ano01_anomaly_report")
def _(t):
    from ..operators import anomalies
    d = I.planted(t)
    flags = iforest.detect(d, I.PLANTED_FEATURES, ["id"])
    return anomalies.top_anomalies(d.join(flags, "id"), "is_anomaly", "anomaly_score", "id", I.PLANTED_FEATURES, extra=["cluster"])


# --- extraction ------------------------------------------------------------------------------

def items(t):
    return extract.extract_items(t.spread("pages", "page_id"), "nav", "li", FIELDS)


UNESCAPE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
NAV = f"""li as (select page_id, url, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1, 's')) as li, generate_subscripts(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1, 's'), 1) - 1 as position from pages),
  it as (select page_id, url, position, trim({UNESCAPE.format(x="regexp_extract(li, '>([^<]*)</a>', 1)")}) as title, {UNESCAPE.format(x="regexp_extract(li, 'href=\"([^\"]*)\"', 1)")} as href from li),
  val as (select page_id, position, nullif(title, '') as title, nullif(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href, '') as link from it),
  idx as (select *, (row_number() over (order by page_id, position) - 1)::bigint as item_index from val where title is not null or link is not null)"""


@query("ext01_item_extraction", f"""with {NAV} select page_id, position, 'title' as field_name, title as value from val union all select page_id, position, 'link', link from val union all select page_id, position, 'badge', null from val""")
def _(t):
    return items(t).select("page_id", "position", "field_name", "value")


@query("ext02_typed_values", f"""with {NAV} select 'title' as field_name, count(title) as filled, count(distinct title) as n_values from val union all select 'link', count(link), count(distinct link) from val union all select 'badge', 0, 0""")
def _(t):
    return items(t).groupBy("field_name").agg(F.count("value").alias("filled"), F.count_distinct("value").alias("n_values"))


@query("ext03_field_types", f"""with {NAV} select 'title' as field_name, 'text' as field_type, count(*) as "values" from it union all select 'anchor', 'link', count(*) from it""")
def _(t):
    raw = extract.extract_fields(t.spread("pages", "page_id"), "nav", "li", [{"name": "anchor", "selector": "a"}, {"name": "title", "selector": "a"}])
    raw = raw.withColumn("href", F.when(F.col("field_name") == "title", "").otherwise(F.col("href")))
    return extract.detect_field_types(raw)


@query("ext04_repeated_patterns")
def _(t):
    return extract.detect_patterns(t.spread("pages", "page_id"))


@query("ext05_long_to_wide", f"with {NAV} select item_index, title, link, null::varchar as badge, null::varchar as price from idx")
def _(t):
    return extract.long_to_wide(extract.number_items(items(t)), ["item_index"], "field_name", "value", ["title", "link", "badge", "price"])


@query("ext06_page_progress", f"with {NAV} select page_id, count(*) as items, 0::bigint as failed from val group by 1")
def _(t):
    return extract.page_progress(items(t))


@query("ext07_global_item_index", f"with {NAV} select page_id, item_index, title as value from idx where item_index < 500")
def _(t):
    d = extract.number_items(items(t), limit=500)
    return d.where("field_name = 'title'").select("page_id", "item_index", "value")


@query("win05_dense_item_index", f"with {NAV} select page_id, min(item_index) as first_index, max(item_index) as last_index from idx group by 1")
def _(t):
    return extract.number_items(items(t)).groupBy("page_id").agg(F.min("item_index").alias("first_index"), F.max("item_index").alias("last_index"))


@query("ext08_run_record", f"with {NAV} select regexp_extract(url, '://([^/?#:]*)', 1) as host, count(distinct page_id) as pages, count(*) as rows, 0::bigint as failed_items, 'stored' as method from it group by 1")
def _(t):
    return extract.run_record(items(t), "stored")


@query("agg17_fill_rate", f"""with {NAV} select count(*) * 3 as cells, count(title) + count(link) as filled, round(100.0 * (count(title) + count(link)) / (count(*) * 3), 0)::bigint as fill_pct from val""")
def _(t):
    return extract.fill_rate(items(t))


@query("snk06_extracted_tables", f"""with {NAV} select 'long' as kind, count(*) * 3 as rows from idx union all select 'wide', count(*) from idx""")
def _(t):
    from ..sinks import tables as sk
    return sk.preview_extracted(extract.number_items(items(t)), ["title", "link", "badge"])


@query("snk09_filtered_export", """select p_partkey, p_name, try_cast(translate('$' || p_size || ',0.5', '$,', '') as double) as price from part where contains(lower(p_name), 'bolt')""")
def _(t):
    from ..sinks import tables as sk
    d = t.part.select("p_partkey", "p_name", F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(",0.5")).alias("price"))
    return sk.export_view(d, "BOLT", ["p_name"], ["price"])

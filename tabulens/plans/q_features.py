"""Text, dates, numbers, sources and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text as X
from ..functions.scalars import band, clamp01, importance_level, pct_change, safe_number, sanitize, separation_level, severity_rank
from ..operators import clean, encode, impute, profile as pf, textstats, vectorize
from . import inputs as I
from .registry import query

# SQL spelling of the shared character classes
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = "[^" + WS[1:]
AR = r"[\x{0600}-\x{06FF}]"
DIA_A = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06E4}\x{06EA}-\x{06ED}]"
DIA_B = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}]"
DIA_C = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}-\x{06ED}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"

PHRASES = ["الشَّكْوَى   مِنْ خِدْمَةٍ", "أحمد إلى آخر المدرسة ـــ", " Mixed نص English  text ", "", "Plain  English "]
ARABIC_TEXT = "arabic_text as (select c_custkey as id, case c_custkey % 6 " + " ".join(
    f"when {i} then '{p}'" for i, p in enumerate(PHRASES)) + " else null end || case when c_custkey % 6 = 3 then '' else ' ' || c_name end as txt from customer)"


def arabic_text(t):
    k = F.col("c_custkey") % 6
    words = F
    for i, p in enumerate(PHRASES):
        words = words.when(k == i, p)
    return t.customer.select(F.col("c_custkey").alias("id"), F.concat(
        words, F.when(k == 3, "").otherwise(F.concat(F.lit(" "), F.col("c_name")))).alias("txt"))


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


@query("src03_garbled_share", """select 'text' as column_name, count(v) as cells,
  round(avg(regexp_matches(v, '[ÙØÃ\\x{FFFD}]')::int), 6) as garbled_share from (select case when doc_id % 9 = 0 then 'Ø´Ù' || text else text end v from documents)
  union all select 'lang', count(lang), round(avg(regexp_matches(lang, '[ÙØÃ]')::int), 6) from documents""")
def _(t):
    d = t.documents.select(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Ø´Ù"), "text")).otherwise(F.col("text")).alias("text"), "lang")
    return textstats.garbled_share(d, ["text", "lang"])


@query("src04_header_cleanup", """select n_nationkey as "key", n_name as name, n_regionkey as unnamed_column from nation""")
def _(t):
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    return clean.clean_header(n.withColumn("again", F.lit(1)).toDF(" key ", "name", "  ", "name "))


@query("src05_run_config", """select event_id, try_cast(json_extract_string(p, '$.target_column') as varchar) as target_column,
  coalesce(json_extract_string(p, '$.task_type'), 'auto') as task_type, coalesce(p like '{%', false) as valid
  from (select event_id, case when event_id % 4 = 0 then '{"target_column":"value","task_type":"regression"}' when event_id % 4 = 1 then '{"target_column":"event_type"}'
   when event_id % 4 = 2 then '{}' else null end as p from events)""")
def _(t):
    from ..sources.files import parse_config
    k = F.col("event_id") % 4
    d = t.events.select("event_id", F.when(k == 0, '{"target_column":"value","task_type":"regression"}').when(k == 1, '{"target_column":"event_type"}')
                        .when(k == 2, "{}").otherwise("not json").alias("p"))
    return parse_config(d, "p").select("event_id", "target_column", "task_type", "valid")


RUNS = """runs as (select event_id as run_id, user_id, event_type, case when event_id % 3 = 0 then null else value end as new_score,
  case when event_id % 2 = 0 then '' else event_type end as new_name, value * 2 as old_score from events)"""


@query("src06_merge_results", f"""with {RUNS} select run_id, coalesce(new_score, old_score) as score,
  coalesce(nullif(new_name, ''), event_type) as name from runs""")
def _(t):
    from ..sources.runs import merge_results
    k = F.col("event_id")
    new = t.events.select(k.alias("run_id"), F.when(k % 3 != 0, F.col("value")).alias("score"),
                          F.when(k % 2 != 0, F.col("event_type")).otherwise("").alias("name"))
    old = t.events.select(k.alias("run_id"), (F.col("value") * 2).alias("score"), F.col("event_type").alias("name"))
    return merge_results([old, new], ["run_id"])


@query("src07_stored_pages", """select page_id, url, length(html) as html_length from pages where url <> ''""")
def _(t):
    from ..sources.pages import read_pages
    return read_pages(t.pages).select("page_id", "url", F.length("html").cast("long").alias("html_length"))


@query("str01_arabic_clean", f"""with {ARABIC_TEXT} select id, {squeeze_sql(f"translate(regexp_replace(txt, '{DIA_A}', '', 'g'), 'أإآىةـ', 'ااايه')")} as txt from arabic_text""")
def _(t):
    return arabic_text(t).select("id", X.normalize_arabic(F.col("txt")).alias("txt"))


@query("str02_arabic_model", f"""with {ARABIC_TEXT} select id, {squeeze_sql(f"translate(regexp_replace(txt, '{DIA_B}', '', 'g'), 'أإآـ', 'ااا')")} as txt from arabic_text""")
def _(t):
    return arabic_text(t).select("id", X.normalize_arabic(F.col("txt"), "model").alias("txt"))


@query("str03_arabic_column", f"""with {ARABIC_TEXT} select id, {squeeze_sql(f"translate(regexp_replace(txt, '{DIA_C}', '', 'g'), 'أإآةـ', 'اااه')")} as txt from arabic_text""")
def _(t):
    return arabic_text(t).select("id", X.normalize_arabic(F.col("txt"), "column").alias("txt"))


@query("str04_english_normalize", f"""select doc_id, md5({squeeze_sql('lower(text)')}) as digest from documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(X.normalize_english(F.col("text")).cast("binary")).alias("digest"))


@query("str05_cell_language", f"""with {ARABIC_TEXT}, r as (select id, txt, len(regexp_extract_all(txt, '{AR}')) * 1.0 / nullif(length(regexp_replace(txt, '{WS}', '', 'g')), 0) ra,
  len(regexp_extract_all(txt, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{08A0}}-\\x{{08FF}}]+')) ar, len(regexp_extract_all(txt, '[a-zA-Z]')) la from arabic_text)
  select id, case when ra > 0.6 then 'arabic' when ra > 0.2 then 'mixed' when ra is not null then 'english' else 'unknown' end as language,
  case when ar * 1.0 / nullif(ar + la, 0) >= 0.60 then 'arabic' when ar * 1.0 / nullif(ar + la, 0) <= 0.15 then 'english'
    when ar * 1.0 / nullif(ar + la, 0) is not null then 'mixed' else 'unknown' end as by_runs from r""")
def _(t):
    return arabic_text(t).select("id", X.cell_language(F.col("txt")).alias("language"), X.cell_language_by_runs(F.col("txt")).alias("by_runs"))


@query("str06_has_arabic", f"""with {ARABIC_TEXT} select id, coalesce(regexp_matches(txt, '{AR}'), false) as has_arabic from arabic_text""")
def _(t):
    return arabic_text(t).select("id", X.has_arabic(F.col("txt")).alias("has_arabic"))


@query("str07_text_lengths", f"""select lang, count(*) as texts, sum(length(text))::bigint as chars, sum(len(regexp_extract_all(text, '{NWS}+')))::bigint as words,
  round(avg(len(regexp_extract_all(text, '{NWS}+'))), 4) as mean_words from documents group by 1""")
def _(t):
    w = X.word_count(F.col("text"))
    return t.documents.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"), F.sum(w).cast("long").alias("words"),
                                           F.round(F.avg(w), 4).alias("mean_words"))


@query("str08_tokens_and_pairs", f"""with w as (select doc_id, regexp_extract_all(lower(text), '{TOKEN}') as l from documents)
  select doc_id, len(l)::bigint as n_tokens, (len(l) + greatest(len(l) - 1, 0))::bigint as n_grams, l[1] as first_token,
  case when len(l) > 1 then l[len(l) - 1] || ' ' || l[len(l)] end as last_pair from w""")
def _(t):
    d = t.documents.select("doc_id", X.tokens(F.col("text")).alias("l")).withColumn("g", X.ngrams12(F.col("l")))
    return d.select("doc_id", F.size("l").cast("long").alias("n_tokens"), F.size("g").cast("long").alias("n_grams"),
                    F.get("l", F.lit(0)).alias("first_token"), F.when(F.size("l") > 1, F.element_at("g", -1)).alias("last_pair"))


@query("str09_price_cleanup", f"""select p_partkey, translate(raw, '£$€¥₹, ' || chr(9) || chr(10), '') as price,
  regexp_matches(trim(raw), '^[£$€¥₹][0-9,]+\\.?[0-9]*$') or regexp_matches(trim(raw), '^[0-9,]+\\.?[0-9]*[£$€¥₹]$') as is_price
  from (select p_partkey, case p_partkey % 4 when 0 then '$' || p_size || ',000.50' when 1 then ' ' || p_size || '₹ ' when 2 then p_name else '£ ' || p_size end as raw from part)""")
def _(t):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("$"), s, F.lit(",000.50"))).when(k == 1, F.concat(F.lit(" "), s, F.lit("₹ "))).when(k == 2, F.col("p_name")).otherwise(F.concat(F.lit("£ "), s))
    return t.part.select("p_partkey", X.clean_price(raw).alias("price"), X.looks_like_price(raw).alias("is_price"))


@query("str10_star_rating", """select c_custkey, case c_custkey % 4 when 0 then '3' when 1 then '5' when 2 then null else '1' end as rating from customer""")
def _(t):
    k = F.col("c_custkey") % 4
    css = F.when(k == 0, "star-rating Three").when(k == 1, "rating FIVE stars").when(k == 2, "phone").otherwise("one")
    return t.customer.select("c_custkey", X.star_rating(css).alias("rating"))


@query("str11_urls", """with u as (select page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as origin, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
  select page_id, regexp_extract(url, '://([^/?#:]*)', 1) as host, origin || '/a/b?x=1' as rooted, origin || '/x.png' as dotted,
  origin || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || 'sub/item' as relative, 'https://cdn.example.net/i.png' as absolute,
  regexp_extract(url, '^([A-Za-z]+):', 1) || '://cdn.example.net/i.png' as protocol_relative from u""")
def _(t):
    u = F.col("url")
    r = lambda x: X.resolve_url(u, F.lit(x))
    return t.pages.select("page_id", X.host_name(u).alias("host"), r("/a/b?x=1").alias("rooted"), r("/p/../q/./../x.png").alias("dotted"),
                          r("sub/item").alias("relative"), r("https://cdn.example.net/i.png").alias("absolute"),
                          r("//cdn.example.net/i.png").alias("protocol_relative"))


@query("str12_first_sentence", f"""select conv_id, turn, regexp_extract({squeeze_sql('text')}, '^(.*?[.!?])(?: |$)', 1) as first_sentence from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", X.first_sentence(F.col("text")).alias("first_sentence"))


@query("dat01_date_features", """select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month, day(o_orderdate)::int as o_orderdate_day,
  hour(o_orderdate)::int as o_orderdate_hour, (isodow(o_orderdate) - 1)::int as o_orderdate_dow, (coalesce(isodow(o_orderdate) in (5, 6), false))::int as o_orderdate_is_weekend,
  (o_orderdate is null)::int as o_orderdate_missing from (select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderdate end as o_orderdate from orders)""")
def _(t):
    d = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    return dates.date_features(d, "o_orderdate")


@query("dat02_model_dates", """with d as (select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderdate end as d from orders),
  m as (select quantile_cont(month(d)::double, 0.5) mm, quantile_cont(week(d)::double, 0.5) mw from d)
  select o_orderkey, coalesce(month(d)::double, mm) as month, coalesce(week(d)::double, mw) as week from d, m""")
def _(t):
    d = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("d"))
    parts = dates.model_date_parts("d")
    d = d.select("o_orderkey", parts["d_month"].alias("month"), parts["d_week"].alias("week"))
    return encode.median_fill(d, ["month", "week"])[0]


@query("mth01_safe_numbers", """select event_id, coalesce(case when event_id % 5 = 0 then null else value end, 0.0) as safe,
  least(1.0, greatest(0.0, value / 50.0 - 0.5)) as clamped from events""")
def _(t):
    v = F.when(F.col("event_id") % 5 == 0, "inf").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", safe_number(v).alias("safe"), clamp01(F.col("value") / 50.0 - 0.5).alias("clamped"))


@query("mth02_bands", """select p_partkey, case when p_size >= 30 then 'Critical' when p_size >= 15 then 'High' when p_size >= 5 then 'Medium' else 'Low' end as impact,
  case when p_size > 25 then 'Critical' when p_size > 10 then 'High' else 'Standard' end as separation,
  case p_size % 6 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 else 5 end as severity_rank from part""")
def _(t):
    sev = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info", "other")]), F.col("p_size") % 6 + 1)
    return t.part.select("p_partkey", importance_level(F.col("p_size")).alias("impact"), separation_level(F.col("p_size")).alias("separation"),
                         severity_rank(sev).alias("severity_rank"))


@query("mth03_percent_change", """select o_custkey, round((max(o_totalprice) - min(o_totalprice)) / greatest(abs(min(o_totalprice)), 1e-9) * 100, 4) as pct from orders group by 1""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.round(pct_change(F.min("o_totalprice"), F.max("o_totalprice")), 4).alias("pct"))


@query("arr01_feature_arrays", """select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as priorities,
  array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:2], ',') as first_two,
  array_to_string(list_sort(list_intersect(list_distinct(list(o_orderpriority)), ['1-URGENT', '5-LOW'])), ',') as extremes,
  len(list_filter(list_distinct(list(o_orderpriority)), lambda x: not list_contains(['1-URGENT', '5-LOW'], x)))::bigint as others from orders group by 1""")
def _(t):
    ends = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    d = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s"))
    return d.select("o_custkey", F.array_join("s", ",").alias("priorities"), F.array_join(F.slice("s", 1, 2), ",").alias("first_two"),
                    F.array_join(F.array_intersect("s", ends), ",").alias("extremes"), F.size(F.array_except("s", ends)).cast("long").alias("others"))


@query("map01_merge_maps", """select event_id, event_type as kind, case when event_id % 2 = 0 then 'new' else 'old' end as state, coalesce(nullif(case when event_id % 3 = 0 then '' else 'x' end, ''), 'fallback') as first_filled from events""")
def _(t):
    from ..sources.runs import first_filled, merge_maps
    k = F.col("event_id")
    old = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("state"), F.lit("old"))
    new = F.when(k % 2 == 0, F.create_map(F.lit("state"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    m = merge_maps(old, new)
    return t.events.select("event_id", m["kind"].alias("kind"), m["state"].alias("state"),
                           first_filled(F.when(k % 3 == 0, "").otherwise("x"), F.lit("fallback")).alias("first_filled"))


@query("jsn01_struct_json", """select event_id, case when event_id % 5 = 0 then null else round(value, 6) end as value, try_cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def _(t):
    v = F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))
    d = sanitize(t.events.select("event_id", v.alias("value"), "props"))
    d = d.withColumn("j", F.to_json(F.struct("event_id", "value", F.from_json("props", "k long").alias("p"))))
    back = d.select(F.from_json("j", "event_id long, value double, p struct<k: long>").alias("s"))
    return back.select("s.event_id", "s.value", F.col("s.p.k").alias("k"))


@query("jsn02_importance_shapes", """select case when p_partkey % 4 = 3 then 'unknown' else p_name end as feature,
  round(case p_partkey % 4 when 0 then p_size * 1.0 when 1 then p_size * 2.0 when 2 then 0 else p_size / 10.0 end, 4) as impact_pct, 'unknown' as direction from part""")
def _(t):
    from ..operators.charts import normalize_importance
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    j = (F.when(k == 0, F.to_json(F.struct(F.col("p_name").alias("feature"), F.lit(0).alias("impact_pct"), (s * 1.0).alias("impact"))))
         .when(k == 1, F.to_json(F.struct(F.col("p_name").alias("name"), (s * 2.0).alias("impact_pct"))))
         .when(k == 2, F.to_json(F.struct(F.col("p_name").alias("feature"), F.lit("n/a").alias("importance"))))
         .otherwise(F.to_json(F.struct((s / 10.0).alias("importance")))))
    return normalize_importance(t.part.select(j.alias("j")), "j")


@query("snk08_sanitize", """select o_orderkey, case when o_orderkey % 5 = 0 then null else round(o_totalprice / 7, 6) end as price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate from orders""")
def _(t):
    v = F.when(F.col("o_orderkey") % 5 == 0, float("inf")).otherwise(F.col("o_totalprice") / 7)
    return sanitize(t.orders.select("o_orderkey", v.alias("price"), "o_orderdate"))


@query("snk08_sanitize_zero", """select o_orderkey, case when o_orderkey % 5 = 0 then 0.0 else round(o_totalprice / 7, 6) end as price from orders""")
def _(t):
    v = F.when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice") / 7)
    return sanitize(t.orders.select("o_orderkey", v.alias("price")), null_as=0.0)


# --- imputation and encoding -----------------------------------------------------------------

HOLES = """holes as (select l_orderkey, l_linenumber, case when l_orderkey % 4 = 0 then null else l_quantity end as l_quantity,
  case when l_orderkey % 5 = 0 then null else l_extendedprice end as l_extendedprice, case when l_partkey % 5 = 0 then null else l_tax end as l_tax from lineitem)"""


def holes(t):
    k = F.col("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(k % 4 != 0, F.col("l_quantity")).alias("l_quantity"),
                             F.when(k % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
                             F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")).alias("l_tax"))


@query("fea01_imputation_strategy", f"""with {HOLES}, m as (select count(*) n, 1 - count(l_quantity) * 1.0 / count(*) a, 1 - count(l_extendedprice) * 1.0 / count(*) b,
  1 - count(l_tax) * 1.0 / count(*) c from holes) select 3::bigint as n_columns, round((a + b + c) / 3, 6) as avg_missing,
  case when (a + b + c) / 3 >= 0.15 then 'mice' when (a + b + c) / 3 >= 0.10 then 'knn' else 'simple' end as strategy from m""")
def _(t):
    return impute.strategy_table(pf.column_profile(holes(t), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("fea02_simple_fill", f"""with {I.ORDERS_DIRTY}, m as (select round(avg(holes), 4) a from orders_dirty) select o_orderkey, coalesce(holes, a) as holes from orders_dirty, m""")
def _(t):
    d = I.orders_dirty(t).select("o_orderkey", "holes")
    return impute.simple_fill(d, pf.column_profile(d, ["holes"]))


@query("fea02_simple_fill_skewed", f"""with {I.CUSTOMER_OUTLIERS}, h as (select c_custkey, case when c_custkey % 4 = 0 then null else c_acctbal end as bal from customer_outliers),
  m as (select round(quantile_cont(bal, 0.5), 4) a from h) select c_custkey, coalesce(bal, a) as bal from h, m""")
def _(t):
    d = I.customer_outliers(t).select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("bal"))
    return impute.simple_fill(d, pf.column_profile(d, ["bal"]))


@query("fea04_chained_regressions")
def _(t):
    return impute.mice_fill(holes(t), ["l_quantity", "l_extendedprice", "l_tax"], rounds=4)


@query("fea05_mode_fill", f"""with {I.ORDERS_DIRTY}, m as (select status s from orders_dirty where status is not null group by 1 order by count(*) desc, 1 limit 1)
  select o_orderkey, coalesce(status, s) as status from orders_dirty, m""")
def _(t):
    return impute.mode_fill(I.orders_dirty(t).select("o_orderkey", "status"), ["status"])


@query("fea06_text_missing_flag", f"""with {I.ORDERS_CLEAN} select o_orderkey, price_txt, (price_txt is null)::bigint as price_txt_missing_flag from orders_clean""")
def _(t):
    return impute.text_missing_flags(clean.standardize_missing(I.orders_dirty(t)).select("o_orderkey", "price_txt"), ["price_txt"])


@query("fea07_median_fill", f"""with {I.ORDERS_DIRTY}, m as (select quantile_cont(holes, 0.5) a from orders_dirty) select o_orderkey, round(coalesce(holes, a), 4) as holes from orders_dirty, m""")
def _(t):
    d, _m = encode.median_fill(I.orders_dirty(t).select("o_orderkey", "holes"), ["holes"])
    return d.withColumn("holes", F.round("holes", 4))


@query("fea08_outlier_flags", f"""with {I.CUSTOMER_OUTLIERS}, q as (select quantile_cont(c_acctbal, 0.25) q1, quantile_cont(c_acctbal, 0.75) q3 from customer_outliers)
  select c_custkey, c_nationkey, c_acctbal, (c_acctbal < q1 - 1.5 * (q3 - q1) or c_acctbal > q3 + 1.5 * (q3 - q1))::bigint as c_acctbal_outlier_flag from customer_outliers, q""")
def _(t):
    return impute.outlier_flags(I.customer_outliers(t).select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey", "c_acctbal"])


@query("fea09_binary_encoding", """select l_orderkey, l_linenumber, (case l_linestatus when 'F' then 0 else 1 end)::bigint as l_linestatus from lineitem""")
def _(t):
    return encode.encode_binary(t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus")


@query("fea10_onehot_encoding", """select o_orderkey, (s = 'F')::bigint as "s_F", (s = 'O')::bigint as "s_O", (s = 'P')::bigint as "s_P", (s = 'Unknown')::bigint as "s_Unknown"
  from (select o_orderkey, case when o_orderkey % 13 = 0 then 'Unknown' else o_orderstatus end as s from orders)""")
def _(t):
    d = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("s"))
    return encode.encode_onehot(d, "s", unknown="Unknown")


@query("fea11_label_encoding", """select p_partkey, (dense_rank() over (order by p_brand) - 1)::bigint as p_brand from part""")
def _(t):
    return encode.encode_label(t.part.select("p_partkey", "p_brand"), "p_brand")


@query("fea12_frequency_encoding", """select o_orderkey, round(count(*) over (partition by o_custkey) * 1.0 / (select count(*) from orders), 5) as o_custkey from orders""")
def _(t):
    return encode.encode_frequency(t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey")), "o_custkey")


@query("jon08_code_map", """select o_orderkey, coalesce(dense.code, 0) as code from orders left join (select p, row_number() over (order by p) as code from (select distinct o_orderpriority as p from orders where o_orderpriority <> '5-LOW')) dense on dense.p = orders.o_orderpriority""")
def _(t):
    codes = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("value")).distinct()
    from ..operators.ranks import number_rows
    return encode.apply_code_map(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", number_rows(codes, ["value"], "code")).select("o_orderkey", "code")


@query("fea13_text_features", f"""select doc_id, md5({squeeze_sql('lower(text)')}) as digest, length({squeeze_sql('lower(text)')})::bigint as text_length,
  len(regexp_extract_all({squeeze_sql('lower(text)')}, '{NWS}+'))::bigint as text_word_count,
  case when length(regexp_replace(text, '{WS}', '', 'g')) = 0 then 'unknown' else 'english' end as text_lang from documents""")
def _(t):
    d = textstats.text_features(t.spread("documents", "doc_id").select("doc_id", "text"), ["text"])
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text_length", "text_word_count", "text_lang")


@query("fea16_standard_scale", """with m as (select avg(l_quantity) a, stddev_pop(l_quantity) s, avg(l_extendedprice) b, stddev_pop(l_extendedprice) u from lineitem)
  select l_orderkey, l_linenumber, round((l_quantity - a) / s, 5) + 0.0 as l_quantity, round((l_extendedprice - b) / u, 5) + 0.0 as l_extendedprice from lineitem, m""")
def _(t):
    d = encode.standard_scale(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return d.select("l_orderkey", "l_linenumber", F.round("l_quantity", 5).alias("l_quantity"), F.round("l_extendedprice", 5).alias("l_extendedprice"))


@query("fea18_feature_matrix", """with m as (select quantile_cont(case when c_custkey % 5 = 0 then null else c_acctbal end, 0.5) a from customer)
  select c_custkey, round(coalesce(case when c_custkey % 5 = 0 then null else c_acctbal end, a), 4) as c_acctbal, c_nationkey::double as c_nationkey,
  (c_mktsegment = 'AUTOMOBILE')::bigint as automobile, (c_mktsegment = 'BUILDING')::bigint as building, 7::bigint as n_features from customer, m""")
def _(t):
    d = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    feats, _summary = encode.feature_matrix(d, ["c_custkey"])
    n = len(feats.columns) - 1
    return feats.select(F.col("_key_c_custkey").alias("c_custkey"), F.round("c_acctbal", 4).alias("c_acctbal"), "c_nationkey",
                        F.col("c_mktsegment_AUTOMOBILE").alias("automobile"), F.col("c_mktsegment_BUILDING").alias("building"), F.lit(n).cast("long").alias("n_features"))


@query("fea18_preparation_summary", """select 'c_custkey' as column_name, 'identifier' as used_as from (select count(*) n, count(distinct c_custkey) d from customer) where d >= 0.98 * n
  union all select 'c_name', 'identifier' from (select count(*) n, count(distinct c_name) d from customer) where d >= 0.98 * n
  union all select 'c_nationkey', 'numeric' union all select 'c_acctbal', 'numeric' union all select 'c_mktsegment', 'categorical'""")
def _(t):
    return encode.feature_matrix(t.customer, ["c_custkey"])[1].select("column_name", "used_as")


@query("fea19_align_new_rows", """select s_suppkey, coalesce(s_acctbal, 0.0) as c_acctbal, 0.0::double as "seg_A", (s_nationkey = 3)::int::double as "seg_3" from supplier""")
def _(t):
    d = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").cast("string").alias("seg"))
    return encode.align(d, {"c_acctbal": 0.0}, {"seg": ["A", "3"]}, ["s_suppkey"])


@query("fea20_embedding_pooling", """with f as (select label, vec_id, case when vec_id % 10 = 0 then list_transform(embedding, lambda x: 0.0::double) else list_transform(embedding, lambda x: x::double) end e from embeddings),
  x as (select vec_id, unnest(e) v, generate_subscripts(e, 1) i, list_aggregate(list_transform(e, lambda y: abs(y)), 'sum') z from f),
  m as (select i, avg(v) mv from x where z > 0 group by i)
  select vec_id, round(sum(case when z = 0 then mv else v end), 4) as total, round(max(case when z = 0 then mv else v end), 5) as top from x join m using (i) group by vec_id""")
def _(t):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    d = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 10 == 0, zero).otherwise(F.col("embedding").cast("array<double>")).alias("embedding"))
    d = vectorize.fill_zero_vectors(d, "embedding")
    return d.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("embedding"), 5).alias("top"))


TFIDF = f"""w as (select doc_id, regexp_extract_all(lower(text), '{TOKEN}') l from documents),
  g as (select doc_id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) term from w),
  tf as (select doc_id, term, count(*) c from g group by 1, 2), n as (select count(*) n from documents),
  df as (select term, sum(c) total, count(*) d from tf group by 1),
  v as (select term, d from df order by total desc, term limit 300),
  x as (select doc_id, term, (1 + ln(c)) * (ln((1.0 + n) / (1 + d)) + 1) w from tf join v using (term), n),
  z as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) w from x)"""


@query("fea14_tfidf_weights", f"""with {TFIDF} select doc_id, count(*) as terms, round(sum(w), 4) as total, round(max(w), 4) as top from z group by doc_id""")
def _(t):
    w = vectorize.tfidf(t.spread("documents", "doc_id"), "doc_id", "text", max_features=300)
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 4).alias("top"))


@query("fea14_tfidf_vocabulary", f"""with {TFIDF} select term, d as doc_count from v""")
def _(t):
    return vectorize.vocabulary(t.spread("documents", "doc_id"), "text", 300).select("term", "doc_count")


@query("fea15_truncated_svd")
def _(t):
    out, _share = vectorize.text_svd(t.spread("documents", "doc_id"), "doc_id", "text")
    return out


@query("fea17_pca")
def _(t):
    d = vectorize.array_columns(t.embeddings, "embedding", "e")
    cols = [c for c in d.columns if c.startswith("e_")]
    d = encode.standard_scale(d, cols)
    return vectorize.pca_fit(d, cols).transform(d, ["vec_id"])


@query("set04_feature_blocks", """select l_orderkey, l_linenumber, l_quantity as l_quantity, (l_returnflag = 'A')::bigint as "l_returnflag_A", (l_returnflag = 'N')::bigint as "l_returnflag_N",
  (l_returnflag = 'R')::bigint as "l_returnflag_R", (isodow(l_shipdate) - 1)::int as dow from lineitem""")
def _(t):
    d = encode.encode_onehot(t.lineitem, "l_returnflag")
    return d.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", F.weekday("l_shipdate").alias("dow"))

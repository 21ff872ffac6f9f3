"""Secrets in texts: strong patterns, and weak parts of credentials that complete each other.

Matches become intervals of code points. A weak part (an identifier, a key or an endpoint) is
reported only if a complementary part, weak or strong, lies in the same scope: identifier with
key, key with endpoint. Scopes are the stretches of a text between blank lines; `reach` can bound
the distance within a scope too. The interval join is a sweep over the sorted intervals of a scope, forwards
and backwards, so a text with many parts never pairs them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

# Patterns of the strong kinds and the least length that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more; a run cannot be cut shorter
HEX = r"[0-9a-f]{16,}"
# Weak kinds: the role's last group is the value.
IDENT = r"""(?i:\b(access[_-]?key[_-]?id|client[_-]?id|user(?:name)?|login|account(?:[_-]?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})"""
KEY = r"""(?i:\b(password|passwd|passphrase|pwd|pass|secret|token|api_?key|access[_-]?key|secret[_-]?(?:access[_-]?)?key|key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{5,})"""
ENDPOINT = r"""(?i:\b(https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://([^\s"'<>]+))"""
BLANK = r"()(\n[\x20\t\r]*\n)"
KINDS = [("assign", ASSIGN, "key", True), ("access", f"()({ACCESS})", "ident", True), ("hex", f"()({HEX})", "", True),
         ("ident", IDENT, "ident", False), ("key", KEY, "key", False), ("endpoint", ENDPOINT, "endpoint", False), ("blank", BLANK, "", False)]
ORDER = {k: i for i, (k, *_) in enumerate(KINDS)}


def _matches(text: Column, kind: str, pattern: str, wanted: Column) -> Column:
    """Array of (kind, no, skip, len, value): every match, the code points before it since the last one, its length and its value's."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), 2)
    gaps = F.split(text, pattern, -1)
    every = F.transform(F.arrays_zip(found.alias("f"), value.alias("v"), F.slice(gaps, 1, F.size(gaps) - 1).alias("g")),
                        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), F.length(x["g"]).alias("skip"), F.length(x["f"]).alias("len"), F.length(x["v"]).alias("value")))
    return F.when(wanted, every).otherwise(F.array().cast("array<struct<kind:string,no:int,skip:int,len:int,value:int>>"))


def spans(docs: DataFrame, id_col: str = "doc_id", reach: int | None = None) -> DataFrame:
    """(id_col, text_key, kind, start, stop, strong): reported intervals in code points, stop exclusive.

    Weak parts that overlap a strong interval are left out. Null and empty texts have none.
    """
    text = F.col("text").cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")).where("text is not null")
    flags = {f"has_{k}": F.col("text").rlike(p) for k, p, _, _ in KINDS[:-1]}
    d = d.withColumns(flags).where(" or ".join(flags))
    weak = F.expr("has_ident or has_key or has_endpoint")
    # the same text under the same id is searched once
    d = d.withColumn("m", F.concat(*[_matches(F.col("text"), k, p, weak if k == "blank" else F.col(f"has_{k}")) for k, p, _, _ in KINDS]))
    rows = cut_lineage(d.select("id", "text_key", F.inline("m")).distinct())
    own = ["id", "text_key"]
    upto = Window.partitionBy(*own, "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("skip") + F.col("len")).over(upto).cast("long")).withColumn("start", F.col("stop") - F.col("len"))
    rows = rows.where("kind <> 'assign' or value >= 12")
    role, strong = F.lit(""), F.lit(False)
    for k, _, r, s in KINDS:
        role, strong = F.when(F.col("kind") == k, r).otherwise(role), F.when(F.col("kind") == k, F.lit(s)).otherwise(strong)
    rows = rows.select("id", "text_key", "kind", role.alias("role"), strong.alias("strong"), "start", "stop")
    place = ["start", "stop", "kind"]
    ahead = Window.partitionBy(*own).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("scope", F.coalesce(F.count_if(F.col("kind") == "blank").over(ahead), F.lit(0)))
    scope = Window.partitionBy(*own, "scope")
    before = scope.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    after = scope.orderBy(*[F.col(c).desc() for c in place]).rowsBetween(Window.unboundedPreceding, -1)
    sees = {}
    for r in ("ident", "key", "endpoint"):
        near = F.when(F.col("role") == r, F.col("stop")), F.when(F.col("role") == r, F.col("start"))
        gaps = F.col("start") - F.max(near[0]).over(before), F.min(near[1]).over(after) - F.col("stop")
        close = [g.isNotNull() if reach is None else F.coalesce(g <= reach, F.lit(False)) for g in gaps]
        sees[f"near_{r}"] = close[0] | close[1]
    hard = F.when(F.col("strong"), F.col("stop")), F.when(F.col("strong"), F.col("start"))
    sees["covered"] = F.coalesce(F.max(hard[0]).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(hard[1]).over(after) < F.col("stop"), F.lit(False))
    rows = rows.withColumns(sees)
    linked = F.expr("(role in ('ident', 'endpoint') and near_key) or (role = 'key' and (near_ident or near_endpoint))")
    return rows.where(F.col("strong") | (linked & ~F.col("covered") & (F.col("kind") != "blank"))).select(F.col("id").alias(id_col), "text_key", "kind", "start", "stop", "strong")


def scan(docs: DataFrame, id_col: str = "doc_id", reach: int | None = None) -> DataFrame:
    """One row per row of `docs`: (id_col, found): array of (start, place of the kind, kind, stop,
    strong), in order. Empty for null, empty and clean texts; equal rows get equal results, null ids included;
    an empty table gives no rows."""
    found = spans(docs, id_col, reach)
    order = F.lit(0)
    for k, i in ORDER.items():
        order = F.when(F.col("kind") == k, i).otherwise(order)
    found = found.groupBy(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", order.alias("place"), "kind", "stop", "strong"))).alias("found"))
    every = docs.select(F.col(id_col), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    out = every.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select(id_col, F.coalesce("found", F.array().cast("array<struct<start:bigint,place:int,kind:string,stop:bigint,strong:boolean>>")).alias("found"))


def oracle() -> str:
    """The same in DuckDB."""
    q = lambda s: s.replace("'", "''")
    parts = " union all ".join(
        f"""select doc_id, '{k}' as kind, '{r}' as role, {str(s).lower()} as strong, {i} as place, regexp_extract_all(text, '{q(p)}', 0) as f, regexp_extract_all(text, '{q(p)}', 2) as v, string_split_regex(text, '{q(p)}') as g from documents where text is not null"""
        for i, (k, p, r, s) in enumerate(KINDS))
    one = lambda a, b: f"array_to_string(list_transform({a}, lambda x: x.kind || ':' || x.start || ':' || x.stop), ',') as {b}"
    return f"""with part as ({parts}),
row as (select doc_id, kind, role, strong, place, unnest(range(1, len(f) + 1)) as no, f, v, g from part where len(f) > 0),
pos as (select doc_id, kind, role, strong, place, length(f[no]) as n, length(v[no]) as value, sum(length(g[no]) + length(f[no])) over (partition by doc_id, kind order by no) as stop from row),
seen as (select *, stop - n as start from pos where kind <> 'assign' or value >= 12),
sc as (select a.*, (select count(*) from seen b where b.doc_id = a.doc_id and b.kind = 'blank' and (b.start, b.stop, b.kind) < (a.start, a.stop, a.kind)) as scope from seen a),
kept as (select a.* from sc a where strong or (kind <> 'blank'
  and not exists (select 1 from sc b where b.doc_id = a.doc_id and b.scope = a.scope and b.strong and b.start < a.stop and a.start < b.stop)
  and exists (select 1 from sc b where b.doc_id = a.doc_id and b.scope = a.scope and (b.start, b.stop, b.kind) <> (a.start, a.stop, a.kind)
    and ((a.role in ('ident', 'endpoint') and b.role = 'key') or (a.role = 'key' and b.role in ('ident', 'endpoint')))))),
agg as (select doc_id, list({{'kind': kind, 'start': start, 'stop': stop, 'strong': strong}} order by start, place) as l from kept group by 1),
every as (select doc_id, coalesce(l, []) as l from documents left join agg using (doc_id))
select doc_id, len(list_filter(l, lambda x: x.kind = 'assign')) as n_assign, len(list_filter(l, lambda x: x.kind = 'access')) as n_access, len(list_filter(l, lambda x: x.kind = 'hex')) as n_hex,
 sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans from (select *, {one("list_filter(l, lambda x: x.strong)", "b")}, {one("l", "s")} from every)"""

"""Registered queries of this subpackage, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fim, hosts, hpylm, language, lines, maxscore, pieces, pii, radix, secrets, simhash, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def fold_of(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


@query("op1_simhash")
def _(t):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(t("documents")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_url_filter", hosts.oracle())
def _(t):
    """Verdict on every page's url."""
    return hosts.judge(t("pages"))


@query("op3_sentencepiece")
def _(t):
    """Token counts and digests of ids and decoded texts."""
    out = pieces.encode_documents(t("documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.element_at("ends", -1), F.lit(0)).cast("long").alias("span_bytes"))


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({FOLD}, '{WORDS}') as w from documents),
i as (select row_number() over () as q, item_id, regexp_extract_all({FOLD}, '{WORDS}') as w from benchmark),
iw as (select q, item_id, unnest(w) as x, generate_subscripts(w, 1) as p from i),
il as (select item_id, count(*) over (partition by q) as n, list(x) over (partition by q order by p rows between current row and 12 following) as l from iw),
win as (select distinct item_id, least(13, n) as n, array_to_string(l[1:least(13, n)], ' ') as g from il where len(l) >= least(13, n)),
size as (select distinct n from win),
dw as (select r, unnest(w) as x, generate_subscripts(w, 1) as p from d),
dl as (select r, p, list(x) over (partition by r order by p rows between current row and 12 following) as l from dw),
gram as (select r, n, p, array_to_string(l[1:n], ' ') as g from dl, size where len(l) >= n),
hit as (select r, item_id, p, n from gram join win using (n, g)),
place as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from hit)) group by 1),
item as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join place using (r) left join item using (r)"""


@query("op4_decontamination", OP4_SQL)
def _(t):
    """Benchmark words in every document."""
    out = winnow.contamination(t("documents"), t("benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_ann")
def _(t):
    """Ten nearest embeddings of every hundredth one."""
    rows = t("embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


@query("op6_pii")
def _(t):
    """Personal data in every document."""
    docs = t("documents")
    out = pii.find(docs, pii.fit(docs, F.col("doc_id")))
    text = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query("op7_secrets", secrets.oracle())
def _(t):
    """Secrets in every document."""
    out = secrets.scan(t("documents"))
    text = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                      F.sha2(text(F.filter("found", lambda x: x["strong"])), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


OP8_SQL = r"""with raw as (select doc_id, text, string_split(text, chr(10)) as l from documents),
line as (select doc_id, i, l[i] as x, len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) as n from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from raw)),
seq as (select *, row_number() over (partition by doc_id order by i) as no, sum(n) over (partition by doc_id order by i) as upto from line where n > 0),
ahead as (select a.doc_id, a.no as b, min(z.no) as e from seq a join seq z on a.doc_id = z.doc_id and z.no >= a.no and z.upto - a.upto + a.n >= 50 group by all),
back as (select z.doc_id, max(a.no) as b, z.no as e from seq a join seq z on a.doc_id = z.doc_id and z.no >= a.no and z.upto - a.upto + a.n >= 50 group by all),
run as (select distinct * from (select * from ahead union all select * from back)),
body as (select run.doc_id, b, e, string_agg(x, chr(10) order by no) as g from run join seq on run.doc_id = seq.doc_id and no between b and e group by all),
late as (select doc_id, b, e from (select *, row_number() over (partition by g order by doc_id, b) as r from body) where r > 1),
gone as (select distinct late.doc_id, no from late join seq on late.doc_id = seq.doc_id and no between b and e),
kept as (select line.doc_id, string_agg(x, chr(10) order by line.i) as t from line left join (select seq.doc_id, i from gone join seq using (doc_id, no)) q on q.doc_id = line.doc_id and q.i = line.i where q.i is null group by 1),
count_of as (select doc_id, count(*) as n_removed from gone group by 1),
total as (select doc_id, count(*) as n_lines from seq group by 1)
select raw.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(case when raw.text is null then null else coalesce(t, '') end) as kept_sha256
from raw left join kept using (doc_id) left join count_of using (doc_id) left join total using (doc_id)"""


@query("op8_line_dedup", OP8_SQL)
def _(t):
    """Lines removed from every document, and the digest of what is left."""
    out = lines.delete_repeats(t("documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_hpylm")
def _(t):
    """Scores of every document under the unigram base and the hierarchical model."""
    return hpylm.score(t("documents"), fold_of(F.col("doc_id"), 5) != 1).drop("perplexity")


@query("op10_language")
def _(t):
    """Predicted language of every document."""
    docs = t("documents")
    held = fold_of(F.col("doc_id"), 4) == 2
    out = language.identify(docs, ~held)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


OP11_SQL = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({FOLD}, '{WORDS}') as w from documents),
i as (select row_number() over () as q, item_id, regexp_extract_all({FOLD}, '{WORDS}') as w from (select distinct item_id, text from benchmark)),
tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by all),
one as (select r, doc_id, len(w) as n from d where len(w) > 0),
s as (select count(*) as n_all, sum(n) as l_all from one),
df as (select t, count(*) as df from tf group by 1),
ask as (select q, item_id, t, count(*) as c from (select q, item_id, unnest(w) as t from i) group by all),
wt as (select t, cast(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) as bigint) as w from df, s where t in (select t from ask)),
m as (select r, doc_id, cast(100 - 25 + (25 * n * n_all) // l_all as bigint) as m from one, s),
score as (select q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as score
          from ask join wt using (t) join tf using (t) join m using (r) group by all),
best as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from score where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from best where rank <= 20"""


@query("op11_pair_maxscore", OP11_SQL)
def _(t):
    """The twenty best documents for every benchmark item."""
    return maxscore.search(t("documents"), t("benchmark"))


OP12_SQL = """with d as (select row_number() over () as r, doc_id, hex(coalesce(text, '')) as h from documents),
one as (select r, doc_id, h, length(h) // 2 as n from d),
part as (select r, doc_id, c * 1000 as base, least(1000, n - 49 - c * 1000) as m, substr(h, 2000 * c + 1, 2098) as g
         from (select *, unnest(range(0, (n - 50) // 1000 + 1)) as c from one where n >= 50)),
win as (select r, doc_id, base + j as p, substr(g, 2 * j + 1, 100) as w from (select *, unnest(range(0, m)) as j from part)),
low as (select w, min(doc_id) as f from win group by 1 having count(*) > 1 and min(doc_id) is not null),
hit as (select r, p from win join low using (w) where doc_id is null or doc_id > f),
step as (select r, p, case when p > lag(p) over (partition by r order by p) + 50 then 1 else 0 end as b from hit),
isle as (select r, p, sum(b) over (partition by r order by p) as i from step),
gone as (select r, i, min(p) as a, max(p) + 50 as z from isle group by all),
gap as (select r, coalesce(lag(z) over (partition by r order by a), 0) as f, a as t from gone
        union all select r, max(z), any_value(n) from gone join one using (r) group by r),
kept as (select r, coalesce(string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' order by f), '') as k from gap join one using (r) group by r),
sums as (select r, sum(z - a) as n_removed, count(*) as n_spans from gone group by r)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from one left join kept using (r) left join sums using (r)"""


@query("op12_radix_dedup", OP12_SQL)
def _(t):
    """Bytes removed from every document, and the digest of the rest."""
    out = radix.cut_repeats(t("documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "kept_sha256")


OP13_SQL = """with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
h as (select *, cast('0x' || substr(s, 1, 8) as bigint) % (n + 1) as h1, cast('0x' || substr(s, 9, 8) as bigint) % (n + 1) as h2,
             cast('0x' || substr(s, 17, 8) as bigint) % 100 as h3, cast('0x' || substr(s, 25, 8) as bigint) % 100 as h4 from d),
f as (select *, least(h1, h2) as a, greatest(h1, h2) as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from f)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256 from p"""


@query("op13_fill_in_middle", OP13_SQL)
def _(t):
    """Form, cuts and digests of every document's fill-in-the-middle output and of the text rebuilt from it."""
    out = fim.restore(fim.transform(t("documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"))
    return out.drop("output", "restored")

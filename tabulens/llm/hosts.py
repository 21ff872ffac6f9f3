"""URL verdicts from rules, and from trust that flows over the host graph.

Rules judge the urls they fit. For all others the host decides: trust starts at hosts of which
more than half of the pages are allowed by rules and follows links (a linked host gains);
distrust starts at hosts of which more than half are blocked and follows links backwards (who
links to a blocked host loses). Both are personalised PageRanks. A host is blocked if its
distrust exceeds its trust; a host that neither reaches is allowed.

Ranks are whole numbers (76 binary digits of mass that pass on as `rank * w div all_w`, however heavy
a host's links are), so sums do not depend on their order and every run gives the same verdicts.
Rounds go on until `LATER` rounds after the last host was reached, and for at least `ROUNDS`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Fixed values: (host, path start, verdict). A rule fits its host and all subdomains.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ROUNDS, LATER = 20, 8
MASS = 1 << 76  # times the weight of a host's links (up to 2^40) it fits decimal(38,0)
SHOWN = 1 << 36  # ranks are shown in units of so much
BROADCAST_HOSTS = 500_000  # ranked hosts that are looked up by broadcast at most
FOLLOW = 217  # of 256: how much of a rank is passed on
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)[\x20\t\r\n]*=[\x20\t\r\n]*["']?[\x20\t\r\n]*(?:https?:)?//([^/?#"'<>\x20\t\r\n]+)"""


def fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for a url without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return fold(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts. A page counts once for each host it links to."""
    raw = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), fold))).alias("dst"))
    pairs = cut_lineage(raw.where("dst <> src").groupBy("src", "dst").agg(F.count("*").alias("w")))
    return pairs


def whole(c: Column | int) -> Column:
    return (F.lit(str(c)) if isinstance(c, int) else c).cast("decimal(38,0)")


def quotient(a: Column, b: Column) -> Column:
    """a div b of whole decimals (`div` itself gives a bigint)."""
    return whole((a - a % b) / b)


def propagate(links: DataFrame, trusted: DataFrame, blocked: DataFrame, rounds: int = ROUNDS, later: int = LATER) -> DataFrame:
    """(host, trust, distrust, distrusted) of every host that either reaches. links: (src, dst, w).

    `distrusted` compares whole ranks; trust and distrust are shown in units of 2^-40 of the mass."""
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "w"))
    out = both.groupBy("kind", "host").agg(F.sum("w").alias("all_w"))
    share = cut_lineage(both.join(out, ["kind", "host"]).select("kind", "host", "to", "w", "all_w"))
    seeds = cut_lineage(trusted.select(F.lit("trust").alias("kind"), "host").unionByName(blocked.select(F.lit("distrust").alias("kind"), "host")))
    n = {r["kind"]: max(1, r["n"]) for r in seeds.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows
    start = seeds.select("kind", "host", F.when(F.col("kind") == "trust", whole(MASS // n.get("trust", 1))).otherwise(whole(MASS // n.get("distrust", 1))).alias("rank"))
    again = start.select("kind", "host", quotient(F.col("rank") * (256 - FOLLOW), whole(256)).alias("rank"))
    rank, reached, last, k = start, seeds.count(), 0, 0
    passed = quotient(F.col("rank") * (F.col("w") * FOLLOW), whole(F.col("all_w") * 256))
    while not share.isEmpty() and k < max(rounds, last + later):
        flow = rank.join(share, ["kind", "host"]).select("kind", F.col("to").alias("host"), passed.alias("rank"))
        # a rank of 0 still marks a host as reached
        rank = flow.unionByName(again).groupBy("kind", "host").agg(F.sum("rank").cast("decimal(38,0)").alias("rank"))
        k += 1
        if k % 4 == 0 or k > rounds - later:
            rank = cut_lineage(rank)
            now = rank.count()
            reached, last = now, (k if now > reached else last)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), whole(0))
    shown = lambda kind: quotient(of(kind).cast("decimal(38,0)"), whole(SHOWN)).cast("long")
    return rank.groupBy("host").agg(shown("trust").alias("trust"), shown("distrust").alias("distrust"), (of("distrust") > of("trust")).alias("distrusted"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of `pages`.

    Null urls and urls without `://` have an empty host and path, fit no rule and are allowed.
    Null html has no links. Repeated rows are judged alike and weigh twice. Tables without rows
    or links give the rules' verdicts and `allow` elsewhere.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": rule, "ruled": verdict})
    tally = cut_lineage(ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    ranks = propagate(edges(base), tally.where("2 * good > n").select("host"), tally.where("2 * bad > n").select("host"), rounds)
    ranks = cut_lineage(ranks)
    if ranks.count() <= BROADCAST_HOSTS:  # then pages of a hot host need not meet in one task
        ranks = F.broadcast(ranks)
    out = ruled.drop("html").join(ranks, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("distrusted"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                      F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def oracle() -> str:
    """The same in DuckDB, with the rounds written out."""
    up, lo = string.ascii_uppercase, string.ascii_lowercase
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h + p}'" for h, p, _ in longest) + " end"
    ruled = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in longest) + " end"
    link = LINK.replace("'", "''")
    return f"""with recursive base as (select page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{up}', '{lo}') as host, regexp_extract(coalesce(url, ''), '{URL}', 2) as path, html from pages),
ruled as (select *, {rule} as rule, {ruled} as ruled from base),
tally as (select host, count(*) as n, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad from ruled where host <> '' group by 1),
links as (select host as src, dst, count(*) as w from (select host, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: translate(x, '{up}', '{lo}')))) as dst from base where host <> '') where dst <> host group by all),
directed as (select 'trust' as kind, src as host, dst, w from links union all select 'distrust', dst, src, w from links),
share as materialized (select kind, host, dst, cast(w as hugeint) as w, cast(sum(w) over (partition by kind, host) as hugeint) as all_w from directed),
seed as (select 'trust' as kind, host from tally where 2 * good > n union all select 'distrust', host from tally where 2 * bad > n),
r0 as materialized (select kind, host, cast({MASS} as hugeint) // count(*) over (partition by kind) as rank from seed),
hop(kind, host, h) using key (kind, host) as (select kind, host, 0 from seed union select share.kind, share.dst, min(hop.h) + 1 from hop join share using (kind, host)
  where not exists (select 1 from recurring.hop o where o.kind = share.kind and o.host = share.dst) group by share.kind, share.dst),
rounds as (select case when exists (select 1 from share) then greatest({ROUNDS}, coalesce(max(h), 0) + {LATER}) else 0 end as n from hop),
r(kind, host, rank, k) as (select kind, host, rank, 0 from r0 union all
  select kind, host, cast(sum(rank) as hugeint), k from (
    select share.kind, share.dst as host, (r.rank * (share.w * {FOLLOW})) // (share.all_w * 256) as rank, r.k + 1 as k from r join share on r.kind = share.kind and r.host = share.host
    union all select r0.kind, r0.host, (r0.rank * {256 - FOLLOW}) // 256, c.k + 1 from r0, (select max(k) as k from r) c) where k <= (select n from rounds) group by kind, host, k),
ranks as (select host, coalesce(sum(rank) filter (kind = 'trust'), 0) as trust, coalesce(sum(rank) filter (kind = 'distrust'), 0) as distrust from r where k = (select n from rounds) group by 1)
select page_id, host, path, rule, coalesce(ruled, case when distrust > trust then 'block' else 'allow' end) as verdict,
 cast(coalesce(trust // {SHOWN}, 0) as bigint) as trust, cast(coalesce(distrust // {SHOWN}, 0) as bigint) as distrust from ruled left join ranks using (host)"""

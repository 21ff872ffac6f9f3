"""One-row-per-column profile and the reports read from it.

All statistics of all columns come from a handful of wide aggregates (columns are handled
in chunks to stay inside code generation); only the profile rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.scalars import band, finite, parse_number
from .quantiles import SMALL_ROWS, exact_quantiles

CHUNK = 60

PROFILE = T.StructType(
    [T.StructField("ordinal", T.LongType()), T.StructField("column_name", T.StringType()),
     T.StructField("kind", T.StringType()), T.StructField("n_rows", T.LongType()),
     T.StructField("null_count", T.LongType()), T.StructField("null_pct", T.DoubleType()),
     T.StructField("n_unique", T.LongType()), T.StructField("has_arabic", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in
       ("min", "max", "mean", "median", "std", "skew", "skew_g1", "kurtosis", "q1", "q3", "iqr")]
    + [T.StructField("outlier_count", T.LongType()), T.StructField("extreme_count", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in
       ("avg_length", "avg_words", "numeric_share", "integer_share", "date_share")])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)]


def kind_of(field: T.StructField) -> str:
    t = field.dataType
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(t, T.NumericType):
        return "int"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "other"


def _chunks(items: Sequence, size: int = CHUNK):
    for i in range(0, len(items), size):
        yield items[i:i + size]


def collect_aggs(df: DataFrame, aggs: list[Column], names: list[str]) -> dict:
    """Run many named aggregates in a few wide passes."""
    out: dict = {}
    pairs = list(zip(aggs, names))
    for part in _chunks(pairs, 3 * CHUNK):
        out.update(df.agg(*[a.alias(n) for a, n in part]).first().asDict())
    return out


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Distinct counts by 128 bits of hash: one pass for all columns, long values never travel, and partial
    aggregation removes repeats before the shuffle."""
    cols = list(cols)
    if not cols:
        return {}
    item = lambda i, c: F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(i + 1), c).alias("b")))
    items = F.array_compact(F.array(*[item(i, F.col(f"`{c}`")) for i, c in enumerate(cols)]))
    found = df.select(F.inline(items)).distinct().groupBy("i").agg(F.count("*").alias("n"))
    n = {r["i"]: r["n"] for r in found.collect()}  # one row per column
    return {c: n.get(i, 0) for i, c in enumerate(cols)}


def g1_to_bias_corrected(g1: Column, n: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None,
                   small_rows: int = SMALL_ROWS) -> DataFrame:
    """Profile rows for the given columns (all by default). `skew` is the bias-corrected
    coefficient, `skew_g1` the population one; text that is 95% numeric is measured as numbers."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    kinds = {f.name: kind_of(f) for f in fields}
    cells, names = [F.count(F.lit(1))], ["n"]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        cells.append(F.count(finite(c) if kinds[f.name] == "float" else c)); names.append(f"c{i}")
        if kinds[f.name] == "string":
            num, ts = parse_number(c), c.try_cast("timestamp")
            cells += [F.bool_or(X.has_arabic(c)), F.avg(F.length(c)), F.avg(X.word_count(c)),
                      F.count(num), F.count_if(num % 1 == 0),
                      F.count_if(F.year(ts).between(1900, 2100))]
            names += [f"{k}{i}" for k in ("ar", "len", "wc", "num", "int", "ts")]
    base = collect_aggs(df, cells, names)
    distinct = distinct_counts(df, [f.name for f in fields if kinds[f.name] != "other"])

    numbers = {}
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        if kinds[f.name] in ("int", "float"):
            numbers[i] = finite(c.cast("double"))
        elif kinds[f.name] == "string" and base[f"c{i}"] and base[f"num{i}"] >= 0.95 * base[f"c{i}"]:
            numbers[i] = parse_number(c)
    stats: dict = {}
    quart: dict = {}
    if numbers:
        flat = df.select(*[c.alias(f"v{i}") for i, c in numbers.items()])
        cells, names = [], []
        for i in numbers:
            v = F.col(f"v{i}")
            cells += [F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), F.skewness(v), F.kurtosis(v)]
            names += [f"{k}{i}" for k in ("vc", "mn", "mx", "av", "sd", "sk", "ku")]
        stats = collect_aggs(flat, cells, names)
        quart = exact_quantiles(flat, [f"v{i}" for i in numbers], [0.25, 0.5, 0.75], small_rows)
        cells, names = [], []
        for i in numbers:
            q1, _, q3 = quart[f"v{i}"]
            if q1 is None:
                continue
            v, w = F.col(f"v{i}"), q3 - q1
            cells += [F.count_if((v < q1 - 1.5 * w) | (v > q3 + 1.5 * w)),
                      F.count_if((v < q1 - 3 * w) | (v > q3 + 3 * w))]
            names += [f"out{i}", f"ext{i}"]
        if cells:
            stats.update(collect_aggs(flat, cells, names))

    rows = []
    n = base["n"]
    for i, f in enumerate(fields):
        cnt = base[f"c{i}"]
        row = dict.fromkeys(PROFILE.names)
        row.update(ordinal=i, column_name=f.name, kind=kinds[f.name], n_rows=n, null_count=n - cnt,
                   null_pct=100.0 * (n - cnt) / n if n else 0.0, n_unique=distinct.get(f.name),
                   has_arabic=bool(base.get(f"ar{i}")))
        if kinds[f.name] == "string" and cnt:
            row.update(avg_length=base[f"len{i}"], avg_words=base[f"wc{i}"],
                       numeric_share=base[f"num{i}"] / cnt, date_share=base[f"ts{i}"] / cnt,
                       integer_share=base[f"int{i}"] / base[f"num{i}"] if base[f"num{i}"] else 0.0)
        if i in numbers and stats.get(f"vc{i}"):
            q1, med, q3 = quart[f"v{i}"]
            vc, g1 = stats[f"vc{i}"], stats[f"sk{i}"]
            skew = g1 * (vc * (vc - 1)) ** 0.5 / (vc - 2) if g1 is not None and vc > 2 else None
            row.update(min=stats[f"mn{i}"], max=stats[f"mx{i}"], mean=stats[f"av{i}"], median=med,
                       std=stats[f"sd{i}"], skew=skew, skew_g1=g1, kurtosis=stats[f"ku{i}"],
                       q1=q1, q3=q3, iqr=q3 - q1,
                       outlier_count=stats[f"out{i}"], extreme_count=stats[f"ext{i}"])
        rows.append(tuple(row[k] for k in PROFILE.names))
    return df.sparkSession.createDataFrame(rows, PROFILE)


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Values by falling count, ties by value."""
    out = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
           .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value"))
    return out if k is None else out.limit(k)


def top_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, top_value, top_count): most frequent value per column in one shuffle."""
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols]
    counts = (df.select(F.inline(F.array(*items))).where("v is not null")
              .groupBy("column_name", "v").agg(F.count("*").alias("c")))
    return counts.groupBy("column_name").agg(
        F.min(F.struct((-F.col("c")).alias("neg"), F.col("v"))).alias("m")).select(
        "column_name", F.col("m.v").alias("top_value"), (-F.col("m.neg")).alias("top_count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, duplicates (NULLs compare equal)."""
    per_row = df.groupBy(*df.columns).agg(F.count("*").alias("_c"))
    return per_row.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"),
                       F.count("*").alias("n_distinct"),
                       F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def readiness(df: DataFrame, label: str = "initial") -> DataFrame:
    """One row: status and counts of the readiness check."""
    miss = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    one = df.agg(F.count("*").alias("n_rows"), F.array(*miss).alias("m"))
    shares = F.transform("m", lambda x: x / F.col("n_rows"))
    names = F.array(*[F.lit(c) for c in df.columns])
    pick = lambda keep: F.transform(F.filter(F.zip_with(names, shares, lambda n, s: F.struct(n.alias("n"), s.alias("s"))),
                                             keep), lambda z: z["n"])
    dup = duplicate_rows(df).select("n_duplicates")
    one = one.select(
        F.lit(label).alias("label"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.array_max(shares).alias("max_missing"),
        F.array_join(pick(lambda z: z["s"] > 0.6), ",").alias("high_missing_cols"),
        F.array_join(pick(lambda z: z["s"] == 1.0), ",").alias("empty_cols"))
    # both sides are a single row
    both = one.join(F.broadcast(dup), F.lit(True))
    return both.select(
        "label", F.when((F.col("max_missing") > 0.15) | (F.col("n_rows") < 30), "WARNING").otherwise("OK").alias("status"),
        "n_rows", "n_cols", "n_duplicates", F.round("max_missing", 4).alias("max_missing_ratio"),
        "high_missing_cols", "empty_cols",
        ((F.col("max_missing") > 0.15).cast("int") + (F.col("n_rows") < 30).cast("int")
         + (F.col("empty_cols") != "").cast("int")
         + (F.col("n_duplicates") > F.col("n_rows") * 0.1).cast("int")).cast("long").alias("n_warnings"))


def integrity_score(df: DataFrame) -> DataFrame:
    """max(0, round(100 - 2 missing% - [duplicates])) and its band."""
    cells = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    one = df.agg(F.count("*").alias("n_rows"), cells.alias("n_missing"))
    both = one.join(F.broadcast(duplicate_rows(df).select("n_duplicates")), F.lit(True))  # 1 x 1 rows
    miss = F.round(100.0 * F.col("n_missing") / (F.col("n_rows") * len(df.columns)), 1)
    score = F.greatest(F.lit(0.0), F.round(100 - miss * 2 - (F.col("n_duplicates") > 0).cast("int")))
    return both.select("n_rows", "n_missing", "n_duplicates", miss.alias("missing_pct"),
                       score.cast("long").alias("quality"),
                       band(score, [(85, "high"), (60, "acceptable")], "low").alias("band"))


def quality_issues(profile: DataFrame, important: DataFrame | None = None) -> DataFrame:
    """Data-quality issues per column, important columns first.

    `important` is a feature table with column `feature` (at most the top 15 rows count).
    """
    miss = F.round(F.col("null_pct"), 2)
    n = F.col("n_rows") - F.col("null_count")
    numeric = F.col("kind").isin("int", "float") & (n >= 5)
    ext = F.round(100.0 * F.col("extreme_count") / n, 2)
    issue = lambda cond, kind, sev, val: F.when(
        cond, F.struct(F.lit(kind).alias("issue_type"), sev.alias("severity"), val.alias("value")))
    moving = numeric & (F.col("std") > 0)
    found = F.array(
        issue(miss > 20, "high_missingness", F.when(miss > 50, "high").otherwise("medium"), miss),
        issue(numeric & (F.col("std") == 0), "zero_variance", F.lit("medium"), F.lit(0.0)),
        issue(moving & (F.abs("skew") > 3), "extreme_skewness", F.lit("medium"), F.round("skew", 2)),
        issue(moving & (F.col("iqr") > 0) & (ext > 3), "outlier_concentration",
              F.when(ext > 10, "high").otherwise("medium"), ext))
    rows = profile.select("ordinal", "column_name", F.inline(F.filter(found, lambda x: x.isNotNull())))
    if important is None:
        rows = rows.withColumn("impact", F.lit("low"))
    else:
        # feature tables hold one row per column of the data
        keys = F.broadcast(important.select(F.col("feature").alias("column_name"), F.lit("high").alias("_i")))
        rows = rows.join(keys, "column_name", "left").withColumn("impact", F.coalesce("_i", F.lit("low"))).drop("_i")
    return rows

"""Cleaning projections and filters. Each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.scalars import finite
from .profile import top_share


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def standardize_missing(df: DataFrame) -> DataFrame:
    """Missing-value words in text columns become NULL."""
    return df.withColumns({c: X.null_missing(F.col(c)) for c in string_columns(df)})


def missing_token_counts(df: DataFrame) -> DataFrame:
    """(column_name, cells): cells per text column that hold a missing-value word."""
    cols = string_columns(df)
    one = df.agg(*[F.count_if(F.col(c).isNotNull() & X.is_missing_token(F.col(c))).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cells"))
                                         for c in cols])))


def clean_names(names: Sequence[str]) -> list[str]:
    """Trimmed column names, `unnamed_column` for empty ones."""
    return [n.strip() or "unnamed_column" for n in names]


def clean_header(df: DataFrame) -> DataFrame:
    """Trim names and drop later columns that repeat a name."""
    names = clean_names(df.columns)
    tmp = df.toDF(*[f"_{i}" for i in range(len(names))])
    keep = {}
    for i, n in enumerate(names):
        keep.setdefault(n, i)
    return tmp.select(*[F.col(f"_{i}").alias(n) for n, i in keep.items()])


def low_quality(df: DataFrame, typed: DataFrame, target: str | None = None) -> DataFrame:
    """(column_name, action, reason) for columns to drop or flag."""
    cols = [c for c in df.columns if c != target]
    filled = F.col("n_rows") - F.col("null_count")
    miss = F.col("null_count") / F.col("n_rows")
    tops = top_share(df, cols)
    # both tables hold one row per column
    d = typed.where(F.col("column_name").isin(cols)).join(F.broadcast(tops), "column_name", "left")
    near = (F.col("n_unique") >= 2) & (filled > 10) & (F.col("top_count") >= 0.99 * filled)
    unique = (~F.col("col_type").isin("id", "text", "datetime") & (filled > 20)
              & (F.col("n_unique") / filled > 0.95))
    note = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    notes = (F.when(miss == 1.0, F.array(note("drop", "all_empty")))
             .when(miss >= 0.90, F.array(note("drop", "extreme_missing")))
             .when(F.col("n_unique") == 1, F.array(note("drop", "constant")))
             .otherwise(F.filter(F.array(F.when(near, note("flag", "near_constant")),
                                         F.when(unique, note("flag", "high_uniqueness"))),
                                 lambda x: x.isNotNull())))
    return d.select("column_name", F.inline(notes))


def sparse_columns(profile: DataFrame, target: str | None = None, limit: float = 0.60) -> DataFrame:
    d = profile.where(F.col("null_count") / F.col("n_rows") > limit)
    return (d if target is None else d.where(F.col("column_name") != target)).select("column_name")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & (X.strip(F.col(c).cast("string")) != "")
    return df.where(cond)


def keep_common_classes(df: DataFrame, label: str, text: str | None = None, least: int = 3) -> DataFrame:
    """Rows whose class has at least `least` rows (or distinct texts, when `text` is given)."""
    size = F.count("*") if text is None else F.count_distinct(text)
    good = df.groupBy(label).agg(size.alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(good, label, "left_semi")


def finite_or_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in cols})


def search(df: DataFrame, term: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows where any of the fields contains the term, ignoring case."""
    cells = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in (cols or df.columns)]
    return df.where(F.exists(F.array(*cells), lambda x: F.contains(x, F.lit(term.lower()))))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Row limit on ordered input; 0 means all rows."""
    return df.orderBy(*order) if n == 0 else df.orderBy(*order).limit(n)


def preview(df: DataFrame, key: Sequence[str], n: int = 8, max_cols: int = 12) -> DataFrame:
    cols = df.columns[:max_cols]
    return first_rows(df, key, n).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in cols])


def mixed_order(col: str, descending: bool = False) -> list[Column]:
    """Total order for mixed text: numbers first by value, then text without case."""
    num, txt = F.col(col).try_cast("double"), F.lower(F.col(col))
    if descending:
        return [num.desc_nulls_last(), txt.desc()]
    return [num.asc_nulls_last(), txt.asc()]


def repeated_ids(df: DataFrame, col: str) -> DataFrame:
    """(column_name, repeated_values, rows_involved) for one identifier column."""
    per = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("c")).where("c > 1")
    return per.agg(F.lit(col).alias("column_name"), F.count("*").alias("repeated_values"),
                   F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("rows_involved"))

"""Categorical encodings, scaling and feature preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from .column_types import infer_types, is_cluster_identifier
from .profile import collect_aggs, column_profile, numeric_columns
from .quantiles import SMALL_ROWS, exact_quantiles

MAX_LEVELS = 50


def levels(df: DataFrame, col: str, most: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct values of a small categorical column (refuses larger ones)."""
    rows = (df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("v")).distinct()
            .limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} levels; use frequency encoding")
    return sorted(r["v"] for r in rows)


def code_of(col: str, values: Sequence[str]):
    """Position of a value in a fixed level list; unseen and NULL give 0."""
    pos = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col).cast("string"))
    return F.greatest(F.coalesce(pos, F.lit(0)) - 1, F.lit(0)).cast("long")


def encode_binary(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, code_of(col, levels(df, col, 2)))


def encode_label(df: DataFrame, col: str, most: int = MAX_LEVELS) -> DataFrame:
    return df.withColumn(col, code_of(col, levels(df, col, most)))


def encode_onehot(df: DataFrame, col: str, most: int = 10, unknown: str | None = None,
                  values: Sequence[str] | None = None) -> DataFrame:
    """0/1 column per level. With `unknown`, NULL becomes its own level."""
    c = F.col(col).cast("string")
    if unknown is not None:
        df = df.withColumn(col, F.coalesce(c, F.lit(unknown)))
        c = F.col(col)
    values = levels(df, col, most) if values is None else values
    return df.withColumns({f"{col}_{v}": F.coalesce((c == v).cast("long"), F.lit(0)) for v in values}).drop(col)


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    n = df.where(F.col(col).isNotNull()).count()
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_w"))
            .withColumn("_freq", F.round(F.col("_w") / F.lit(n), 5)))


def encode_frequency(df: DataFrame, col: str, table: DataFrame | None = None) -> DataFrame:
    """Share of the value among non-null rows; unseen values give 0. The table has one row
    per distinct value, so it is joined by shuffle or broadcast as its size allows (AQE)."""
    table = frequency_table(df, col) if table is None else table
    return (df.join(table.select(col, "_freq"), col, "left")
            .withColumn(col, F.coalesce("_freq", F.lit(0.0))).drop("_freq").select(*df.columns))


def apply_code_map(df: DataFrame, col: str, mapping: DataFrame, most: int = 100_000) -> DataFrame:
    """Look-up encoding from a (value, code) table, unseen 0. Broadcast only when the table is small."""
    small = mapping.limit(most + 1).count() <= most
    side = F.broadcast(mapping) if small else mapping
    return (df.join(side.select(F.col("value").alias(col), "code"), col, "left")
            .withColumn("code", F.coalesce("code", F.lit(0))))


def encoding_strategy(n_unique: int) -> str:
    return ("binary" if n_unique <= 2 else "onehot" if n_unique <= 10
            else "label" if n_unique <= 50 else "frequency")


def auto_encode(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Encode every listed column by its number of levels."""
    for col, n in counts.items():
        how = encoding_strategy(n)
        df = {"binary": encode_binary, "onehot": encode_onehot, "label": encode_label,
              "frequency": encode_frequency}[how](df, col)
    return df


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, one pass."""
    row = collect_aggs(df, [x for c in cols for x in (F.avg(c), F.stddev_pop(c))],
                       [x for i in range(len(cols)) for x in (f"m{i}", f"s{i}")])
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, cols: Sequence[str], fitted: dict | None = None) -> DataFrame:
    """(x - mean) / population std; constant columns give 0."""
    fitted = moments(df, cols) if fitted is None else fitted
    return df.withColumns({c: (F.col(c) - m) / F.lit(s or 1.0) for c, (m, s) in fitted.items()})


def feature_matrix(df: DataFrame, key: Sequence[str], small_rows: int = SMALL_ROWS):
    """Numeric features for clustering: identifiers, dates, constants and long text dropped,
    small categories one-hot, NULL filled by the median. Returns (features, summary rows)."""
    cols = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))]
    prof = infer_types(column_profile(df.select(*cols), small_rows=small_rows)).withColumn(
        "ident", is_cluster_identifier()).collect()
    numeric, categorical, summary = [], [], []
    for r in prof:
        name, ratio = r["column_name"], (r["n_unique"] or 0) / max(r["n_rows"], 1)
        if r["ident"]:
            what = "identifier"
        elif r["kind"] in ("int", "float"):
            what = "constant" if r["n_unique"] <= 1 else "numeric"
        elif r["kind"] == "timestamp" or any(t in name.lower() for t in L.CLUSTER_DATE_TERMS):
            what = "datetime"
        elif r["n_unique"] <= MAX_LEVELS and ratio <= 0.50:
            what = "categorical"
        else:
            what = "high_cardinality_text"
        if what == "numeric":
            numeric.append(name)
        elif what == "categorical":
            categorical.append(name)
        summary.append((name, what, r["median"] if what == "numeric" else None))
    med = {s[0]: s[2] for s in summary if s[1] == "numeric"}
    holes = {r["column_name"]: r["null_count"] for r in prof}
    out = df.select(*[F.col(k).alias(f"_key_{k}") for k in key],
                    *[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in numeric],
                    *categorical)
    for c in categorical:
        found = set(levels(df, c)) | ({"Unknown"} if holes[c] else set())
        out = encode_onehot(out, c, unknown="Unknown", values=sorted(found))
    table = df.sparkSession.createDataFrame(summary, "column_name string, used_as string, fill_value double")
    return out, table


def embedding_columns(df: DataFrame) -> list[str]:
    """Columns that hold embeddings: float arrays, or numeric columns named like one."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)
              and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]
    named = [c for c in numeric_columns(df)
             if c.startswith("text_emb_") or c.startswith("[NLP]") or "embedding" in c.lower()]
    return arrays + named


def align(df: DataFrame, numeric: dict[str, float], onehot: dict[str, Sequence[str]],
          key: Sequence[str] = ()) -> DataFrame:
    """New rows in the saved feature order: fills and level lists come from training.

    A missing column is an error; unseen levels give zeros.
    """
    lost = [c for c in [*numeric, *onehot] if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    cells = [F.coalesce(F.col(c).try_cast("double"), F.lit(float(m))).alias(c) for c, m in numeric.items()]
    for c, vals in onehot.items():
        known = F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
        cells += [(known == v).cast("double").alias(f"{c}_{v}") for v in vals]
    return df.select(*key, *cells)


def median_fill(df: DataFrame, cols: Sequence[str], fitted: dict[str, float] | None = None,
                small_rows: int = SMALL_ROWS) -> tuple[DataFrame, dict[str, float]]:
    """Median fill; the returned medians are reused when scoring."""
    if fitted is None:
        fitted = {c: q[0] for c, q in exact_quantiles(df, cols, [0.5], small_rows).items()}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in fitted.items()}), fitted

"""Number clean-up and threshold bands, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    d = c.cast("double")
    bad = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(~bad, c)


def safe_number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(c.try_cast("double")), F.lit(float(default)))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def parse_number(c: Column) -> Column:
    """Text with thousands commas to double, NULL when it is not a finite number."""
    return finite(F.trim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("double"))


def band(value: Column, steps: Sequence[tuple[float, str]], otherwise: str,
         strict: bool = False) -> Column:
    """Label of the first step whose threshold `value` reaches (or exceeds when strict)."""
    out = None
    for limit, label in steps:
        hit = value > limit if strict else value >= limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def importance_level(pct: Column) -> Column:
    return band(pct, [(30, "Critical"), (15, "High"), (5, "Medium")], "Low")


def separation_level(pct: Column) -> Column:
    return band(pct, [(25, "Critical"), (10, "High")], "Standard", strict=True)


def severity_rank(c: Column) -> Column:
    from .lexicon import SEVERITIES

    out = F
    for i, s in enumerate(SEVERITIES):
        out = out.when(c == s, i)
    return out.otherwise(len(SEVERITIES))


def pct_change(early: Column, late: Column) -> Column:
    return (late - early) / F.greatest(F.abs(early), F.lit(1e-9)) * 100


def sanitize(df: DataFrame, digits: int = 6, null_as: float | None = None) -> DataFrame:
    """Make every column safe for a sink: non-finite to NULL (or `null_as`), floats rounded,
    timestamps as ISO text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(finite(c.cast("double")), digits)
            if null_as is not None:
                c = F.coalesce(c, F.lit(float(null_as)))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)

"""Saved results of earlier runs: merge by precedence, history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor empty text."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cols])


def merge_maps(*maps: Column) -> Column:
    """Later maps win."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), maps)


def merge_results(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Join result tables of the same columns; the last table with a filled value wins."""
    cols = [c for c in tables[0].columns if c not in key]
    out = tables[0].select(*key, *[F.col(c).alias(f"{c}_0") for c in cols])
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.select(*key, *[F.col(c).alias(f"{c}_{i}") for c in cols]), list(key), "full")
    last = range(len(tables) - 1, -1, -1)
    return out.select(*key, *[first_filled(*[F.col(f"{c}_{i}") for i in last]).alias(c) for c in cols])

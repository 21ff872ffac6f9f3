"""Deterministic sampling, splits and folds from a hash of the row key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_RANGE = 100_000


def key_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """Hex digest of the key: the same row gets the same place on any cluster."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.md5(text.cast("binary"))


def hash_unit(keys: Sequence[str], seed: int = 42) -> Column:
    """Uniform number in [0, 1) from the first 8 digits of the key hash."""
    return F.conv(F.substring(key_hash(keys, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest key hash: a bounded top-n, no full sort."""
    cols = df.columns
    return df.withColumn("_h", key_hash(keys, seed)).orderBy("_h", *keys).limit(n).select(*cols)


def _place_in_class(df: DataFrame, label: str, keys: Sequence[str], seed: int, digits: int | None):
    """Rank of a row inside its class in hash order, and the class size.

    A class is cut into 16^digits equal hash ranges (by default so many that the largest class
    has about `ROWS_PER_RANGE` rows in each), so a class that holds most of the table still
    spreads over many tasks; range sizes (classes x ranges rows) give the offsets.
    """
    if digits is None:
        largest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        digits = max(2, math.ceil(math.log(max(largest / ROWS_PER_RANGE, 1), 16)))
    d = df.withColumn("_h", key_hash(keys, seed)).withColumn("_p", F.substring("_h", 1, digits))
    sizes = d.groupBy(label, "_p").agg(F.count("*").alias("_c"))
    before = W.partitionBy(label).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(label).alias("_lab"), F.col("_p").alias("_pp"),
                           F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"),
                           F.sum("_c").over(W.partitionBy(label)).alias("class_size"))
    place = F.row_number().over(W.partitionBy(label, "_p").orderBy("_h", *keys))
    d = d.withColumn("_rn", place)
    joined = d.join(offsets, d[label].eqNullSafe(offsets["_lab"]) & (d["_p"] == offsets["_pp"]))
    return (joined.withColumn("place", (F.col("_rn") + F.col("_o") - 1).cast("long"))
            .drop("_h", "_p", "_rn", "_lab", "_pp", "_o"))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 3, seed: int = 42,
                     digits: int | None = None) -> DataFrame:
    """Column `fold` 0..k-1, each class spread evenly over the folds."""
    cols = df.columns
    return (_place_in_class(df, label, keys, seed, digits)
            .withColumn("fold", F.pmod("place", F.lit(k)).cast("long")).select(*cols, "fold"))


def holdout(df: DataFrame, keys: Sequence[str], how: str = "shuffle", label: str | None = None,
            group: str | None = None, test_share: float = 0.20, seed: int = 42,
            digits: int | None = None) -> DataFrame:
    """Column `part` train / test.

    shuffle: by key hash. stratified: the first share of every class in hash order.
    group: by the hash of the group value, so equal texts stay together.
    """
    if how == "stratified":
        cols = df.columns
        d = _place_in_class(df, label, keys, seed, digits)
        test = F.col("place") < F.ceil(F.col("class_size") * test_share)
        return d.withColumn("part", F.when(test, "test").otherwise("train")).select(*cols, "part")
    by = [group] if how == "group" else list(keys)
    return df.withColumn("part", F.when(hash_unit(by, seed) < test_share, "test").otherwise("train"))


def choose_split(unique_ratio: float, smallest_class: int | None) -> str:
    """Group when texts repeat, stratified when every class can be split, else shuffle."""
    if unique_ratio < 0.90:
        return "group"
    if smallest_class is not None and smallest_class >= 2:
        return "stratified"
    return "shuffle"


def fold_count(smallest_class: int, most: int = 3) -> int:
    return max(2, min(most, smallest_class)) if smallest_class >= 2 else 2

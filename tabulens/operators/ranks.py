"""Global ranks and running totals that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import cut_lineage

ONE_TASK_ROWS = 200_000  # rows that one window may hold
SPREAD_VALUES = 200_000  # rows of a rank table that is broadcast at most


def running_totals(df: DataFrame, group: str, value: str, sums: Sequence[str], rows: int, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """Add `<sum>_upto` per group in value order. `rows` bounds the rows of one group.

    Values must be unique per group (aggregate first), so no value can make a range hot. More
    rows than `one_task` are sorted once by ranges of (group, value); each range adds up its own
    rows as they stream by, and the ranges' totals (one row per range and group in it) give the offsets.
    """
    if rows <= one_task:
        order = W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({f"{s}_upto": F.sum(s).over(order) for s in sums})
    at_group, at_sums = df.columns.index(group), [df.columns.index(s) for s in sums]
    schema = StructType([*df.schema.fields])
    for s in sums:
        schema = schema.add(f"_{s}", LongType())
    names = schema.names

    def add_up(batches):
        last, carry = None, np.zeros(len(sums), np.int64)
        for b in batches:
            g = b.column(at_group).to_pandas().to_numpy()
            if not len(g):
                continue
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            cols = []
            for i, at in enumerate(at_sums):
                c = np.cumsum(b.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.concatenate([[0], c[start[1:] - 1]])
                if g[0] == last:
                    base[0] = -carry[i]
                c = c - base[run]
                carry[i] = c[-1]
                cols.append(c)
            last = g[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c) for c in cols]], names=names)

    fixed = df.repartitionByRange(group, value).sortWithinPartitions(group, value).mapInArrow(add_up, schema).withColumn("_p", F.spark_partition_id())
    fixed = cut_lineage(fixed)  # the ranges stay as they are from here
    totals = fixed.groupBy(group, "_p").agg(*[F.max(f"_{s}").alias(f"_{s}") for s in sums])
    before = W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(group, "_p", *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}0") for s in sums])
    # one row per range and group: broadcast
    return fixed.join(F.broadcast(offsets), [group, "_p"]).withColumns({f"{s}_upto": F.col(f"_{s}") + F.col(f"_{s}0") for s in sums}).select(*df.columns, *[f"{s}_upto" for s in sums])


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, rows: int,
           floor: int = 1_000_000) -> DataFrame:
    """Inner join on keys unique in `small`, where `weight` counts the rows of a key.

    Keys with more than rows/1000 rows (at most a thousand of them per group) are joined by
    broadcast; only the rest is shuffled, so no key can flood one task.
    """
    keys = list(keys)
    limit = max(rows / 1000, floor)
    slim = small.drop(weight)
    if rows <= limit:
        return big.join(slim, keys)
    hot = small.where(F.col(weight) > limit).drop(weight)
    few = F.broadcast(hot)
    return big.join(few, keys).unionByName(
        big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(slim, keys))


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, cnt, avg_rank): ranks from 1, ties share their mean rank."""
    rows = df.count()
    freq = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count("*").alias("cnt")).withColumn("grp", F.lit("all")))
    return running_totals(freq, "grp", "value", ["cnt"], rows).select(
        "value", "cnt", (F.col("cnt_upto") - (F.col("cnt") - 1) / 2.0).alias("avg_rank"))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], rows: int | None = None, one_task: int = ONE_TASK_ROWS,
             floor: int = 1_000_000, spread_values: int = SPREAD_VALUES, places: Sequence[str] = ()) -> DataFrame:
    """(feature_a, feature_b, n, spearman_r) over pairwise complete rows. Columns in `places` number
    all rows from 0: they are ranks already, unless the partner has NULLs.

    A column is ranked once for all pairs; only where a partner has NULLs in other rows is it
    ranked again among the rows both have. All ranks come from one table of value counts. Ranks of
    columns with few different values are looked up by broadcast (up to `spread_values` rows in all,
    checked), so such rows are never shuffled; every other column takes one shuffle of the rows.
    """
    pairs = list(pairs)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: f"c{i}" for i, c in enumerate(cols)}
    plain = df.select(*[F.col(c).cast("double").alias(at[c]) for c in cols])
    full = plain.agg(F.count("*").alias("rows"), *[F.count(x).alias(x) for x in at.values()],
                     *[F.count_if(F.col(at[a]).isNotNull() & F.col(at[b]).isNotNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    rows = full["rows"]
    # a column's values are counted once: all of them, and those in rows where a partner with other NULLs is known
    wanted: dict[str, list[str | None]] = {c: [] for c in cols}
    sides = []
    for i, (a, b) in enumerate(pairs):
        side = []
        for c, o in ((a, b), (b, a)):
            o = None if full[at[c]] == full[f"p{i}"] else o
            if o not in wanted[c]:
                wanted[c].append(o)
            side.append((c, wanted[c].index(o)))
        sides.append(side)
    known = [c for c in cols if c in places and wanted[c] == [None]]
    known = known if len(known) < len(cols) else []
    ranked = [c for c in cols if c not in known]
    most = max(len(w) for w in wanted.values())
    one = lambda c, i: (F.lit(1) if wanted[c][i] is None else F.col(at[wanted[c][i]]).isNotNull().cast("int")) if i < len(wanted[c]) else F.lit(0)
    items = F.array(*[F.struct(F.lit(cols.index(c)).alias("job"), F.col(at[c]).alias("v"), *[one(c, i).alias(f"c{i}") for i in range(most)]) for c in ranked])
    freq = plain.select(F.inline(items)).where("v is not null").groupBy("job", "v").agg(F.count("*").alias("w"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(most)])
    ranks = running_totals(freq, "job", "v", [f"c{i}" for i in range(most)], rows, one_task).select("job", "v", "w", *[(F.col(f"c{i}_upto") - (F.col(f"c{i}") - 1) / 2.0).alias(f"r{i}") for i in range(most)])
    ranks = cut_lineage(ranks)  # read once per column; without this every reading would add up the ranges again
    size = {cols[r["job"]]: r["n"] for r in ranks.groupBy("job").agg(F.count("*").alias("n")).collect()}  # one row per ranked column
    few, room = [], spread_values
    for c in sorted(size, key=size.get):
        if size[c] <= room:
            few.append(c)
            room -= size[c]
    many = [c for c in size if c not in few]
    rank = lambda c, i: F.col(f"{at[c]}_r{i}")
    mine = lambda c: ranks.where(F.col("job") == cols.index(c)).select(F.col("v").alias("_v"), *[F.col(f"r{i}").alias(f"{at[c]}_r{i}") for i in range(len(wanted[c]))], F.col("w").alias("_w"))
    wide = plain.withColumns({f"{at[c]}_r0": F.col(at[c]) + 1 for c in known})
    for c in few:
        wide = wide.join(F.broadcast(mine(c).drop("_w")), F.col(at[c]) == F.col("_v"), "left").drop("_v")
    for c in many:
        wide = add_ranks(wide, at[c], mine(c), [f"{at[c]}_r{i}" for i in range(len(wanted[c]))], list(at.values()), rows, floor)
    sums = []
    for i, (x, y) in enumerate(sides):
        if any(c not in size and c not in known for c, _ in (x, y)):
            sums += [F.lit(None).cast("double").alias(f"{k}{i}") for k in ("xy", "xx", "yy")]
            continue
        mid = (full[f"p{i}"] + 1) / 2.0
        dx, dy = rank(*x) - mid, rank(*y) - mid
        both = dx.isNotNull() & dy.isNotNull()
        sums += [F.sum(dx * dy).alias(f"xy{i}"), F.sum(F.when(both, dx * dx)).alias(f"xx{i}"), F.sum(F.when(both, dy * dy)).alias(f"yy{i}")]
    out = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.lit(full[f"p{i}"]).cast("long").alias("n"),
                    F.try_divide(F.col(f"xy{i}"), F.sqrt(F.col(f"xx{i}") * F.col(f"yy{i}"))).alias("spearman_r")) for i, (a, b) in enumerate(pairs) if full[f"p{i}"]]
    if not out:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, n long, spearman_r double")
    return wide.agg(*sums).select(F.inline(F.array(*out)))


def add_ranks(wide: DataFrame, col: str, table: DataFrame, ranks: Sequence[str], spread_by: Sequence[str], rows: int, floor: int) -> DataFrame:
    """Left join of (_v, ranks..., _w) on the values of `col`, where _w counts the rows of a value.

    Values with more than rows/1000 rows (at most a thousand of them) are joined by broadcast. Their rows and those
    without a value have no partner in the shuffle that follows; a salt deals them out."""
    limit = max(rows / 1000, floor)
    if rows <= limit:
        return wide.join(table.drop("_w"), F.col(col) == F.col("_v"), "left").drop("_v")
    hot = table.where(F.col("_w") > limit).select(F.col("_v").alias("_hot"), *[F.col(r).alias(f"_hot_{r}") for r in ranks])
    wide = wide.join(F.broadcast(hot), F.col(col) == F.col("_hot"), "left")
    alone = F.col(col).isNull() | F.col("_hot").isNotNull()
    salt = F.when(alone, F.pmod(F.xxhash64(*spread_by, F.spark_partition_id()), F.lit(4096)) + 1).otherwise(F.lit(0))
    cold = table.where(F.col("_w") <= limit).drop("_w").withColumn("_s", F.lit(0).cast("long"))
    wide = wide.withColumn("_salt", salt.cast("long")).join(cold, (F.col(col) == F.col("_v")) & (F.col("_salt") == F.col("_s")), "left")
    return wide.withColumns({r: F.coalesce(F.col(f"_hot_{r}"), F.col(r)) for r in ranks}).drop("_v", "_s", "_salt", "_hot", *[f"_hot_{r}" for r in ranks])


def cumulative_share(df: DataFrame, rank: str, value: str, alias: str = "cumulative") -> DataFrame:
    """Running sum over a ranked feature table (one row per feature, so one small window)."""
    w = W.orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(alias, F.sum(value).over(w))


def number_rows(df: DataFrame, order: Sequence, alias: str = "rank") -> DataFrame:
    """Rank 1..n on a small result table (leaderboards, findings, features)."""
    return df.withColumn(alias, F.row_number().over(W.orderBy(*order)).cast("long"))


def ordered_places(df: DataFrame, order: Sequence, alias: str = "place") -> DataFrame:
    """Every row with its place (from 1) in the given order of unique keys: ranges are sorted, written
    once to the checkpoint folder and numbered by their offsets, so no task sees the whole table."""
    fixed = cut_lineage(df.orderBy(*order).withColumns({"_i": F.monotonically_increasing_id()}))
    fixed = fixed.withColumn("_p", F.shiftright("_i", 33))
    sizes = fixed.groupBy("_p").agg(F.count("*").alias("_c"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))  # one row per range
    place = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o") + 1
    return fixed.join(F.broadcast(offsets), "_p").withColumn(alias, place).drop("_p", "_i", "_o")

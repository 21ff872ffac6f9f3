"""Exact order statistics by repeated bracketing.

Nothing is sorted whole and no task sees a share of the table. A round asks one mergeable sketch per
open bracket for two values around every wanted rank (or pair of neighbours) and counts the rows below, at and between them; a rank that
falls on one of the two is settled (so hot values settle at once), any other goes on between
them with a few rows per ten thousand. Brackets of at most `SETTLE` rows are read and counted
by value. Small tables skip the rounds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_ROWS = 200_000  # tables of up to so many rows use the built-in exact percentile
SETTLE = 2_000  # rows of a bracket that are read
ACCURACY = 10_000


def orderable(df: DataFrame, col: str) -> Column:
    """Numeric form of a numeric, date or timestamp column."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(col))
    return F.col(col)


def _neighbours(ranks: Sequence[int]) -> list[tuple[int, int]]:
    """(first, last) of the runs of ranks that stand side by side."""
    out: list[tuple[int, int]] = []
    for k in sorted(set(ranks)):
        if out and k - out[-1][1] <= 1:
            out[-1] = out[-1][0], k
        else:
            out.append((k, k))
    return out


def select_ranks(df: DataFrame, wanted: dict[str, tuple[str, int]], settle: int = SETTLE, accuracy: int = ACCURACY, rows: dict[str, int] | None = None) -> dict[str, tuple]:
    """Request -> (column, rank from 0 among its non-null values) to request -> (value, rows below it, rows equal to it).

    `rows` are the columns' numbers of non-null values, where they are known already."""
    out: dict[str, tuple] = {}
    if not wanted:
        return out
    # open bracket, rows below it and in it
    if rows is None:
        rows = df.agg(*[F.count(c).alias(c) for c in sorted({c for c, _ in wanted.values()})]).first()
    left = {r: (c, k, None, None, 0, rows[c]) for r, (c, k) in wanted.items()}

    def inside(c, lo, hi):
        cond = F.col(c).isNotNull()
        if lo is not None:
            cond = cond & (F.col(c) > F.lit(lo))
        return cond if hi is None else cond & (F.col(c) < F.lit(hi))

    while wide := {r: x for r, x in left.items() if x[5] > settle}:
        brackets = defaultdict(list)  # one sketch for each
        for r, (c, k, lo, hi, below, n) in wide.items():
            brackets[c, lo, hi, below, n].append(k)
        pairs = {b: _neighbours(ks) for b, ks in brackets.items()}  # ranks side by side share two edges
        asks = []
        for i, ((c, lo, hi, below, n), runs) in enumerate(pairs.items()):
            at = [e for first, last in runs for e in (max(0.0, (first - below) / n - 2 / accuracy), min(1.0, (last - below) / n + 2 / accuracy))]
            asks.append(F.approx_percentile(F.when(inside(c, lo, hi), F.col(c)), F.array(*map(F.lit, at)), F.lit(accuracy)).alias(f"e{i}"))
        sketched = df.agg(*asks).first()
        edges, counts = {}, []
        for i, ((c, lo, hi, below, n), runs) in enumerate(pairs.items()):
            here = inside(c, lo, hi)
            for j, (first, last) in enumerate(runs):
                a, z = sketched[f"e{i}"][2 * j:2 * j + 2]
                edges |= {(c, lo, hi, k): (a, z, len(counts)) for k in brackets[c, lo, hi, below, n] if first <= k <= last}
                counts.append(F.array(F.count_if(here & (F.col(c) < F.lit(a))), F.count_if(here & (F.col(c) == F.lit(a))), F.count_if(here & (F.col(c) > F.lit(a)) & (F.col(c) < F.lit(z))), F.count_if(here & (F.col(c) == F.lit(z)) & F.lit(a != z))).alias(f"n{len(counts)}"))
        found = df.agg(*counts).first()
        for r, (c, k, lo, hi, below, n) in wide.items():
            a, z, at = edges[c, lo, hi, k]
            under, at_a, between, at_z = found[f"n{at}"]
            steps = [(lo, a, below, under), (a, a, below + under, at_a), (a, z, below + under + at_a, between), (z, z, below + under + at_a + between, at_z)]
            steps.append((z, hi, steps[-1][2] + at_z, n - under - at_a - between - at_z))
            for i, (x, y, b, m) in enumerate(steps):
                if k < b + m:
                    if i in (1, 3):
                        out[r] = (x, b, m)
                        del left[r]
                    else:
                        left[r] = (c, k, x, y, b, m)
                    break
    if left:
        picks = [F.when(inside(c, lo, hi), F.struct(F.lit(r).alias("r"), F.col(c).alias("v"))) for r, (c, _, lo, hi, _, _) in left.items()]
        values = defaultdict(list)
        kinds = defaultdict(list)  # one pass per type of column
        for p, (c, *_) in zip(picks, left.values()):
            kinds[df.schema[c].dataType.simpleString()].append(p)
        for group in kinds.values():  # at most `settle` rows for each request
            for x in df.select(F.explode(F.filter(F.array(*group), lambda s: s.isNotNull())).alias("s")).groupBy("s.r", "s.v").agg(F.count("*").alias("n")).collect():
                values[x["r"]].append((x["v"], x["n"]))
        for r, (_, k, _, _, below, _) in left.items():
            for v, n in sorted(values[r]):
                if k < below + n:
                    out[r] = (v, below, n)
                    break
                below += n
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], small_rows: int = SMALL_ROWS) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of numeric columns; null for a column without values."""
    cols = list(cols)
    if not cols:
        return {}
    counts = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    n = {c: counts[f"c{i}"] for i, c in enumerate(cols)}
    if max(n.values()) <= small_rows:
        row = df.agg(*[F.percentile(F.col(c), F.array(*[F.lit(float(p)) for p in probs])).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                for i, c in enumerate(cols)}
    flat = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    wanted = {}
    for i, c in enumerate(cols):
        for p in probs if n[c] else []:
            at = (n[c] - 1) * p
            wanted |= {f"{i}_{k}": (f"c{i}", k) for k in (math.floor(at), math.ceil(at))}
    got = select_ranks(flat, wanted)
    out = {}
    for i, c in enumerate(cols):
        out[c] = [None] * len(probs)
        for j, p in enumerate(probs if n[c] else []):
            at = (n[c] - 1) * p
            lo, hi = (got[f"{i}_{k}"][0] for k in (math.floor(at), math.ceil(at)))
            out[c][j] = lo + (hi - lo) * (at - math.floor(at))
    return out


def order_boundaries(df: DataFrame, keys: Sequence[str], positions: Sequence[int], rows: int | None = None) -> list[Column]:
    """Conditions that hold for exactly the first `position` rows in the order of `keys`, one per position.

    Ties on one key are broken by the next; the keys together must be unique and non-null. All
    positions share their passes. `rows` is the number of rows, where it is known already.
    """
    n = [df.count() if rows is None else rows] * len(positions)
    cond, prefix, left = [F.lit(False) for _ in positions], [F.lit(True) for _ in positions], list(positions)
    going = [i for i, p in enumerate(positions) if 0 < p < n[i]]
    for k in keys:
        if not going:
            break
        here = orderable(df, k)
        some = F.lit(False)
        for i in going:
            some = some | prefix[i]
        flat = df.where(some).select(*[F.when(prefix[i], here).alias(f"k{i}") for i in going])
        got = select_ranks(flat, {f"k{i}": (f"k{i}", left[i] - 1) for i in going}, rows={f"k{i}": n[i] for i in going})
        for i in going:
            value, below, n[i] = got[f"k{i}"]
            cond[i] = cond[i] | (prefix[i] & (here < F.lit(value)))
            prefix[i] = prefix[i] & (here == F.lit(value))
            left[i] -= below
        going = [i for i in going if left[i] < n[i]]
    return [c | p if m >= r else c for c, p, m, r in zip(cond, prefix, left, n)]


def order_boundary(df: DataFrame, keys: Sequence[str], position: int) -> Column:
    """The condition of one position (see `order_boundaries`)."""
    return order_boundaries(df, keys, [position])[0]


def split_ends(df: DataFrame, order_by: Sequence[str], fraction: float = 0.20, least: int = 10, rows: int | None = None) -> DataFrame:
    """First and last `fraction` of the ordered rows, marked early / late in column `side`."""
    n = df.count() if rows is None else rows
    window = max(int(n * fraction), least)
    early, not_late = order_boundaries(df, order_by, [min(window, n), max(n - window, 0)], n)
    sides = F.concat(F.when(early, F.array(F.lit("early"))).otherwise(F.array().cast("array<string>")),
                     F.when(~not_late, F.array(F.lit("late"))).otherwise(F.array().cast("array<string>")))
    return df.withColumn("side", F.explode(sides))

"""Drift of an event stream, told when it happens.

Every key keeps, in Spark's state store, the sums of its reference window (the first one that closes),
the sums of its open windows, and a sketch of both (counts between fixed edges). When the
watermark closes a window, its shift against the reference is sent out; a key that stays silent
for `silence` seconds of event time is reported by its timer. `window_drift` gives the same rows of
a stored table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, kind string, window_start timestamp, n long, mean double, shift double, normalised_shift double, ks double"


def _empty(bins: int) -> dict:
    return {"n": 0, "sum": 0.0, "squares": 0.0, "bins": [0] * bins}


def shift_of(ref: dict, own: dict) -> tuple[float, float, float, float]:
    """(mean, shift, shift in spreads of the reference, largest gap between the shares at the edges)."""
    mean, base = own["sum"] / own["n"], ref["sum"] / ref["n"]
    var = (ref["squares"] - ref["n"] * base * base) / (ref["n"] - 1) if ref["n"] > 1 else 0.0
    sd = math.sqrt(var) if var > 1e-12 else 1.0
    a = b = 0
    ks = 0.0
    for x, y in zip(ref["bins"], own["bins"]):
        a, b = a + x, b + y
        ks = max(ks, abs(a / ref["n"] - b / own["n"]))
    return mean, mean - base, abs(mean - base) / sd, ks


class _Keyed:
    """One key's state: the reference and the open windows."""

    def __init__(self, state: GroupState, bins: int):
        ref, open_, last = state.get if state.exists else ("", "{}", 0)
        self.ref, self.open, self.last, self.bins = json.loads(ref) if ref else None, {int(k): v for k, v in json.loads(open_).items()}, last, bins

    def add(self, pdf: pd.DataFrame, floor: int) -> None:
        """Partial sums of windows that are not closed yet."""
        for r in pdf.itertuples(index=False):
            if r.end > floor:
                w = self.open.setdefault(int(r.start), _empty(self.bins) | {"end": int(r.end)})
                w["n"] += int(r.n)
                w["sum"] += float(r.sum)
                w["squares"] += float(r.squares)
                w["bins"] = [x + int(y) for x, y in zip(w["bins"], r.bins)]
                self.last = max(self.last, int(r.end))

    def close(self, mark: int) -> Iterator[tuple]:
        for start in sorted(s for s, w in self.open.items() if w["end"] <= mark):
            w = self.open.pop(start)
            if self.ref is None:
                self.ref = w
                yield "reference", start, w["n"], w["sum"] / w["n"], None, None, None
            else:
                yield "window", start, w["n"], *shift_of(self.ref, w)

    def save(self, state: GroupState, silence: int) -> None:
        state.update((json.dumps(self.ref) if self.ref else "", json.dumps(self.open), self.last))
        ends = [w["end"] for w in self.open.values()]
        state.setTimeoutTimestamp(max(min([*ends, self.last + silence]), state.getCurrentWatermarkMs() + 1))


def _partial(events: DataFrame, key: str, value: str, seconds: int, edges: Sequence[float], *extra: Column) -> DataFrame:
    """Rows as one-row sums: (key, start, end in milliseconds, n, sum, squares, bins)."""
    v = F.col(value).cast("double")
    at = F.unix_millis("_t")
    start = at - F.pmod(at, F.lit(seconds * 1000))
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < v))
    bins = F.transform(F.sequence(F.lit(0), F.lit(len(edges))), lambda i: (i == place).cast("long"))
    return events.where(v.isNotNull() & F.col("_t").isNotNull()).select(F.col(key).cast("string").alias("key"), "_t", start.alias("start"), (start + seconds * 1000).alias("end"), F.lit(1).cast("long").alias("n"), v.alias("sum"), (v * v).alias("squares"), bins.alias("bins"))


def drift_stream(events: DataFrame, ts: str, key: str, value: str, seconds: int = 86_400, late: str = "10 minutes", silence: int = 7 * 86_400, edges: Sequence[float] = (0, 1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """Stream of rows (key, kind, window_start, n, mean, shift, normalised_shift, ks): `reference` once per key, `window`
    for every later window as the watermark closes it, `silent` when a key's timer runs out."""
    rows = _partial(events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late), key, value, seconds, edges)
    bins, wait = len(edges) + 1, silence * 1000
    names = ["key", "kind", "window_start", "n", "mean", "shift", "normalised_shift", "ks"]

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, mark, out = _Keyed(state, bins), state.getCurrentWatermarkMs(), []
        if state.hasTimedOut:
            out += own.close(mark)
            if not own.open and own.last + wait <= mark:
                out.append(("silent", own.last, 0, None, None, None, None))
                state.update((json.dumps(own.ref) if own.ref else "", "{}", own.last))
                own = None  # no timer until the key is heard again
        else:
            for pdf in batches:
                # one addition per window of a batch
                own.add(pdf.groupby(["start", "end"], as_index=False).agg({"n": "sum", "sum": "sum", "squares": "sum", "bins": lambda b: [sum(x) for x in zip(*b)]}), mark)
            out += own.close(mark)
        if own is not None:
            own.save(state, wait)
        if out:
            yield pd.DataFrame([(k[0], kind, pd.Timestamp(start, unit="ms"), *rest) for kind, start, *rest in out], columns=names)

    return rows.groupBy("key").applyInPandasWithState(run, OUTPUT, "ref string, open string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def window_drift(events: DataFrame, ts: str, key: str, value: str, seconds: int = 86_400, edges: Sequence[float] = (0, 1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """The stream's reference and window rows, from a stored table with all windows closed."""
    rows = _partial(events.withColumn("_t", F.col(ts).cast("timestamp")), key, value, seconds, edges)
    b = range(len(edges) + 1)
    w = rows.groupBy("key", "start").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"), F.array(*[F.sum(F.col("bins")[i]) for i in b]).alias("bins"))
    first = w.groupBy("key").agg(F.min_by(F.struct("start", "n", "sum", "squares", "bins"), "start").alias("r"))
    share = lambda bins, n: F.transform(F.sequence(F.lit(1), F.size(bins)), lambda i: F.aggregate(F.slice(bins, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x) / n)
    d = w.join(first, "key").withColumns({"mean": F.col("sum") / F.col("n"), "base": F.col("r.sum") / F.col("r.n")})
    var = F.when(F.col("r.n") > 1, (F.col("r.squares") - F.col("r.n") * F.col("base") * F.col("base")) / (F.col("r.n") - 1)).otherwise(0.0)
    later = F.col("start") > F.col("r.start")
    shift = F.col("mean") - F.col("base")
    ks = F.array_max(F.zip_with(share(F.col("r.bins"), F.col("r.n")), share(F.col("bins"), F.col("n")), lambda x, y: F.abs(x - y)))
    return d.select("key", F.when(later, "window").otherwise("reference").alias("kind"), F.timestamp_millis("start").alias("window_start"), "n", "mean",
                    F.when(later, shift).alias("shift"), F.when(later, F.abs(shift) / F.when(var > 1e-12, F.sqrt(var)).otherwise(1.0)).alias("normalised_shift"), F.when(later, ks).alias("ks"))

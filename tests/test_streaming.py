"""Stateful drift on a stream against the stored table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulens.streaming import drift, windows

FOLDER = "/root/testdata/sf0.001"
COLS = ["kind", "n", "mean", "shift", "normalised_shift", "ks"]


def collect(d):
    near = lambda x: None if x is None or x != x else round(x, 6)
    return {(r["key"], r["window_start"]): tuple(near(r[c]) if isinstance(r[c], float) else r[c] for c in COLS) for r in d.collect()}


def test_streamed_drift_equals_the_table(spark, tmp_path):
    stream = drift.drift_stream(windows.event_stream(spark, FOLDER, "events"), "ts", "event_type", "value", seconds=43_200)
    windows.run_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = collect(spark.read.parquet(f"{tmp_path}/out").where("kind <> 'silent'"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    want = collect(drift.window_drift(events, "ts", "event_type", "value", seconds=43_200))
    mark = events.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    closed = {k: v for k, v in want.items() if k[1] + dt.timedelta(hours=12) <= mark}
    assert closed and got == closed


def test_late_rows_shifts_and_silence(spark, tmp_path):
    """Files arrive one by one: a shift is told when its window closes, a silent key by its timer, and rows behind the watermark are left out."""
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [
        [("a", day(1, h), float(h % 3)) for h in range(24)] + [("b", day(1, 5), 1.0)],
        [("a", day(2, h), float(h % 3) + 10) for h in range(24)],
        [("a", day(4, 1), 1.0), ("a", day(1, 1), 99.0)],
        [("a", day(20), 1.0)],
    ]
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, t timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, t timestamp, v double").parquet(f"{tmp_path}/in")
        windows.run_to_parquet(drift.drift_stream(stream, "t", "k", "v", seconds=86_400, late="1 hour", silence=2 * 86_400), f"{tmp_path}/out", f"{tmp_path}/check")
        out.append({(r["key"], r["kind"], r["window_start"].day): r for r in spark.read.parquet(f"{tmp_path}/out").collect()})
    assert ("a", "reference", 1) in out[1] and ("a", "window", 2) not in out[1]
    told = out[2]["a", "window", 2]
    assert told["shift"] == pytest.approx(10.0) and told["ks"] > 0.9 and told["n"] == 24
    assert out[3]["a", "reference", 1]["n"] == 24 and any(k[:2] == ("b", "silent") for k in out[3]) and ("a", "window", 4) in out[3]

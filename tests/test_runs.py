"""Whole runs keep their rows, and operators that once sampled, capped or read a prefix."""

import pytest
from pyspark.sql import functions as F

from tabulens import flows
from tabulens.operators import clusters, encode, impute, models
from tabulens.operators.ranks import ordered_places
from tabulens.sources.files import read_csv


def test_preprocess_keeps_rows_that_become_equal(spark):
    """60 pairs differ only in a column that is dropped as sparse; texts get vectors."""
    words = ["late delivery of the ordered parcel", "payment was refused by the bank again", "the agent did not answer my question", "wrong item in the box that arrived"]
    rows = [(i, f"{words[i // 2 % 4]} number {i // 2 % 37} in the long complaint text", "AB"[i // 2 % 2], float(i // 2 % 11), f"s{i % 3}" if i % 8 < 3 else None) for i in range(120)]
    rows += [(1000 + i, f"{words[i % 4]} once more with another remark {i}", "AB"[i % 2], float(i), None) for i in range(40)]
    d = spark.createDataFrame(rows, "nr long, note string, kind string, amount double, rare string").drop("nr")
    d = d.withColumn("_row", F.lit("own"))  # a column of the same name is left alone
    r = flows.preprocess(d, target="kind")
    assert r.model_ready.count() == r.cleaned.count() == d.distinct().count()


def test_equal_rows_ask_alike(spark):
    """Two equal rows get the same fill as one such row."""
    rows = [(i, float(i), 10.0 * i) for i in range(8)]
    one = impute.knn_fill(spark.createDataFrame([*rows, (100, 3.1, None)], "k long, x double, y double"), ["x", "y"], ["k"], k=3)
    two = impute.knn_fill(spark.createDataFrame([*rows, (100, 3.1, None), (101, 3.1, None)], "k long, x double, y double"), ["x", "y"], ["k"], k=3)
    fill = one.where("k = 100").first()["y"]
    assert [r["y"] for r in two.where("k >= 100").collect()] == [fill, fill] and fill == pytest.approx(30.0)


def test_fifty_levels_and_null(spark):
    rows = [(i, f"l{i % 50:02d}" if i % 60 else None, float(i)) for i in range(600)]
    out, summary = encode.feature_matrix(spark.createDataFrame(rows, "key long, level string, x double").withColumn("x", F.sin("x")), ["key"])
    assert {"level_Unknown", "level_l01", "level_l49"} <= set(out.columns) and out.count() == 600
    assert out.agg(F.sum("level_Unknown")).first()[0] == 10


def test_silhouette_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, 1, (30, 3)) for m in (0, 4, 1000)] + [np.full((1, 3), -50.0)])
    lab = [0] * 30 + [1] * 30 + [2] * 30 + [3]
    d = spark.createDataFrame([(int(c), *map(float, v)) for c, v in zip(lab, x)] + [(-1, 0.0, 0.0, 0.0)], "c int, a double, b double, z double")
    got = sorted(r["s"] for r in clusters.silhouette(d, "c", ["a", "b", "z"]).collect())
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    lab = np.array(lab)
    want = []
    for i, c in enumerate(lab):
        a = gap[i][lab == c].sum() / max((lab == c).sum() - 1, 1)
        b = min(gap[i][lab == o].mean() for o in set(lab.tolist()) - {c})
        want.append((b - a) / max(a, b) if (lab == c).sum() > 1 else 0.0)
    assert np.allclose(got, sorted(want), atol=1e-6)


def test_boosted_trees_with_six_classes():
    made = models.classification_candidates(models.Spec("y", "classification", ["k"]), 6, 100)
    assert made["GradientBoosting"] is not None


def test_encoding_looks_at_every_row(spark, tmp_path):
    """The only Arabic cell stands late in the file."""
    late = tmp_path / "late.csv"
    late.write_bytes("\n".join(["name,v", *[f"row{i},{i}" for i in range(3000)], "شكوى,1"]).encode("windows-1256"))
    got = read_csv(spark, str(late))
    assert got.count() == 3001 and got.where("v = 1 and name <> 'row1'").first()["name"] == "شكوى"
    marked = tmp_path / "marked.csv"
    marked.write_bytes("﻿name,v\nشكوى,1\n".encode())
    assert read_csv(spark, str(marked)).columns == ["name", "v"]


def test_places(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ordered_places(d.repartition(5), [F.col("k").desc()]).collect()
    assert sorted((r["k"], r["place"]) for r in got) == [(k, 1000 - k) for k in range(1000)]
    assert ordered_places(d.where("false"), ["k"]).collect() == []


def test_confusion_of_many_labels(spark):
    pairs = spark.createDataFrame([(f"a{i}", f"a{(i * 7) % 9}", i) for i in range(9)], "actual string, predicted string, n long")
    from tabulens.operators.evaluate import confusion_matrix

    assert confusion_matrix(pairs).count() == 81 and confusion_matrix(pairs, 5).count() == 9
    assert confusion_matrix(pairs).agg(F.sum("n")).first()[0] == 36

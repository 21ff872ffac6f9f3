"""Whole runs: routes, commits, restarts, failures."""

import pytest
from pyspark.sql import functions as F

from tabulens import runs
from tabulens.sources.files import UnusableTable


@pytest.fixture(scope="module")
def sales(spark):
    k = F.col("id")
    d = spark.range(400).select((k * 7919 % 100003).alias("order_id"), (k % 23).cast("double").alias("size"), ((k * 31) % 17).cast("double").alias("noise"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("region"))
    return d.withColumn("price", 3.0 * F.col("size") + F.when(F.col("region") == "r1", 20).otherwise(0) + F.sin("noise")).persist()


def test_routes(sales):
    route = lambda **o: runs.choose_route(sales, **o)
    assert route(force="unsupervised", target="price").decided_by == "forced"
    assert route(target="price") == runs.Route("supervised", "price", "regression", "request") or route(target="price").task == "classification"
    assert route(target="price", task="regression", config={"target_column": "region"}) == runs.Route("supervised", "price", "regression", "request")
    assert route(target="gone", config={"target_column": "region"}) == runs.Route("supervised", "region", "classification", "configuration")
    assert route(config={"task_type": "unsupervised"}) == runs.Route("unsupervised", None, None, "configuration")
    with pytest.raises(UnusableTable):
        route(config={"target_column": "gone"})
    found = route()
    assert found.decided_by == "inference" and (found.target == "price" or found.strategy == "unsupervised")
    bare = sales.select(F.col("size").alias("a"), F.col("noise").alias("b"))
    assert runs.choose_route(bare) == runs.Route("unsupervised", None, None, "inference")
    assert runs.choose_route(bare, config={"task_type": "regression"}).strategy == "unsupervised"


def test_supervised_run_restarts(spark, sales, tmp_path, monkeypatch):
    calls = []
    whole = runs._findings
    monkeypatch.setattr(runs, "_findings", lambda c, only: calls.append(1) or (_ for _ in ()).throw(RuntimeError("lost")) if not calls else whole(c, only))
    first = {r["stage"]: r for r in runs.run(sales, str(tmp_path), "one", target="price", task="regression", only=["Ridge"]).collect()}
    assert {s: r["status"] for s, r in first.items()} == {"input": "committed", "routing": "committed", "model": "committed", "scores": "committed", "findings": "failed", "insights": "committed", "charts": "skipped"}
    assert "lost" in first["findings"]["reason"] and first["charts"]["reason"] == "needs findings"
    monkeypatch.setattr(runs, "_supervised", lambda *a: pytest.fail("committed stages are not run again"))
    again = {r["stage"]: r for r in runs.run(sales, str(tmp_path), "one", target="price", task="regression", only=["Ridge"]).collect()}
    assert list(again) == list(runs.STAGES) and all(r["status"] == "committed" for r in again.values())
    r = runs.Run(spark, str(tmp_path), "one")
    scores = r.table("scores", "scores").join(r.table("input", "rows"), "_row")
    assert scores.count() == 400 and scores.agg(F.max(F.abs(F.col("prediction") - F.col("price")))).first()[0] < 6
    assert {"insights", "layers", "flags"} <= set(again["insights"]["sections"]) and r.table("insights", "insights").count() > 0
    assert r.table("charts", "actual_vs_predicted").count() > 0


def test_text_run(spark, tmp_path):
    words = {"good": "great lovely excellent fine superb nice", "bad": "awful poor terrible broken ugly nasty"}
    rows = [(" ".join(words[y].split()[(i * k) % 6] for k in range(1, 9)) + f" item number {i} and some more words", y) for i in range(120) for y in words]
    d = spark.createDataFrame(rows, "review string, sentiment string")
    got = {r["stage"]: r for r in runs.run(d, str(tmp_path), "t", target="sentiment").collect()}
    assert got["model"]["status"] == "committed" and "scores" in got["model"]["sections"], got["model"]["reason"]
    r = runs.Run(spark, str(tmp_path), "t")
    assert r.table("model", "metrics").first()["f1_macro"] > 0.95 and r.table("scores", "scores").count() == 240


def test_unsupervised_run(spark, tmp_path):
    k = F.col("id")
    d = spark.range(300).select((k % 3 * 10 + (k * 7919 % 100) / 100.0).alias("a"), (k % 3 * -7 + (k * 31 % 97) / 97.0).alias("b"), ((k * 17 % 89) / 89.0).alias("c"))
    got = {r["stage"]: r for r in runs.run(d, str(tmp_path), "u", only=["KMeans", "Birch"]).collect()}
    assert all(r["status"] == "committed" for r in got.values()), {s: r["reason"] for s, r in got.items()}
    r = runs.Run(spark, str(tmp_path), "u")
    assert r.table("scores", "assignments").count() == 300 and r.table("charts", "scatter").count() == 300
    assert r.table("routing", "route").first()["decided_by"] == "inference"


def test_unusable_table(spark, tmp_path):
    got = {r["stage"]: r for r in runs.run(spark.range(3), str(tmp_path), "x").collect()}
    assert got["input"]["status"] == "failed" and "too few" in got["input"]["reason"] and got["charts"]["status"] == "skipped"

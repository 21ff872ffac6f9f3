"""Distributed ways against brute force, with thresholds that force the large-table path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.operators import clustering, clusters, dbscan, drift, iforest, impute, quantiles, ranks, sampling, stats
from tabulens.operators.profile import column_profile


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    return spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 5003).cast("double")).alias("x"),
                                    (F.col("id") * 104729 % 997).cast("double").alias("y")).persist()


def test_quantiles_large_path(skewed):
    probs = [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]
    small = quantiles.exact_quantiles(skewed, ["x", "y"], probs)
    large = quantiles.exact_quantiles(skewed, ["x", "y"], probs, small_rows=10)
    for c in ("x", "y"):
        assert large[c] == pytest.approx(small[c])
    pdf = skewed.toPandas()
    assert small["x"] == pytest.approx([pdf.x.quantile(p) for p in probs])


def test_profile_paths_agree(skewed):
    assert column_profile(skewed).collect() == column_profile(skewed, small_rows=10).collect()


@pytest.mark.parametrize("settle,accuracy", [(2000, 10_000), (5, 20), (1, 100)])
def test_ranks_by_bracketing(skewed, settle, accuracy):
    """Every bracket width gives the sorted table's value and counts; a third of the rows share a value."""
    pdf = skewed.toPandas()
    wanted = {f"{c}{k}": (c, k) for c in ("x", "y", "id") for k in (0, 1, 700, 2999, 4500, 5999)}
    got = quantiles.select_ranks(skewed, wanted, settle, accuracy)
    for r, (c, k) in wanted.items():
        v = pdf[c].sort_values().iloc[k]
        assert got[r] == (v, (pdf[c] < v).sum(), (pdf[c] == v).sum()), r


def test_ranks_of_a_bracket_share_a_sketch(skewed, monkeypatch):
    """Twelve ranks of two columns, six pairs of neighbours: the first round has a sketch for each column."""
    calls, make = [], F.approx_percentile
    monkeypatch.setattr(quantiles.F, "approx_percentile", lambda *a: (calls.append(a), make(*a))[1])
    wanted = {f"{c}{k}": (c, k) for c in ("y", "id") for k in (1499, 1500, 2999, 3000, 4499, 4500)}
    pdf = skewed.toPandas()
    got = quantiles.select_ranks(skewed, wanted)
    assert len(calls) == 2
    for r, (c, k) in wanted.items():
        assert got[r][0] == pdf[c].sort_values().iloc[k]


def test_running_totals_by_ranges(spark):
    rows = [(g, float(v), v % 5 + 1, v % 3) for g in (0, 1, 2) for v in range(7, 400 * (g + 1))]
    df = spark.createDataFrame(rows, "g int, v double, a long, b long").repartition(7)
    pdf = df.toPandas().sort_values(["g", "v"])
    for one_task in (10, 10_000):
        got = ranks.running_totals(df, "g", "v", ["a", "b"], 1200, one_task).toPandas().sort_values(["g", "v"])
        assert got.a_upto.tolist() == pdf.groupby("g").a.cumsum().tolist() and got.b_upto.tolist() == pdf.groupby("g").b.cumsum().tolist()


@pytest.mark.parametrize("position", [0, 1, 1999, 2500, 6000])
def test_order_boundary(skewed, position):
    cond = quantiles.order_boundary(skewed, ["x", "id"], position)
    got = {r.id for r in skewed.where(cond).collect()}
    pdf = skewed.toPandas().sort_values(["x", "id"])
    assert got == set(pdf.id.head(position))


def test_order_boundaries_share_passes(skewed):
    positions = [-3, 0, 7, 2500, 2501, 5999, 6000, 9000]
    pdf = skewed.toPandas().sort_values(["x", "id"])
    conds = quantiles.order_boundaries(skewed, ["x", "id"], positions)
    rows = skewed.select("id", *[c.alias(f"c{i}") for i, c in enumerate(conds)]).toPandas()
    for i, p in enumerate(positions):
        assert set(rows.id[rows[f"c{i}"]]) == set(pdf.id.head(max(p, 0))), p


@pytest.mark.parametrize("floor", [1_000_000, 50])
def test_spearman_of_many_values_shuffles_rows_once_a_column(spark, floor):
    """Hot values, NULLs and a partner with holes; no row is taken apart by column and put together again."""
    k = F.col("id")
    d = spark.range(4000).select((k * 7919 % 4001).cast("double").alias("a"), F.when(k % 3 == 0, 0.0).otherwise((k * 31 % 997) + k / 5000).alias("b"),
                                 F.when(k % 5 != 0, (k * 13 % 1009).cast("double")).alias("c"), F.when(k % 7 != 0, (k % 6).cast("double")).alias("f"))
    pairs = [("a", "b"), ("c", "b"), ("f", "b"), ("c", "f"), ("a", "a")]
    got = ranks.spearman(d, pairs, one_task=500, floor=floor, spread_values=50)
    p = d.toPandas()
    for r in got.collect():
        both = p[[r.feature_a, r.feature_b]].dropna() if r.feature_a != r.feature_b else p[["a"]].dropna()
        want = both.iloc[:, 0].rank().corr(both.iloc[:, -1].rank())
        assert r.n == len(both) and r.spearman_r == pytest.approx(want, abs=1e-9)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Generate") == 1  # the sums, and their rows


def test_spearman_with_hot_value(skewed):
    pdf = skewed.toPandas()
    want = pdf.x.rank().corr(pdf.y.rank())
    for kw in ({}, {"one_task": 500, "floor": 1, "spread_values": 0}, {"one_task": 500, "floor": 1, "spread_values": 1000}):
        got = ranks.spearman(skewed, [("x", "y")], **kw).first()
        assert got["spearman_r"] == pytest.approx(want, abs=1e-9)
        assert got["n"] == 6000


def test_trends_over_given_places(spark, skewed):
    d = skewed.withColumn("z", F.when(F.col("id") % 7 != 0, F.col("y") * 2 + F.col("id")))  # NULLs: places are ranked again
    pdf = d.toPandas().sort_values(["x", "id"]).reset_index(drop=True)
    for one_task in (100, 10_000):
        got = {r.feature: r for r in drift.trends(d.repartition(5), ["x", "y", "z"], ["x", "id"], one_task=one_task).collect()}
        for f in ("x", "y", "z"):
            some = pdf[pdf[f].notna()]
            assert got[f].n == len(some)
            assert got[f].spearman_r == pytest.approx(some.index.to_series().rank().corr(some[f].rank()), abs=1e-4)
            assert got[f].early_mean == pytest.approx(pdf[f].head(1200).mean(), abs=1e-4)
            assert got[f].late_mean == pytest.approx(pdf[f].tail(1200).mean(), abs=1e-4)


def test_row_positions_and_drift_paths(spark, skewed):
    d = skewed.repartition(5)
    got = drift.row_positions(d, ["x", "id"], 6000, one_task=100).toPandas().sort_values(["x", "id"])
    assert got.position.tolist() == list(range(6000))
    a = drift.drift(d, ["x", "y"], ["id"]).orderBy("feature").collect()
    b = drift.drift(d.coalesce(1), ["x", "y"], ["id"], one_task=300).orderBy("feature").collect()
    assert a == b


def test_folds_are_even_and_stable(skewed):
    d = skewed.withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    f = sampling.stratified_folds(d, "label", ["id"], 3)
    counts = f.groupBy("label", "fold").count().toPandas()
    assert (counts.groupby("label")["count"].max() - counts.groupby("label")["count"].min()).max() <= 1
    again = sampling.stratified_folds(d.repartition(3), "label", ["id"], 3, digits=1)
    assert f.join(again, ["id", "fold"]).count() == 6000


def brute_dbscan(x, eps, m):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= m
    lab, c = -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and lab[i] < 0:
            todo, lab[i] = [i], c
            while todo:
                for v in np.flatnonzero(near[todo.pop()] & core):
                    if lab[v] < 0:
                        lab[v] = c
                        todo.append(v)
            c += 1
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    dist[:, ~core] = np.inf
    for i in np.flatnonzero(~core):
        if dist[i].min() <= eps * eps:
            lab[i] = lab[dist[i].argmin()]
    return lab


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, .5, (120, 2)), rng.normal(3, .6, (120, 2)), rng.uniform(-3, 6, (60, 2)), np.tile([[9.0, 9.0]], (150, 1))])
    want = brute_dbscan(x, 0.5, 5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r.id: r.label for r in dbscan.dbscan(df, ["a", "b"], "id", 0.5, 5).collect()}
    names = {}
    for i, w in enumerate(want):
        assert (got[i] < 0) == (w < 0)
        assert names.setdefault(got[i], w) == w
    assert len(got) == len(x) and len(set(names.values())) == len(names)


def test_dbscan_grid_matches_brute_force(spark):
    """All settings of one run, with numbers in the order of the smallest core key."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, .4, (70, 3)), rng.normal(2.5, .5, (60, 3)), rng.uniform(-3, 6, (50, 3)), np.tile([[7.0, 7.0, 7.0]], (40, 1))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(3)
    eps, least = (0.3, 0.6, 1.0, 2.0), (3, 4, 9)
    for cols in (["a", "b"], ["a", "b", "c"]):
        got = dbscan.dbscan_grid(df, cols, "id", eps, least).toPandas()
        assert len(got) == len(x) * len(eps) * len(least)
        for e in eps:
            for m in least:
                mine = got[(got.eps == e) & (got.min_samples == m)].sort_values("id").label.tolist()
                assert mine == brute_dbscan(x[:, :len(cols)], e, m).tolist(), (cols, e, m)
    status = {(r.eps, r.min_samples): r for r in dbscan.grid_status(dbscan.dbscan_grid(df, ["a", "b"], "id", (0.01, 1.0), (4,))).collect()}
    assert status[0.01, 4].status == "rejected" and status[0.01, 4].noise_pct > 60 and status[1.0, 4].status in ("candidate", "rejected")


def test_donor_blocks_are_bounded(spark):
    """A constant first column, a hot second one, and an outlier: no block outgrows its bound, boxes hold their donors."""
    d = spark.range(5400).select(F.lit("111").alias("pat"), F.array(F.lit(3.0), F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") == 1, 1e9).otherwise((F.col("id") % 11).cast("double")), (F.col("id") * 7919 % 5400).cast("double")).alias("v"), F.lit(1).alias("w"))
    leaves, tree = impute.donor_tree(d, 3, 100)
    sizes = leaves.groupBy("block").count().toPandas()
    assert sizes["count"].max() <= 100 and sizes["count"].sum() == 5400
    inside = leaves.join(tree, F.col("block") == F.col("node")).where("leaf")
    assert inside.count() == 5400 and inside.where("exists(arrays_zip(v, lo, hi), z -> z.v < z.lo or z.v > z.hi)").count() == 0
    assert tree.where("parent is null").count() == 1 and tree.where("leaf").count() == len(sizes)


@pytest.mark.parametrize("block", [1, 30])
def test_knn_fill_matches_brute_force(spark, block):
    rng = np.random.default_rng(5)
    n = 240
    x = np.round(rng.normal(0, 1, (n, 3)), 3)
    x[: n // 3] = x[0]  # many equal donors
    hole = rng.random((n, 3)) < 0.2
    hole[hole.all(1)] = False
    y = np.where(hole, np.nan, x)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    k = 4
    got = {r.id: (r.a, r.b, r.c) for r in impute.knn_fill(df, ["a", "b", "c"], ["id"], k=k, block_rows=block, needy_rows=7).collect()}
    for i in range(n):
        for j in range(3):
            if not np.isnan(y[i, j]):
                assert got[i][j] == y[i, j]
                continue
            both = ~np.isnan(y) & ~np.isnan(y[i])
            cnt = both.sum(1)
            dist = np.where(cnt > 0, np.where(both, np.nan_to_num(y - y[i]) ** 2, 0).sum(1) * 3 / np.maximum(cnt, 1), np.inf)
            ok = [(dist[r], y[r, j]) for r in range(n) if not np.isnan(y[r, j]) and np.isfinite(dist[r])]
            want = np.mean([v for _, v in sorted(ok)[:k]])
            assert got[i][j] == pytest.approx(want, abs=6e-5)


def test_mice_recovers_a_linear_relation(spark):
    df = spark.range(600).select("id", (F.col("id") % 50).cast("double").alias("a"), ((F.col("id") * 31) % 47).cast("double").alias("b"))
    df = df.withColumn("c", 2 * F.col("a") - F.col("b") + 5)
    holes = df.select("id", F.when(F.col("id") % 5 != 0, F.col("a")).alias("a"), F.when(F.col("id") % 7 != 0, F.col("b")).alias("b"), F.when(F.col("id") % 4 != 0, F.col("c")).alias("c"))
    out = impute.mice_fill(holes, ["a", "b", "c"], ridge=1e-6)
    worst = out.join(df.select("id", F.col("c").alias("t")), "id").where("id % 4 = 0 and id % 5 <> 0 and id % 7 <> 0").agg(F.max(F.abs(F.col("c") - F.col("t")))).first()[0]
    assert worst < 1.0
    assert out.where("a is null or b is null or c is null").count() == 0


def test_isolation_forest_finds_planted_rows(spark):
    df = spark.range(3000).select("id", ((F.col("id") * 7919 % 1000) / 1000).alias("a"), ((F.col("id") * 104729 % 997) / 997).alias("b"))
    df = df.withColumns({"a": F.when(F.col("id") % 300 == 0, F.col("a") + 9).otherwise(F.col("a"))})
    got = iforest.detect(df, ["a", "b"], ["id"])
    top = [r.id for r in got.orderBy(F.desc("anomaly_score")).limit(10).collect()]
    assert all(i % 300 == 0 for i in top)
    assert 0 < got.where("is_anomaly").count() <= 0.021 * 3000
    again = iforest.detect(df.repartition(3), ["a", "b"], ["id"])
    assert got.join(again, ["id", "is_anomaly"]).count() == 3000


def test_ward_merge_separates_groups():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, .1, (20, 2)) for c in (0, 5, 10)])
    lab = clustering.ward_merge(x, np.ones(60), [3])[3]
    assert [len(set(lab[i * 20:(i + 1) * 20])) for i in range(3)] == [1, 1, 1] and len(set(lab)) == 3


def test_statistics_do_not_depend_on_partitions(skewed):
    d = skewed.withColumn("c", (F.col("id") % 4).cast("long"))
    a = stats.anova(stats.cluster_moments(d.coalesce(1), "c", ["x", "y"])).orderBy("feature").collect()
    b = stats.anova(stats.cluster_moments(d.repartition(8), "c", ["x", "y"])).orderBy("feature").collect()
    assert a == b


def test_nearest_rows_match_a_full_sort_without_reading_all():
    """Ties, repeated points and far askers; twenty thousand points and two thousand askers take moments, not minutes."""
    import time

    rng = np.random.default_rng(5)
    for d, m in ((1, 3), (1, 400), (2, 400), (3, 60)):
        for points in (rng.normal(size=(m, d)), rng.integers(0, 6, (m, d)).astype(float)):
            val = rng.integers(0, 50, m).astype(float)
            asks = np.vstack([points[:20], rng.normal(size=(20, d)) * 3])
            for x, (near, dist) in zip(asks, impute.nearest_rows(points, val, asks, 5, 3)):
                full = ((points - x) ** 2).sum(1) * 3 / d
                want = np.lexsort((val, full))[:5]
                assert [*zip(dist, val[near])] == [*zip(full[want], val[want])]
    points = rng.normal(size=(20_000, 1))
    begun = time.process_time()
    impute.nearest_rows(points, points[:, 0], rng.normal(size=(2_000, 1)), 5, 2)
    assert time.process_time() - begun < 3


def test_scores_of_many_clusters(spark, monkeypatch):
    """Block by block and part by part the scores are those of the expression over all clusters, one of them a single row."""
    rng = np.random.default_rng(4)
    rows = [(c, float(rng.normal(c % 7 * 3, 0.1 + c % 5)), float(rng.normal(c // 7 * 2, 0.3)), 1.0) for c in range(40) for _ in range(1 if c == 3 else 12)] + [(-1, 99.0, 99.0, 9.0)]
    df = spark.createDataFrame(rows, "cluster long, x double, y double, z double").repartition(3)
    want = clusters.separation_scores(df, "cluster", ["x", "y", "z"])
    monkeypatch.setattr(clusters, "FEW", 5)
    monkeypatch.setattr(clusters, "LEAF", 4)
    for part in (1_000, 15):
        monkeypatch.setattr(clusters, "AT_ONCE", part)
        assert clusters.separation_scores(df, "cluster", ["x", "y", "z"]) == pytest.approx(want, abs=2e-6)


def test_a_setting_with_many_clusters_is_scored(spark):
    """2,100 groups of five points each: DBSCAN finds them, and the comparison ranks that setting."""
    rows = [(5 * g + i, float(g % 50) * 10 + i * 0.01, float(g // 50) * 10) for g in range(2100) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    board, labelled = clustering.compare(df, ["x", "y"], ["id"], density=((0.3,), (4,)), families=())
    top = board.first()
    assert (top.algorithm, top.n_clusters, top.status, top.selected) == ("DBSCAN", 2100, "success", True)
    assert top.silhouette > 0.999 and top.davies_bouldin == pytest.approx(2 * np.mean([0.02, 0.01, 0, 0.01, 0.02]) / 10, abs=1e-6)
    assert labelled["DBSCAN eps=0.3,min=4"].select("cluster").distinct().count() == 2100

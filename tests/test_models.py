"""Trained operators: trees of clustering features, randomised trees, boosting, folds, vectors."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabulens.operators import birch, models, trees, vectorize


def test_features_add_up():
    """Entries hold all rows, stay within the radius, and a tree that outgrows its bound is rebuilt coarser."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (300, 2)) for c in (0, 3, 6)] + [rng.uniform(-4, 9, (300, 2))])
    for entries in (1000, 40):
        tree = birch.CFTree(2, 0.3, entries)
        for r in x:
            tree.insert(1.0, r, float(r @ r))
        n, ls, ss = tree.entries()
        assert n.sum() == len(x) and np.allclose(ls.sum(0), x.sum(0)) and len(n) <= entries and len(n) == tree.count
        radius = np.sqrt(np.maximum(ss / n - ((ls / n[:, None]) ** 2).sum(1), 0))
        assert radius.max() <= tree.threshold + 1e-6
    assert tree.threshold > 0.3


def test_birch_merges_many_trees(spark):
    """More trees than feed one of the next level, as tables that stay spread over many tasks have them."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(c * 4 + rng.normal(0, 0.2)), float(rng.normal(0, 0.2))) for c in (np.arange(900) % 3).tolist()], "a double, b double")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n, centers = birch.features_of(df, ["a", "b"])
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert n.sum() == 900 and sorted(set(np.round(centers[:, 0] / 4).astype(int).tolist())) == [0, 1, 2]


def test_birch_over_partitions(spark):
    """Groups come out whole however the rows are spread; a third of the rows are one point; nulls have no cluster."""
    rng = np.random.default_rng(2)
    rows = [(i, float(c * 4 + rng.normal(0, 0.2)), float(rng.normal(0, 0.2)), c) for i, c in enumerate((np.arange(600) % 3).tolist())]
    rows += [(1000 + i, 50.0, 50.0, 3) for i in range(300)] + [(2000, None, 1.0, 9)]
    for parts in (1, 40):
        df = spark.createDataFrame(rows, "id long, a double, b double, g long").repartition(parts)
        got = birch.birch(df, ["a", "b"], [4, 2, 5000]).collect()
        assert len(got) == len(rows)
        groups = {}
        for r in got:
            if r["a"] is None:
                assert r["clusters"] == [None] * 3
            else:
                groups.setdefault(r["g"], set()).add(r["clusters"][0])
                assert r["clusters"][2] is None
        assert all(len(v) == 1 for v in groups.values()) and len(set().union(*groups.values())) == 4
    empty = birch.birch(df.where("false"), ["a", "b"], [2])
    assert empty.collect() == [] and empty.columns[-1] == "clusters"


@pytest.fixture(scope="module")
def rings(spark):
    """Three classes as rings (no linear boundary), with a constant and a noise feature."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        c, a = i % 3, rng.uniform(0, 2 * np.pi)
        r = 1 + 2 * c + rng.normal(0, 0.3)
        rows.append((i, [float(r * np.cos(a)), float(r * np.sin(a)), 7.0, float(rng.normal())], float(c), 1.0, i % 4 == 0))
    d = spark.createDataFrame(rows, "id long, x array<double>, label double, weight double, test boolean").withColumn("features", array_to_vector("x"))
    return d.repartition(3).persist()


def accuracy(model, d):
    return model.transform(d).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]


def test_extra_trees(spark, rings, tmp_path):
    train, test = rings.where("not test"), rings.where("test")
    model = trees.ExtraTrees("classification", trees=20, depth=9, min_leaf=2, weightCol="weight").fit(train)
    assert accuracy(model, test) > 0.9
    out = model.transform(test).select("id", vector_to_array("probability").alias("p"), "features").collect()
    assert len(out) == test.count() and all(abs(sum(r["p"]) - 1) < 1e-9 for r in out)
    share = model.featureImportances.toArray()
    assert share[2] == 0 and share[0] > share[3] and abs(share.sum() - 1) < 1e-9
    model.save(spark, str(tmp_path))
    again = trees.TreeModel.load(spark, str(tmp_path))
    assert again.transform(test).select("id", "prediction").exceptAll(model.transform(test).select("id", "prediction")).count() == 0


def test_extra_trees_split_as_they_say(rings):
    """Every split leaves min_leaf rows on both sides, thresholds lie inside the node's range, leaf values are the leaf's class shares."""
    train = rings.where("not test")
    model = trees.ExtraTrees("classification", trees=3, depth=6, min_leaf=5, weightCol="weight").fit(train)
    pdf = train.select("x", "label").toPandas()
    x, y = np.array(pdf.x.tolist()), pdf.label.to_numpy().astype(int)
    leaf = model.leaves(x)
    for t, root in enumerate(model.roots):
        todo = [(root, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            assert len(rows) >= 5
            if model.feature[n] < 0:
                assert (leaf[rows, t] == n).all() and np.allclose(model.value[n], np.bincount(y[rows], minlength=3) / len(rows))
                continue
            v = x[rows, model.feature[n]]
            assert v.min() <= model.threshold[n] <= v.max()
            todo += [(model.left[n], rows[v <= model.threshold[n]]), (model.left[n] + 1, rows[v > model.threshold[n]])]


def test_extra_trees_for_numbers(spark):
    d = spark.range(1200).select("id", ((F.col("id") * 7919 % 1200) / 100.0).alias("a"), ((F.col("id") * 31) % 17).cast("double").alias("b")).withColumn("label", F.sin("a") * 5 + F.col("b"))
    d = d.withColumn("features", array_to_vector(F.array("a", "b")))
    model = trees.ExtraTrees("regression", trees=20, depth=12, min_leaf=3).fit(d.where("id % 4 > 0"))
    got = model.transform(d.where("id % 4 = 0")).agg((1 - F.sum(F.pow(F.col("prediction") - F.col("label"), 2)) / (F.var_samp("label") * (F.count("*") - 1))).alias("r2")).first()[0]
    assert got > 0.9


def test_multinomial_boosting(rings):
    train, test = rings.where("not test"), rings.where("test")
    few, more = (trees.MultinomialBoosting(rounds=r, rate=0.3, weightCol="weight").fit(train) for r in (2, 13))
    assert accuracy(more, test) > 0.88 and accuracy(more, train) >= accuracy(few, train)
    p = np.array([r["p"] for r in more.transform(test).select(vector_to_array("probability").alias("p")).collect()])
    assert np.allclose(p.sum(1), 1) and (p > 0).all()
    assert len(more.roots) == 13 * 3 and more.featureImportances.toArray()[2] == 0


def test_first_boosting_step(spark):
    """One round of stumps without subsampling against the closed form."""
    y = [0, 0, 0, 1, 1, 2]
    d = spark.createDataFrame([(float(i), float(c)) for i, c in enumerate(y)], "a double, label double").withColumn("features", array_to_vector(F.array("a")))
    m = trees.MultinomialBoosting(rounds=1, depth=1, rate=1.0, share=1.0, min_leaf=1).fit(d)
    p = np.array([3, 2, 1]) / 6
    for c, root in enumerate(m.roots):
        r = (np.array(y) == c) - p[c]
        best = max(range(1, 6), key=lambda s: r[:s].sum() ** 2 / s + r[s:].sum() ** 2 / (6 - s))
        assert m.feature[root] == 0 and best - 1 <= m.threshold[root] < best
        for side, rows in ((0, r[:best]), (1, r[best:])):
            assert m.value[m.left[root] + side][0] == pytest.approx(2 / 3 * rows.sum() / (np.abs(rows) * (1 - np.abs(rows))).sum())


def test_fold_vocabularies(spark):
    """Counts by subtraction equal counts of the other folds' rows; a term that only a held-out fold has is unknown to it."""
    words = "alpha beta gamma delta omega kappa".split()
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 5)) + (" leak" if i % 3 == 1 else "") + f" only{i}", i % 3) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, text string, fold long")
    got = vectorize.fold_vocabularies(d, "text", "fold", 3, 40, 2, 0.95)
    for f in (None, 0, 1, 2):
        rest = d if f is None else d.where(F.col("fold") != f)
        assert got[f] == vectorize.fit_vocabulary(rest, "text", 40, 2, 0.95)
    assert "leak" not in dict(got[1][0]) and dict(got[0][0])["leak"] == 20


def test_leak_gains_nothing(spark):
    """Random labels: terms that only a held-out row has, whatever they say, leave pooled scores at chance."""
    rng = np.random.default_rng(3)
    labels = [int(rng.integers(2)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "grey", "pink", "black"], 12)) + f" label{y}of{i}", y) for i, y in enumerate(labels)]
    d = spark.createDataFrame(rows, "id long, text string, y int")
    data = models.text_frame(d, "id", "text", "y")
    spec = models.Spec("y", "classification", ["id"])
    board = models.leaderboard(data.frame.where("part = 'train'"), models.text_candidates(2, 240), spec, data.folds, frames=data.frames).collect()
    assert all(r["status"] == "success" and r["f1_macro"] < 0.65 for r in board)
    model, pred, metrics = models.text_final(data, spec, "MultinomialNB")
    assert pred.count() == data.frame.where("part = 'test'").count() and metrics.count() == 1
    new = models.score_texts(data, model, spark.createDataFrame([(1, "red blue"), (2, None), (3, "unseen")], "id long, text string"), "id", "text").collect()
    assert len(new) == 3 and all(r["prediction"] in ("0", "1") for r in new)


def test_directions_against_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((120, 70)) < 0.1) * rng.random((120, 70)) + np.outer(rng.random(120) < 0.3, rng.random(70))
    rows = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)], "id long, j array<int>, x array<double>").repartition(4)
    comp, squares = vectorize.principal_directions(rows, 70, 5)
    u, s, v = np.linalg.svd(x)
    assert np.allclose(comp.T @ comp, np.eye(5), atol=1e-9) and np.allclose(squares, s[:5] ** 2, rtol=1e-6)
    assert np.allclose(np.abs((comp * v[:5].T).sum(0)), 1, atol=1e-3)
    whole, all_squares = vectorize.principal_directions(rows, 70, 70)
    assert np.allclose(all_squares, s ** 2, atol=1e-8)


def test_directions_read_the_rows_once(spark):
    """Up to a bound of terms all steps work on one table of products; empty rows add nothing."""
    rows = spark.range(400).selectExpr("id", "array(cast(id % 40 as int), cast(40 + id % 7 as int)) as j", "array(0.8D, 0.6D + id / 4000) as x")
    rows = rows.unionByName(rows.limit(3).selectExpr("id", "cast(array() as array<int>) as j", "cast(array() as array<double>) as x"))
    sc = spark.sparkContext
    sc.setJobGroup("directions", "one pass")
    try:
        comp, squares = vectorize.principal_directions(rows, 47, 4)
        assert len(sc.statusTracker().getJobIdsForGroup("directions")) <= 8
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    x = np.zeros((403, 47))
    for i, r in enumerate(rows.collect()):
        x[i, r["j"]] = r["x"]
    assert np.allclose(vectorize._square(rows, 47), x.T @ x, atol=1e-9)
    assert np.allclose(squares, np.linalg.svd(x)[1][:4] ** 2, rtol=1e-5) and np.allclose(comp.T @ comp, np.eye(4), atol=1e-9)


def test_text_vectors_are_not_merged_in_one_task(spark):
    """A split of the vectors is dealt out: a task that merged the splits before it would hold the memory of all."""
    d = spark.range(60).selectExpr("id", "concat('word', id % 7, ' and more of word', id % 5) as t", "id % 2 as y")
    data = models.text_frame(d, "id", "t", "y", max_features=20)
    for frame in (data.frame, *data.frames.values()):
        assert frame.rdd.getNumPartitions() == 1 and "Coalesce 1" not in frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()


def test_grams_find_the_words_of_a_text_once(spark):
    df = spark.createDataFrame([(1, "Red fox red fox"), (2, "a"), (3, None), (4, "Blue"), (5, "")], "id long, t string")
    for rows in (vectorize._gram_rows(df, "t", True, "id"), vectorize._term_rows(df, "t", True, "id")):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(tuple(r) for r in vectorize._term_rows(df, "t", True, "id").collect()) == [
        (1, "fox", 0), (1, "fox", 1), (1, "fox red", 1), (1, "red", 0), (1, "red", 1), (1, "red fox", 0), (1, "red fox", 1), (4, "blue", 1)]
    assert sorted(tuple(r) for r in vectorize._gram_rows(df, "t", True, "id").collect()) == [
        (1, "fox"), (1, "fox"), (1, "fox red"), (1, "red"), (1, "red"), (1, "red fox"), (1, "red fox"), (4, "blue")]


def test_sums_left_of_thresholds_touch_own_places_only():
    """A chunk of rows pays for its own nodes, however many are open; the sums are those of a plain loop."""
    import tracemalloc

    rng = np.random.default_rng(3)
    size, tries, stat, f = 50_000, 3, 4, 3
    roots = list(range(4))
    # four trees whose roots are the only nodes; the roots take scattered places among many open nodes
    model = trees.TreeModel(0, roots, [-1] * 4, [0.0] * 4, [0] * 4, [[0.0]] * 4, np.zeros(f))
    slot = np.array([7, 20_000, -1, 49_999])
    pick, cut = np.tile(np.arange(3), (size, 1)), rng.uniform(0, 1, (size, tries))
    pick[7, 2] = -1
    x, y, w = rng.uniform(0, 1, (500, f)), rng.normal(size=500), rng.uniform(1, 2, 500)
    total = np.zeros(size * tries * stat)
    tracemalloc.start()
    got = trees._left_sums((model, roots, slot, size, pick, cut, 0, stat), x, y, w, total)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < total.nbytes / 4
    want = np.zeros((size, tries, stat))
    for s in slot[slot >= 0]:
        for c in range(tries):
            if pick[s, c] >= 0:
                go = x[:, pick[s, c]] <= cut[s, c]
                want[s, c] = [w[go].sum(), (w * y)[go].sum(), (w * y * y)[go].sum(), go.sum()]
    assert np.allclose(got.reshape(want.shape), want)


def test_frames_are_dealt_out(spark):
    """A table whose scan has one split trains on several, and keeps all rows; a small one stays together."""
    d = spark.range(60_000).coalesce(1)
    out = models.few_splits(d, 60_000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 60_000 and max(sizes) < 40_000
    assert models.few_splits(spark.range(100), 100).rdd.getNumPartitions() == 1


def test_splits_follow_the_cores(spark):
    """Every split sends sums for all nodes of a forest: a large table has no more splits than cores, up to a bound of rows."""
    cores = spark.sparkContext.defaultParallelism
    assert models.few_splits(spark.range(100), 1_200_000).rdd.getNumPartitions() == cores
    assert models.few_splits(spark.range(100), 600 * models.MOST_ROWS).rdd.getNumPartitions() == 600


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_randomised_trees_read_equal_rows_once(spark, monkeypatch, task):
    """Rows with the same features travel as one; weights, leaves and predictions are those of all rows."""
    rng = np.random.default_rng(6)
    rows = [([float(a), float(b)], float((a + b) % 3 if task == "classification" else 10 * a + b + i % 2), 1.0 + (i % 3)) for i in range(30) for a in range(6) for b in range(4)]
    d = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "x array<double>, label double, weight double").repartition(3)
    d = d.select(array_to_vector("x").alias("features"), "label", "weight")
    seen, sums = [], trees._sums
    monkeypatch.setattr(trees, "_sums", lambda r, *a: (seen.append(r.count()), sums(r, *a))[1])
    model = trees.ExtraTrees(task, trees=3, depth=12, min_leaf=30, weightCol="weight").fit(d)
    assert set(seen) == {24}
    for r in model.transform(d).select("label", "prediction", vector_to_array("features").alias("x")).distinct().collect():
        a, b = r["x"]
        assert r["prediction"] == (r["label"] if task == "classification" else pytest.approx(10 * a + b + 0.5, abs=1e-9))


def test_candidates_run_side_by_side(spark, monkeypatch):
    """Two fits wait for each other: one after the other they would never meet. A broken fit keeps its failed row."""
    import threading

    from tabulens.operators import clustering, clusters

    meet, fit = threading.Barrier(2), clustering.kmeans

    def kmeans(df, cols, k):
        if k == 4:
            raise ValueError("broken")
        meet.wait(60)
        return fit(df, cols, k)

    monkeypatch.setattr(clustering, "kmeans", kmeans)
    df = spark.createDataFrame([(i, float(i % 3 * 10 + i % 7 / 10), float(i % 5)) for i in range(60)], "id long, a double, b double")
    board, labelled = clustering.compare(df, ["a", "b"], ["id"], ks=(2, 3, 4), density=None, families=("KMeans",))
    rows = {r["params"]: r for r in board.collect()}
    assert [rows[f"k=0{k}"]["status"] for k in (2, 3, 4)] == ["success", "success", "failed"] and rows["k=04"]["reason"] == "broken"
    for name, d in labelled.items():
        s = clusters.silhouette(d, "cluster", ["a", "b"]).agg(F.avg("s")).first()[0]
        assert abs(rows[name.split()[1]]["silhouette"] - s) < 1e-6

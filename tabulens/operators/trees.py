"""Extremely randomised trees and multinomial boosting, grown level by level.

Rows stay where they are; a level costs passes that send sums per (tree, node, feature) only.
Randomised trees take two: the range of every feature in every open node, then the sums left of one
threshold drawn at random in each range. Boosting fits one tree per class and round to the softmax
gradients; the trees of a round share one histogram pass per level. A model is a table of nodes
(at most trees x 2^depth) that travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..session import cut_lineage

ROOM = 20_000_000  # numbers that a task holds for the open nodes of the trees it grows together
BINS = 32
BLOCK = 65_536  # numbers that travel as one value
SPLIT, MOST = 1_000, 500_000  # different rows of a split that randomised trees read, at least and at most
MATERIAL = 10  # rounds after which boosting writes the scores of all rows


class TreeModel:
    """Nodes of all trees: feature (-1 in leaves), threshold, left child (the right one follows), value."""

    def __init__(self, classes: int, roots: list[int], feature, threshold, left, value, gains, start=None):
        self.classes, self.roots = classes, list(roots)
        self.feature, self.threshold, self.left = np.asarray(feature, np.int64), np.asarray(threshold, float), np.asarray(left, np.int64)
        self.value, self.gains, self.start = np.asarray(value, float), np.asarray(gains, float), start

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name that the library's own models have
        total = self.gains.sum()
        return Vectors.dense(self.gains / total if total > 0 else self.gains)

    def leaves(self, x: np.ndarray, roots: list[int] | None = None) -> np.ndarray:
        """(rows, trees): the leaf of every row in every tree."""
        node = np.tile(np.asarray(self.roots if roots is None else roots, np.int64), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            node = np.where(inner, self.left[node] + (x[rows, np.maximum(f, 0)] > self.threshold[node]), node)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Mean leaf value (randomised trees), or class scores (boosting)."""
        if self.start is None:
            return self.value[self.leaves(x)].mean(1)
        out = np.tile(self.start, (len(x), 1))
        per_class = self.value[self.leaves(x), 0].reshape(len(x), -1, self.classes)  # a round's trees stand in class order
        return out + per_class.sum(1)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `prediction`, and `probability` for classes."""
        sent = df.sparkSession.sparkContext.broadcast(self)
        packed = df.withColumn("_x", vector_to_array("features"))
        fields = [f for f in packed.schema.fields if f.name not in ("features", "_x")]
        keep = [f.name for f in fields]
        at = len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for b in batches:
                raw = model.raw(_matrix(b.column(at)))
                if model.classes and model.start is not None:
                    raw = _softmax(raw)
                label = raw.argmax(1).astype(float) if model.classes else raw[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label), pa.array(raw.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, "prediction", "_p"])

        schema = StructType(list(fields)).add("_x", ArrayType(DoubleType())).add("prediction", DoubleType()).add("_p", ArrayType(DoubleType()))
        out = packed.select(*[F.col(f"`{c}`") for c in keep], "_x").mapInArrow(run, schema).withColumn("features", array_to_vector("_x"))
        if self.classes:
            out = out.withColumn("probability", array_to_vector("_p"))
        return out.drop("_x", "_p")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, int(f), float(t), int(c), [float(x) for x in v]) for i, (f, t, c, v) in enumerate(zip(self.feature, self.threshold, self.left, self.value))]
        spark.createDataFrame(rows, "node long, feature long, threshold double, left long, value array<double>").write.mode("overwrite").parquet(f"{path}/nodes")
        head = (self.classes, [int(r) for r in self.roots], [float(g) for g in self.gains], None if self.start is None else [float(s) for s in self.start])
        spark.createDataFrame([head], "classes int, roots array<long>, gains array<double>, start array<double>").write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        head = spark.read.parquet(f"{path}/head").first()
        rows = spark.read.parquet(f"{path}/nodes").orderBy("node").collect()
        cols = [[r[c] for r in rows] for c in ("feature", "threshold", "left", "value")]
        return cls(head["classes"], head["roots"], *cols, head["gains"], None if head["start"] is None else np.array(head["start"]))


def _softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _rows(df: DataFrame, weight: str | None) -> DataFrame:
    return df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))


def _alike(rows: DataFrame, classes: bool) -> DataFrame:
    """Rows that no split can part as one: (x, y, w, n, q), the weight, rows and weighted squares of all with the same features
    (and class). Sums over rows do not change by that."""
    if classes:
        return rows.groupBy("x", "y").agg(F.sum("w").alias("w"), F.count("*").cast("double").alias("n"), F.lit(0.0).alias("q")).select("x", "y", "w", "n", "q")
    y, w = F.col("y"), F.col("w")
    got = rows.groupBy("x").agg(F.sum(w).alias("w"), F.count("*").cast("double").alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q"))
    return got.select("x", F.coalesce(F.try_divide("s", "w"), F.lit(0.0)).alias("y"), "w", "n", "q")


def _sums(rows: DataFrame, sent, work, kind: str = "sum") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """work(model state, x, y, w, total so far, other columns) returns the values of one partition by place; the sums (or least and most) by place.

    Partitions send blocks of BLOCK places, which are added up where the blocks meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                y, w, *more = (part.column(i).to_numpy(zero_copy_only=False) for i in range(1, part.num_columns))
                total = work(sent.value, _matrix(part.column(0)), y, w, total, *more)
        if total is not None:
            low, high = total[0] if kind == "range" else (total, total[:0])
            for lo in range(0, len(low), BLOCK):
                a, z = low[lo:lo + BLOCK], high[lo:lo + BLOCK]
                if (np.isfinite(a) if kind == "range" else a).any():
                    yield pa.RecordBatch.from_arrays([pa.array([lo // BLOCK]), pa.array([a.tobytes()], pa.binary()), pa.array([z.tobytes()], pa.binary())], names=["block", "a", "b"])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            for a, z in zip(batch.column("a"), batch.column("b")):
                a, z = np.frombuffer(a.as_py()), np.frombuffer(z.as_py())
                if low is None:
                    low, high = a.copy(), z.copy()
                elif kind == "range":
                    np.fmin(low, a, out=low)
                    np.fmax(high, z, out=high)
                else:
                    low += a
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([low.tobytes()], pa.binary()), pa.array([high.tobytes()], pa.binary())], names=["block", "a", "b"])

    schema = "block long, a binary, b binary"
    got = rows.mapInArrow(run, schema).groupBy("block").applyInArrow(meet, schema).toArrow()  # a number per open node and feature (or candidate) at most
    at, low, high = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
    for block, a, z in zip(got.column("block").to_pylist(), got.column("a"), got.column("b")):
        a, z = np.frombuffer(a.as_py()), np.frombuffer(z.as_py())
        some = np.flatnonzero(np.isfinite(a) if kind == "range" else a)
        at.append(block * BLOCK + some)
        low.append(a[some])
        high.append(z[some] if kind == "range" else np.zeros(len(some)))
    return np.concatenate(at), np.concatenate(low), np.concatenate(high)


class _Growing:
    """Node lists of trees that are still growing."""

    def __init__(self, features: int):
        self.feature, self.threshold, self.left, self.value, self.stats, self.depth = [], [], [], [], [], []
        self.gains = np.zeros(features)

    def add(self, value, stats, depth: int) -> int:
        for where, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.value, value), (self.stats, stats), (self.depth, depth)):
            where.append(x)
        return len(self.feature) - 1

    def model(self, classes: int, roots: list[int], start=None) -> TreeModel:
        return TreeModel(classes, roots, self.feature, self.threshold, self.left, self.value, self.gains, start)


class ExtraTrees:
    """Extremely randomised trees: all rows, and one random threshold for every candidate feature of a node.

    Classes are weighed by `weightCol`; a split leaves at least `min_leaf` rows on both sides. Candidates are
    the square root of the features for classes, all of them for numbers; constant ones do not count. Rows with equal
    features (and class) travel as one."""

    def __init__(self, task: str, trees: int = 80, depth: int = 12, min_leaf: int = 2, weightCol: str | None = None, seed: int = 43):  # noqa: N803
        self.task, self.trees, self.depth, self.min_leaf, self.weight, self.seed = task, trees, depth, min_leaf, weightCol, seed

    def fit(self, df: DataFrame) -> TreeModel:
        alike = _alike(_rows(df, self.weight), self.task == "classification").persist()
        n, cores = alike.count(), df.sparkSession.sparkContext.defaultParallelism
        rows = alike.repartition(max(1, min(n // SPLIT, max(cores, n // MOST)))).persist()
        try:
            return self._fit(rows)
        finally:
            rows.unpersist()
            alike.unpersist()

    def _fit(self, rows: DataFrame) -> TreeModel:
        head = rows.agg(F.max(F.size("x")).alias("f"), F.max("y").alias("k")).first()
        f, k = head["f"], int(head["k"]) + 1 if self.task == "classification" else 0
        stat = k + 1 if k else 4  # class weights and rows; or weight, sum, squares and rows
        if k:
            per = {int(r["y"]): r for r in rows.groupBy("y").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()}  # one row per class
            top = np.array([per[c]["w"] if c in per else 0.0 for c in range(k)] + [sum(r["n"] for r in per.values())], float)
        else:
            r = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.sum("q"), F.sum("n")).first()
            top = np.array(r, float)
        tries = max(1, int(np.sqrt(f))) if k else f
        g = _Growing(f)
        roots = [g.add(self._value(top, k), top, 0) for _ in range(self.trees)]
        owner = {r: t for t, r in enumerate(roots)}
        rngs = [np.random.default_rng([self.seed, t]) for t in range(self.trees)]
        frontier = [r for r in roots if self._open(g, r, k)]
        sc = rows.sparkSession.sparkContext
        while frontier:
            later = []
            step = max(1, ROOM // max(f * 2, tries * stat))
            for lo in range(0, len(frontier), step):
                part = frontier[lo:lo + step]
                trees = sorted({owner[n] for n in part})
                model, own = g.model(k, roots), [roots[t] for t in trees]
                slot = np.full(len(g.feature), -1)
                slot[part] = np.arange(len(part))
                at, low, high = _sums(rows, sc.broadcast((model, own, slot, len(part), f)), _ranges, "range")
                lo_of, hi_of = np.full(len(part) * f, np.nan), np.full(len(part) * f, np.nan)
                lo_of[at], hi_of[at] = low, high
                pick, cut = np.full((len(part), tries), -1), np.zeros((len(part), tries))
                for s, n in enumerate(part):
                    a, z = lo_of[s * f:(s + 1) * f], hi_of[s * f:(s + 1) * f]
                    rng = rngs[owner[n]]
                    some = rng.permutation(np.flatnonzero(a < z))[:tries]
                    pick[s, :len(some)] = some
                    cut[s, :len(some)] = rng.uniform(a[some], z[some])
                at, got, _ = _sums(rows, sc.broadcast((model, own, slot, len(part), pick, cut, k, stat)), _left_sums)
                left = np.zeros(len(part) * tries * stat)
                left[at] = got
                later += self._split(g, part, owner, pick, cut, left.reshape(len(part), tries, stat), k)
            frontier = later
        return g.model(k, roots)

    def _value(self, s: np.ndarray, k: int) -> np.ndarray:
        return s[:k] / max(s[:k].sum(), 1e-300) if k else np.array([s[1] / max(s[0], 1e-300)])

    def _impurity(self, s: np.ndarray, k: int) -> np.ndarray:
        """Weighted impurity: Gini for classes, squared error for numbers."""
        w = s[..., :k].sum(-1) if k else s[..., 0]
        safe = np.maximum(w, 1e-300)
        return w - (s[..., :k] ** 2).sum(-1) / safe if k else s[..., 2] - s[..., 1] ** 2 / safe

    def _open(self, g: _Growing, n: int, k: int) -> bool:
        s = g.stats[n]
        return g.depth[n] < self.depth and s[-1] >= 2 * self.min_leaf and self._impurity(s, k) > 1e-9 * max(1.0, abs(s[2]) if not k else 1.0)

    def _split(self, g, part, owner, pick, cut, left, k) -> list[int]:
        """left: (node, candidate, sums left of it). Gains are taken for a few thousand nodes at once."""
        out = []
        for lo in range(0, len(part), 4096):
            some = slice(lo, lo + 4096)
            top = np.array([g.stats[n] for n in part[some]], float)[:, None]
            right = top - left[some]
            ok = (pick[some] >= 0) & (left[some, :, -1] >= self.min_leaf) & (right[..., -1] >= self.min_leaf)
            gain = np.where(ok, self._impurity(top, k) - self._impurity(left[some], k) - self._impurity(right, k), -np.inf)
            choice = gain.argmax(1)
            for i in np.flatnonzero(gain[np.arange(len(gain)), choice] > 0):
                n, c = part[lo + i], choice[i]
                f = int(pick[lo + i, c])
                g.feature[n], g.threshold[n] = f, float(cut[lo + i, c])
                g.gains[f] += gain[i, c]
                kids = [g.add(self._value(x, k), x, g.depth[n] + 1) for x in (left[lo + i, c].copy(), right[i, c].copy())]
                g.left[n] = kids[0]
                for x in kids:
                    owner[x] = owner[n]
                    if self._open(g, x, k):
                        out.append(x)
        return out


def _ranges(state, x, y, w, total, *_):
    """Least and most of every feature in every open node."""
    model, own, slot, size, f = state
    low, high = total[0] if total else (np.full(size * f, np.inf), np.full(size * f, -np.inf))
    low2, high2 = low.reshape(size, f), high.reshape(size, f)
    node = model.leaves(x, own)
    for t in range(node.shape[1]):
        s = slot[node[:, t]]
        order = np.argsort(s, kind="stable")[np.count_nonzero(s < 0):]
        if len(order):
            edge = np.flatnonzero(np.diff(s[order], prepend=-1))
            names = s[order][edge]
            low2[names] = np.minimum(low2[names], np.minimum.reduceat(x[order], edge))
            high2[names] = np.maximum(high2[names], np.maximum.reduceat(x[order], edge))
    return [(low, high)]


def _left_sums(state, x, y, w, total, n=None, q=None):
    """Sums left of each candidate threshold of every open node. n, q: rows and weighted squares where a row stands for several."""
    model, own, slot, size, pick, cut, k, stat = state
    tries = pick.shape[1]
    total = np.zeros(size * tries * stat) if total is None else total
    n, q = np.ones(len(x)) if n is None else n, w * y ** 2 if q is None else q
    node = model.leaves(x, own)
    cells = total.reshape(size, tries, stat)
    for t in range(node.shape[1]):
        s = slot[node[:, t]]
        rows = np.argsort(s, kind="stable")[np.count_nonzero(s < 0):]
        if not len(rows):
            continue
        at = s[rows]
        f = pick[at]
        go = (f >= 0) & (x[rows[:, None], np.maximum(f, 0)] <= cut[at])
        if k:
            r, c = np.nonzero(go)
            base = (at[r] * tries + c) * stat
            np.add.at(total, base + y[rows[r]].astype(np.int64), w[rows[r]])
            np.add.at(total, base + k, n[rows[r]])
        else:
            edge = np.flatnonzero(np.diff(at, prepend=-1))
            for j, v in enumerate((w[rows], w[rows] * y[rows], q[rows], n[rows])):
                cells[at[edge], :, j] += np.add.reduceat(np.where(go, v[:, None], 0.0), edge, axis=0)
    return total


class MultinomialBoosting:
    """Gradient boosting on the softmax loss: one tree per class and round, on a random share of the rows.

    Trees of a round share their passes; leaf values are one Newton step. Rows weigh `weightCol`."""

    def __init__(self, rounds: int = 100, depth: int = 4, rate: float = 0.05, share: float = 0.85, min_leaf: int = 2, weightCol: str | None = None, seed: int = 42):  # noqa: N803
        self.rounds, self.depth, self.rate, self.share, self.min_leaf, self.weight, self.seed = rounds, depth, rate, share, min_leaf, weightCol, seed

    def fit(self, df: DataFrame) -> TreeModel:
        rows = cut_lineage(_rows(df, self.weight))
        sc = rows.sparkSession.sparkContext
        f = rows.agg(F.max(F.size("x"))).first()[0]
        per = {int(r["y"]): r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}  # one row per class
        k = max(per) + 1
        prior = np.array([max(per.get(c, 0.0), 1e-9) for c in range(k)])
        start = np.log(prior / prior.sum())
        q = rows.agg(*[F.approx_percentile(F.col("x")[i], F.array(*[F.lit(b / BINS) for b in range(1, BINS)]), F.lit(10_000)) for i in range(f)]).first()
        edges = np.full((f, BINS - 1), np.inf)
        for i, e in enumerate(q):
            own = np.unique(np.array(e, float))
            edges[i, :len(own)] = own
        g, roots = _Growing(f), []
        scored, done = rows.withColumn("s", F.array(*[F.lit(float(v)) for v in start])), 0
        for r in range(self.rounds):
            if r - done == MATERIAL:
                scored = cut_lineage(self._rescored(scored, g.model(k, roots[done * k:]), sc))
                done = r
            mine = [g.add([0.0], None, 0) for _ in range(k)]
            roots += mine
            frontier = list(mine)
            for level in range(self.depth + 1):
                if not frontier:
                    break
                slot = np.full(len(g.feature), -1)
                slot[frontier] = np.arange(len(frontier))
                state = (g.model(k, roots[done * k:r * k] or mine), r > done, mine, slot, len(frontier), edges, k, [self.seed, r], self.share)
                at, got, _ = _sums(_flat(scored), sc.broadcast(state), _histograms)
                table = np.zeros(len(frontier) * f * BINS * 3)
                table[at] = got
                frontier = self._split(g, frontier, table.reshape(len(frontier), f, BINS, 3), edges, k, level)
        return g.model(k, roots, start)

    def _rescored(self, scored: DataFrame, model: TreeModel, sc) -> DataFrame:
        sent = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b in batches:
                s = _matrix(b.column(3)) + m.value[m.leaves(_matrix(b.column(0))), 0].reshape(b.num_rows, -1, m.classes).sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s.tolist(), pa.list_(pa.float64()))], names=["x", "y", "w", "s"])

        return scored.mapInArrow(run, scored.schema)

    def _split(self, g, frontier, table, edges, k, level) -> list[int]:
        """Leaf values, and the best split of every node that may go on. table: (node, feature, bin, (weight of curvature, gradient, rows))."""
        out = []
        for s, n in enumerate(frontier):
            h, r, c = table[s, 0].sum(0)
            g.value[n] = [self.rate * (k - 1) / k * r / max(h, 1e-12)] if c else [0.0]
            if level == self.depth or c < 2 * self.min_leaf:
                continue
            left = table[s].cumsum(1)[:, :-1]
            lc, lr = left[..., 2], left[..., 1]
            rc, rr = c - lc, r - lr
            ok = (lc >= self.min_leaf) & (rc >= self.min_leaf) & np.isfinite(edges)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, lr ** 2 / lc + rr ** 2 / rc - r ** 2 / c, -np.inf)
            i, b = divmod(int(gain.argmax()), gain.shape[1])
            if not gain[i, b] > 1e-12:
                continue
            g.feature[n], g.threshold[n] = i, float(edges[i, b])
            g.gains[i] += gain[i, b]
            kids = [g.add([0.0], None, level + 1) for _ in range(2)]
            g.left[n] = kids[0]
            out += kids
        return out


def _flat(scored: DataFrame) -> DataFrame:
    """Features and scores in one array, as the passes read them."""
    return scored.select(F.concat("x", "s").alias("x"), "y", "w")


def _histograms(state, x, y, w, total):
    model, some, mine, slot, size, edges, k, seed, share = state
    f = edges.shape[0]
    x, s = x[:, :f], x[:, f:]
    if some:
        s = s + model.value[model.leaves(x), 0].reshape(len(x), -1, k).sum(1)
    # rows of a round by a hash of their values, so that a repeated task draws the same ones
    draw = (np.ascontiguousarray(x).view(np.uint64).sum(1) + np.uint64(seed[1] * 2654435761 + seed[0])) * np.uint64(0x9E3779B97F4A7C15)
    used = (draw >> np.uint64(11)).astype(float) / 2.0 ** 53 < share
    x, s, y, w = x[used], s[used], y[used], w[used]
    total = np.zeros(size * f * BINS * 3) if total is None else total
    if not len(x):
        return total
    p = _softmax(s)
    node = model.leaves(x, mine)
    bins = np.column_stack([np.searchsorted(edges[i], x[:, i], "left") for i in range(f)])
    for c in range(k):
        at = slot[node[:, c]]
        rows = np.flatnonzero(at >= 0)
        if not len(rows):
            continue
        r = (y[rows] == c) - p[rows, c]
        values = np.stack([w[rows] * np.abs(r) * (1 - np.abs(r)), w[rows] * r, np.ones(len(rows))])
        first, last = int(at[rows].min()), int(at[rows].max()) + 1
        mine_of = total[first * f * BINS * 3:last * f * BINS * 3]  # the class's own nodes
        for i in range(f):
            base = (((at[rows] - first) * f + i) * BINS + bins[rows, i]) * 3
            for j in range(3):
                mine_of += np.bincount(base + j, weights=values[j], minlength=len(mine_of))
    return total

"""Cluster profiles, quality measures and rankings for given cluster labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import band
from ..session import cut_lineage
from .ranks import lookup, number_rows
from .stats import _global


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, size, size_pct) without noise (negative labels)."""
    d = df.where(F.col(cluster) >= 0).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"))
    return d.withColumn("size_pct", F.round(100.0 * F.col("size") / F.sum("size").over(W.partitionBy(F.lit(1))), 2))


def size_balance(sizes: DataFrame) -> DataFrame:
    """One row: extremes, imbalance ratio and small clusters (below 5%)."""
    return sizes.agg(F.count("*").alias("n_clusters"), F.max("size").alias("largest"), F.min("size").alias("smallest"),
                     F.round(F.max("size") / F.greatest(F.min("size"), F.lit(1)), 4).alias("imbalance_ratio"),
                     F.count_if(F.col("size_pct") < 5).alias("small_clusters"))


def distinctive_features(moments: DataFrame, top: int = 6) -> DataFrame:
    """Per cluster the features whose mean differs most from the global mean."""
    d = _global(moments).where("cluster >= 0").withColumn("diff", F.col("mean") - F.col("gmean"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.abs("diff")), "feature"))
    return (d.withColumn("place", place.cast("long")).where(F.col("place") <= top)
            .select("cluster", "place", "feature", F.round("mean", 6).alias("cluster_mean"),
                    F.round("gmean", 6).alias("global_mean"), F.round("diff", 6).alias("difference"),
                    F.when(F.col("diff") > 0, "higher").otherwise("lower").alias("direction")))


def cluster_labels(distinct: DataFrame) -> DataFrame:
    """(cluster, label): name from the most distinctive feature."""
    return distinct.where("place = 1").select("cluster", F.concat(
        F.initcap("direction"), F.lit(" "), "feature", F.lit(" segment")).alias("label"))


def cluster_profiles(df: DataFrame, cluster: str, moments: DataFrame, key: str, rows: int = 10) -> DataFrame:
    """One row per cluster: size, share, label, distinctive features, first keys."""
    best = distinctive_features(moments)
    names = best.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "feature"))),
                                                                 lambda s: s["feature"]), ",").alias("distinctive"))
    # the smallest keys per cluster: partial top-k on hashed parts first, so a large cluster is never sorted whole
    part = df.where(F.col(cluster) >= 0).select(F.col(cluster).alias("cluster"), F.col(key).alias("k"),
                                                F.pmod(F.xxhash64(key), F.lit(64)).alias("_s"))
    near = part.withColumn("_r", F.row_number().over(W.partitionBy("cluster", "_s").orderBy("k"))).where(F.col("_r") <= rows)
    firsts = near.groupBy("cluster").agg(F.array_join(F.slice(F.sort_array(F.collect_list("k")), 1, rows).cast("array<string>"), ",").alias("sample_keys"))
    d = cluster_sizes(df, cluster)
    for side in (cluster_labels(best), names, firsts):  # one row per cluster
        d = d.join(F.broadcast(side), "cluster", "left")
    return d


def segment_contrast(distinct: DataFrame, least: float = 0.30, per_cluster: int = 2) -> DataFrame:
    """Features whose cluster means spread by more than 30% of the global mean."""
    d = distinct.where(F.col("place") <= per_cluster).groupBy("feature").agg(
        F.count("*").alias("n"), (F.max("cluster_mean") - F.min("cluster_mean")).alias("range"),
        F.max_by("cluster", F.struct("cluster_mean", -F.col("cluster"))).alias("high_segment"),
        F.min_by("cluster", F.struct("cluster_mean", "cluster")).alias("low_segment"), F.first("global_mean").alias("g"))
    norm = F.col("range") / F.greatest(F.abs("g"), F.lit(1e-9))
    return (d.where((F.col("n") >= 2) & (norm > least))
            .select("feature", F.round("range", 4).alias("range"), F.round(norm, 4).alias("norm_range"), "high_segment", "low_segment"))


def bipolar_features(distinct: DataFrame, per_cluster: int = 3) -> DataFrame:
    """Features above the average in some clusters and below it in others."""
    d = distinct.where(F.col("place") <= per_cluster).groupBy("feature").agg(
        F.count_if(F.col("direction") == "higher").alias("n_higher"), F.count_if(F.col("direction") == "lower").alias("n_lower"))
    return d.where("n_higher > 0 and n_lower > 0")


# --- separation measures --------------------------------------------------------------------

def _vectors(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    return df.where(F.col(cluster) >= 0).select(F.col(cluster).cast("long").alias("cluster"),
                                                F.array(*[F.col(c).cast("double") for c in features]).alias("v"))


def centroids(df: DataFrame, cluster: str, features: Sequence[str], most: int) -> list:
    """Collected (cluster, n, mean vector): one row per cluster, `most` of them at most."""
    rows = df.where(F.col(cluster) >= 0).groupBy(F.col(cluster).cast("long").alias("cluster")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(F.col(c).cast("double")) for c in features]).alias("m")).limit(most).collect()
    return sorted(rows, key=lambda r: r["cluster"])


def _squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def _spread(df: DataFrame, cluster: str, features: Sequence[str], cents: list, center: Sequence[float]) -> dict:
    """Mean distance and summed squared distance to the own centroid, and the mean squared distance to `center`, per cluster."""
    table = F.create_map(*[x for r in cents for x in (F.lit(r["cluster"]), F.array(*[F.lit(float(v)) for v in r["m"]]))])
    d = _vectors(df, cluster, features).withColumn("m", F.element_at(table, F.col("cluster")))
    sq = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    rows = d.select("cluster", sq.alias("q"), _squares(_moved("v", center)).alias("g")).groupBy("cluster").agg(
        F.avg(F.sqrt("q")).alias("s"), F.sum("q").alias("ss"), F.avg("g").alias("g")).collect()
    return {r["cluster"]: (r["s"], r["ss"], r["g"]) for r in rows}


def _moved(v: str, center: Sequence[float]) -> Column:
    return F.zip_with(v, F.array(*[F.lit(float(g)) for g in center]), lambda a, g: a - g)


FEW = 64  # clusters that are compared with every row inside one expression
AT_ONCE = 250_000  # clusters that a task holds
LEAF = 256  # clusters of a compact block


class ClusterBlocks:
    """Clusters (mean, mean distance `s` and mean squared distance `q` to it) in compact blocks, halved across their widest
    coordinate; a bound tells which blocks a row need not meet."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, s: np.ndarray, q: np.ndarray):
        self.blocks, todo = [], [np.arange(len(ids))]
        while todo:
            at = todo.pop()
            if len(at) > LEAF:
                axis = int(np.ptp(m[at], axis=0).argmax())
                order = at[np.argpartition(m[at, axis], len(at) // 2)]
                todo += [order[:len(at) // 2], order[len(at) // 2:]]
            elif len(at):
                self.blocks.append((ids[at], m[at], s[at], q[at]))
        self.low, self.high = (np.array([f(b[1], axis=0) for b in self.blocks]) for f in (np.min, np.max))
        self.q, self.s = np.array([b[3].min() for b in self.blocks]), np.array([b[2].max() for b in self.blocks])

    def _gaps(self, x: np.ndarray) -> np.ndarray:
        """(rows, blocks): squared distance from every row to every box."""
        out = np.zeros((len(x), len(self.blocks)))
        for i in range(x.shape[1]):
            out += np.maximum(0.0, np.maximum(self.low[:, i] - x[:, i:i + 1], x[:, i:i + 1] - self.high[:, i])) ** 2
        return out

    def _search(self, bound: np.ndarray, measure) -> np.ndarray:
        """The least measure(block, rows) of every row, where bound (rows, blocks) is never above it."""
        best, first = np.full(len(bound), np.inf), bound.argmin(1)
        for own in (True, False):  # the block that promises most comes first
            for b in range(bound.shape[1]):
                rows = np.flatnonzero(first == b if own else (first != b) & (bound[:, b] < best))
                if len(rows):
                    best[rows] = np.minimum(best[rows], measure(b, rows))
        return best

    def nearest(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Least mean squared distance from every row to the rows of another cluster."""
        def measure(b, rows):
            ids, m, _, q = self.blocks[b]
            gap = ((x[rows, None] - m[None]) ** 2).sum(-1) + q
            return np.where(own[rows, None] == ids, np.inf, gap).min(1)

        return self._search(self._gaps(x) * (1 - 1e-12) + self.q, measure)

    def likest(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Greatest (s + s of the other cluster) / distance between the means, 0 for equal means."""
        def measure(b, rows):
            _, m, t, _ = self.blocks[b]
            gap = np.sqrt(((x[rows, None] - m[None]) ** 2).sum(-1))
            return -np.where(gap > 0, (s[rows, None] + t) / gap, 0.0).max(1)

        with np.errstate(divide="ignore", invalid="ignore"):
            bound = -(s[:, None] + self.s) / np.sqrt(self._gaps(x) * (1 - 1e-12))
            return np.maximum(0.0, -self._search(np.where(np.isnan(bound), 0.0, bound), measure))


def _against(rows: DataFrame, table: DataFrame, name: str, rest: float, ask) -> DataFrame:
    """`rows` with `name`, the best of ask(blocks, x, own, s, the value so far) over all clusters of `table`, AT_ONCE of them at a
    time. rows: (cluster, n, x, s, ...); x is an array without nulls."""
    parts = -(-table.count() // AT_ONCE)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    at = {c: rows.columns.index(c) for c in ("cluster", "x", "s")}
    cur = rows.withColumn(name, F.lit(float(rest)))
    for p in range(parts):
        got = table.where(F.pmod(F.xxhash64("cluster"), F.lit(parts)) == p).select("cluster", "m", "s", "q").toArrow()
        ids, s, q = (got.column(c).to_numpy() for c in ("cluster", "s", "q"))
        if not len(ids):
            continue
        m = got.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        sent = rows.sparkSession.sparkContext.broadcast(ClusterBlocks(ids, m, s, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = sent.value
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    x = part.column(at["x"]).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    own, t, so_far = (part.column(i).to_numpy(zero_copy_only=False) for i in (at["cluster"], at["s"], part.num_columns - 1))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ask(blocks, x, own, t, so_far))], names=part.schema.names)

        cur = cur.mapInArrow(run, schema)
        if p < parts - 1:
            cur = cut_lineage(cur)
    return cur


def _scores_of_many(df: DataFrame, cluster: str, features: Sequence[str], k: int, n: int) -> dict:
    """The same scores for any number of clusters: they stay a table, AT_ONCE of which meet the rows at a time."""
    d = _vectors(df, cluster, features)
    means = cut_lineage(d.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(len(features))]).alias("m")))
    met = lambda rows, table, *cols: lookup(rows, table.select("cluster", *cols, F.col("n").alias("_w")), ["cluster"], "_w", n)
    sq = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    rows = met(d, means, "n", "m").withColumn("e", sq)
    per = rows.groupBy("cluster").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.avg(F.sqrt("e")).alias("s"), F.sum("e").alias("ss"), F.avg("e").alias("q"))
    per = cut_lineage(per)
    whole = F.array(*[F.sum(F.col("n") * F.get("m", F.lit(i))) / F.sum("n") for i in range(len(features))])
    center = F.array(*[F.lit(float(g)) for g in per.agg(whole.alias("g")).first()["g"]])
    off = F.aggregate(F.zip_with("m", center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    one = per.agg(F.sum(F.col("n") * off).alias("between"), F.sum("ss").alias("within")).first()
    db = _against(per.select("cluster", "n", F.col("m").alias("x"), "s"), per, "r", 0.0, lambda blocks, x, _own, s, r: np.maximum(r, blocks.likest(x, s))).agg(F.avg("r")).first()[0]
    asks = met(d.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))), per, "n", "m", "s", "q").withColumn("e", sq)
    own = (F.col("e") + F.col("q")) * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    asks = asks.select("cluster", "n", F.col("v").alias("x"), "s", own.alias("a"))
    far = _against(asks, per, "b", float("inf"), lambda blocks, x, own, _s, b: np.minimum(b, blocks.nearest(x, own)))
    sil = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    total = far.agg(F.sum(sil)).first()[0] or 0.0  # rows without a coordinate score 0
    ch = 1.0 if one["within"] == 0 else one["between"] * (n - k) / (one["within"] * (k - 1.0))
    return {"silhouette": round(float(total / n), 6), "davies_bouldin": round(float(db), 6), "calinski_harabasz": round(float(ch), 6), "n_clusters": k}


def separation_scores(df: DataFrame, cluster: str, features: Sequence[str]) -> dict:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz, all from aggregates over all rows, whatever the number of clusters."""
    bad = {"silhouette": -1.0, "davies_bouldin": 99.0, "calinski_harabasz": -1.0, "n_clusters": 0}
    cents = centroids(df, cluster, features, FEW + 1)
    if len(cents) > FEW:
        sizes = df.where(F.col(cluster) >= 0).groupBy(F.col(cluster).cast("long").alias("c")).agg(F.count("*").alias("n"))
        k, n = sizes.agg(F.count("*"), F.sum("n")).first()
        return _scores_of_many(df, cluster, features, k, n) if k < n else bad | {"n_clusters": k}
    n, k = sum(r["n"] for r in cents), len(cents)
    bad["n_clusters"] = k
    if k < 2 or k >= n:
        return bad
    m = np.array([r["m"] for r in cents], float)
    size = np.array([r["n"] for r in cents], float)
    center = (m * size[:, None]).sum(0) / n
    sp = _spread(df, cluster, features, cents, center)
    s = np.array([sp[r["cluster"]][0] for r in cents], float)
    gap = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(gap > 0, (s[:, None] + s[None, :]) / gap, 0.0)
    np.fill_diagonal(ratio, 0.0)
    db = float(ratio.max(axis=1).mean())
    between = float((size * ((m - center) ** 2).sum(1)).sum())
    within = sum(sp[r["cluster"]][1] for r in cents)
    ch = 1.0 if within == 0 else between * (n - k) / (within * (k - 1.0))
    known = [(r["cluster"], r["n"], [float(x) for x in a - center], sp[r["cluster"]][2]) for r, a in zip(cents, m)]
    table = df.sparkSession.createDataFrame([(known,)], "t array<struct<cluster: long, n: long, m: array<double>, q: double>>")
    sil = _silhouette(df, cluster, features, center, table).agg(F.avg("s")).first()[0]
    return {"silhouette": round(float(sil if sil is not None else -1.0), 6), "davies_bouldin": round(db, 6),
            "calinski_harabasz": round(float(ch), 6), "n_clusters": k}


def silhouette(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """(cluster, s) of every row, with squared Euclidean distances; noise (negative labels) is left out.

    The mean squared distance of a row to a cluster follows from the cluster's size, mean and
    mean squared norm, so one aggregate and one pass over the rows do, whatever their number.
    A row that is alone in its cluster scores 0.
    """
    first = df.where(F.col(cluster) >= 0).agg(*[F.avg(F.col(c).cast("double")).alias(f"g{i}") for i, c in enumerate(features)]).first()
    center = [float(g or 0.0) for g in first]
    d = _vectors(df, cluster, features).select("cluster", _moved("v", center).alias("v"))
    per = d.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(len(features))]).alias("m"), F.avg(_squares(F.col("v"))).alias("q"))
    return _silhouette(df, cluster, features, center, per.agg(F.sort_array(F.collect_list(F.struct("cluster", "n", "m", "q"))).alias("t")))


def _silhouette(df: DataFrame, cluster: str, features: Sequence[str], center: Sequence[float], table: DataFrame) -> DataFrame:
    """(cluster, s) from a one-row `table` whose `t` has (cluster, n, m, q) of every cluster; means and norms are seen from `center`."""
    # distances do not change when all vectors move; small numbers keep them exact
    d = _vectors(df, cluster, features).select("cluster", _moved("v", center).alias("v"))
    d = d.withColumn("q", _squares(F.col("v")))
    gap = lambda r: F.greatest(F.lit(0.0), F.col("q") + r["q"] - 2.0 * F.aggregate(F.zip_with("v", r["m"], lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    far = F.transform("t", lambda r: F.struct(r["cluster"].alias("cluster"), r["n"].alias("n"), gap(r).alias("d")))
    d = d.join(F.broadcast(table), F.lit(True)).select("cluster", far.alias("far"))
    own = F.get(F.filter("far", lambda r: r["cluster"] == F.col("cluster")), F.lit(0))
    other = F.array_min(F.transform(F.filter("far", lambda r: r["cluster"] != F.col("cluster")), lambda r: r["d"]))
    d = d.select("cluster", own["n"].alias("n"), (own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), other.alias("b"))
    s = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return d.select("cluster", s.alias("s"))


def quality_report(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: quality level, confidence, imbalance and output policy."""
    bal = size_balance(sizes).select(F.col("imbalance_ratio"))
    d = scores.join(F.broadcast(bal), F.lit(True))  # one row each
    sil = F.col("silhouette")
    level = band(sil, [(0.50, "High"), (0.25, "Moderate")], "Low")
    conf = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround((sil + 1) / 2 * 100, 0))).cast("long")
    return d.select(level.alias("level"), conf.alias("confidence_score"), "n_clusters", "silhouette", "davies_bouldin",
                    "calinski_harabasz", F.col("imbalance_ratio").alias("cluster_size_imbalance_ratio"),
                    (F.col("imbalance_ratio") >= 10).alias("imbalance_warning"), (level != "Low").alias("show_full_dashboard"),
                    (level == "High").alias("allow_decision_language"), (level != "High").alias("caution_required"),
                    (level == "Low").alias("mark_exploratory"))


def rank_candidates(scores: DataFrame) -> DataFrame:
    """Combined clustering score and rank; one row per candidate, failed ones last."""
    ok = F.col("status") == "success"
    best_ch = F.max(F.when(ok, F.col("calinski_harabasz"))).over(W.partitionBy(F.lit(1)))
    main = F.round(0.60 * F.col("silhouette") + 0.25 / (1 + F.greatest("davies_bouldin", F.lit(0.0)))
                   + 0.15 * F.when(best_ch > 0, F.col("calinski_harabasz") / best_ch).otherwise(0.0), 6)
    d = scores.withColumn("main_score", F.when(ok, main))
    d = number_rows(d, [F.desc(ok), F.desc("main_score"), F.desc("silhouette"), "davies_bouldin",
                        F.desc("calinski_harabasz"), "algorithm", "params"])
    gap = F.first("main_score").over(W.orderBy("rank")) - F.col("main_score")
    return d.withColumns({"gap": F.round(gap, 6), "selected": (F.col("rank") == 1) & ok})

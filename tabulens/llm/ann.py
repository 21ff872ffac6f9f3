"""Nearest neighbours with learned partitions.

A bounded sample gives a neighbour graph, which is cut into parts of equal size with few edges
between them; a small classifier learns which parts hold a vector's neighbours. Every vector is
indexed in its most probable part, and a query visits its most probable parts, as many as a
held-out share of the sample needed for the wanted recall. All vectors of the visited parts are
ranked by their exact distance.

Equal vectors are one entry with its smallest ids, so a vector that fills a third of the table
costs one comparison. A part is searched in blocks of a bounded number of entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

SAMPLE = 8000  # different vectors that are learned from, about
PER_PART = 125  # sample vectors per part
NEIGHBOURS = 10  # of a sample vector in the graph
BLOCK = 4096  # entries of a part that one group holds, and queries
RECALL = 0.97  # wanted on the held-out share of the sample
SALTS = 64


def entries(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(key, vec, ids): the different vectors, with the k + 1 smallest ids of each (more are never
    among k neighbours). Null and zero vectors, vectors with null or non-finite components, rows
    without id and vectors of another than the most common dimension take no part."""
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    sound = F.forall("vec", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    d = d.where(sound & F.exists("vec", lambda x: x != 0))
    d = cut_lineage(d.withColumn("key", F.concat_ws(":", F.xxhash64("vec"), F.xxhash64(F.reverse("vec")))))
    sizes = d.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return d.select("key", "vec", F.array("id").alias("ids"))
    d = d.where(F.size("vec") == sizes["n"])
    few = d.select("key", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = few.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    low = some.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = low.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    first = ids.select("key", "ids", F.get("ids", F.lit(0)).alias("id"))
    return cut_lineage(d.join(first, ["key", "id"]).dropDuplicates(["key"]).select("key", "vec", "ids"))


def _graph(x: np.ndarray, n: int) -> np.ndarray:
    """Nearest n other rows of every row."""
    sq = (x * x).sum(1)
    out = np.zeros((len(x), n), np.int64)
    for i in range(0, len(x), 1024):
        d = sq[i:i + 1024, None] + sq[None] - 2 * x[i:i + 1024] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i:i + 1024] = np.argpartition(d, n - 1, axis=1)[:, :n]
    return out


def _balanced(x: np.ndarray, near: np.ndarray, parts: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Parts of at most 5% over equal size: start from splits at medians of random directions, then
    move vectors to the part that most of their neighbours are in, best gains first, while there is room."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        big = groups.pop()
        centred = x[big] - x[big].mean(0)
        way = rng.normal(size=x.shape[1])
        for _ in range(8):  # main direction of this group
            way = centred.T @ (centred @ way)
            way /= max(np.linalg.norm(way), 1e-12)
        order = big[np.argsort(centred @ way, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2:]]
    for p, g in enumerate(groups):
        part[g] = p
    room = int(np.ceil(1.05 * len(x) / parts))
    src, dst = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (src, part[dst]), 1.0)
        np.add.at(votes, (dst, part[src]), 1.0)
        want = votes.argmax(1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[want[v]] < room and rng.random() < 0.7:
                size[part[v]] -= 1
                size[want[v]] += 1
                part[v] = want[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    shift: np.ndarray
    scale: float
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]

    def visits(self, x: np.ndarray, held: np.ndarray, least: int) -> list[list[int]]:
        """The most probable parts: as many as were learned, and more until they hold `least` ids (of `held` by part)."""
        order = self.parts(x, len(held))
        enough = (held[order].cumsum(1) < least).sum(1) + 1
        return [o[:max(self.probes, e)].tolist() for o, e in zip(order, enough)]


def _train(x: np.ndarray, target: np.ndarray, seed: int, hidden: int = 128, epochs: int = 40, batch: int = 256, rate: float = 0.003) -> Router:
    """Two-layer classifier with cross entropy to the shares of neighbours in every part."""
    rng = np.random.default_rng(seed)
    shift = x.mean(0)
    scale = max(float(np.sqrt(((x - shift) ** 2).mean())), 1e-12)
    r = Router(rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, target.shape[1])), np.zeros(target.shape[1]), shift, scale)
    p = [r.w1, r.b1, r.w2, r.b2]
    m1, m2 = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    z, k = (x - shift) / scale, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            at = order[i:i + batch]
            pre = z[at] @ r.w1 + r.b1
            h = np.maximum(pre, 0)
            o = h @ r.w2 + r.b2
            o = np.exp(o - o.max(1, keepdims=True))
            g = (o / o.sum(1, keepdims=True) - target[at]) / len(at)
            gh = (g @ r.w2.T) * (pre > 0)
            grads = [z[at].T @ gh + 1e-4 * r.w1, gh.sum(0), h.T @ g + 1e-4 * r.w2, g.sum(0)]
            k += 1
            for v, d, a, b in zip(p, grads, m1, m2):
                a *= 0.9
                a += 0.1 * d
                b *= 0.999
                b += 0.001 * d * d
                v -= rate * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.999 ** k)) + 1e-8)
    return r


def learn(sample: np.ndarray, k: int, recall: float = RECALL, seed: int = 11) -> Router:
    """Router from a sample; the number of probes is measured on a tenth that is held out."""
    held = np.arange(len(sample)) % 10 == 0 if len(sample) >= 200 else np.zeros(len(sample), bool)
    x, q = sample[~held], sample[held]
    parts = max(1, len(x) // PER_PART)
    near = _graph(x, min(NEIGHBOURS, len(x) - 1)) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    part = _balanced(x, near, parts, seed) if parts > 1 else np.zeros(len(x), np.int64)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1.0)
    router = _train(x, target / target.sum(1, keepdims=True), seed)
    if parts > 1 and len(q):
        home = router.parts(x, 1)[:, 0]
        rank = np.argsort(router.parts(q, parts), axis=1)  # place of every part in the query's order
        d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
        true = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
        need = np.take_along_axis(rank, home[true], axis=1)
        found = [(need < p).mean() for p in range(1, parts + 1)]
        router.probes = next((p for p, f in enumerate(found, 1) if f >= recall), parts)
    return router


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): every query's k nearest rows of `vectors` found, its own id left
    out, by Euclidean distance in double precision; ties go to the smaller id. All candidates if
    there are fewer than k; queries are rows like those of `vectors`, and repeated rows count once.
    Without sound vectors the result is empty."""
    index = entries(vectors, id_col, vec_col, k)
    share = int(1_000_003 * min(1.0, sample / max(index.count(), 1))) + 1
    picked = index.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < share).select("key", "vec").toArrow()
    rows = picked.sort_by("key").column("vec").to_pylist()
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    asked = asked.withColumn("key", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.reverse("v")))).select("query_id", "key").distinct()
    asked = cut_lineage(asked.join(index.select("key"), "key"))
    router = learn(np.array(rows, np.float64), k, recall) if rows else None
    sent = vectors.sparkSession.sparkContext.broadcast(router)

    def route(n):
        def run(batches):
            r = sent.value
            for b in batches:
                x = np.array(b.column("vec").to_pylist(), np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.parts(x, n).tolist() if b.num_rows else [], pa.list_(pa.int32()))], names=[*b.schema.names, "parts"])
        return run

    shape = "key string, vec array<double>, ids array<bigint>, parts array<int>"
    homes = cut_lineage(index.mapInArrow(route(1), shape).select("key", "vec", "ids", F.get("parts", F.lit(0)).alias("part")))
    blocks = homes.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    stored = homes.join(F.broadcast(blocks), "part").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("part", "block", "key", "vec", "ids")
    different = index.join(asked.select("key").distinct(), "key")
    parts = len(router.b2) if router else 1
    held = np.zeros(parts, np.int64)
    for r in homes.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect():  # one row per part
        held[r["part"]] = r["n"]

    def visit(batches):
        r = sent.value
        for b in batches:
            x = np.array(b.column("vec").to_pylist(), np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.visits(x, held, k + 1) if b.num_rows else [], pa.list_(pa.int32()))], names=[*b.schema.names, "parts"])

    visits = cut_lineage(different.mapInArrow(visit, shape).select("key", "vec", F.explode("parts").alias("part")))
    # a group holds a block of a part's entries and a block of its queries
    rounds = visits.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rounds"))
    stored = stored.join(F.broadcast(rounds), "part").select("part", "block", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), "key", "vec", "ids")
    visits = visits.join(F.broadcast(blocks), "part").join(F.broadcast(rounds), "part").select(
        F.col("part").alias("q_part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"), F.pmod(F.xxhash64("key"), F.col("rounds")).cast("int").alias("q_round"), F.col("key").alias("q_key"), F.col("vec").alias("q_vec"))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        names = {"key": pa.string(), "score": pa.float64(), "ids": pa.list_(pa.int64())}
        if not q.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        x = np.array(c.column("vec").to_pylist(), np.float64)
        ids = c.column("ids").to_pylist()
        low = np.array([i[0] for i in ids])
        qx = np.array(q.column("q_vec").to_pylist(), np.float64)
        keys, sq, out = q.column("q_key").to_pylist(), (x * x).sum(1), ([], [], [])
        for i in range(0, len(qx), 256):
            part = qx[i:i + 256]
            about = (part * part).sum(1)[:, None] + sq[None] - 2 * part @ x.T
            for j, row in enumerate(about):
                n = min(k + 1, len(row))
                edge = np.partition(row, n - 1)[n - 1]
                near = np.flatnonzero(row <= edge + 1e-9 * (abs(edge) + sq.max() + (part[j] * part[j]).sum()))
                score = np.sqrt(((x[near] - part[j]) ** 2).sum(1))
                for o in np.lexsort((low[near], score))[:n]:
                    out[0].append(keys[i + j])
                    out[1].append(float(score[o]))
                    out[2].append(ids[near[o]])
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(names.items(), out)})

    met = visits.groupBy("q_part", "q_block", "q_round").cogroup(stored.groupBy("part", "block", "round")).applyInArrow(search, "key string, score double, ids array<bigint>")
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", F.get("ids", F.lit(0))))).where(F.col("r") <= k + 1)
    found = cut_lineage(best.select("key", "score", F.explode("ids").alias("id")))
    out = asked.join(found, "key").where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

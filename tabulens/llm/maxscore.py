"""Ranked lexical search with pair-bound MaxScore over an inverted index in blocks.

`build` writes the index: blocks of documents, each with the postings of all its terms. `search`
takes the items in batches of a bounded number of terms. For a batch, one pass over the index counts
document frequencies; the next pass ranks. In that pass every block first computes, for the term
pairs that the items use, the intersection lists with their joint maximum impacts. An item's terms
fall into disjoint pairs, commonest with commonest; a pair can add no more than its joint maximum
to a document in its list, and no more than the larger single maximum to any other. These bounds
are below the sums of single maxima, so more terms become non-essential: documents that only
hold such terms are never scored, and candidates are dropped as soon as what is left can't lift
them to the k-th best score met so far. Results are exact.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType
from pyspark.sql.window import Window

from ..session import shared_folder
from .winnow import words

BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20  # a block ends at the first of these
BATCH_TERMS = 200_000  # words of the items that one pass takes, and so broadcasts
K = 20
_SEPARATES = [c for c in range(128) if not chr(c).isalnum()]
_FOLD = bytes(32 if c in _SEPARATES else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _restore(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of other than ASCII non-alphanumerics, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def pack_block(ids: list, texts: list[bytes], order: np.ndarray) -> dict:
    """One index row. Documents stand in the order given, so that equal scores rank by place."""
    place: dict[bytes, int] = {}
    ids, per = [ids[i] for i in order], []
    for i in order:
        per.append(np.fromiter((place.setdefault(w, len(place)) for w in terms_of(texts[i])), np.int64))
    size = np.fromiter(map(len, per), np.int64, len(per))
    key, tf = np.unique(np.concatenate(per) * len(per) + np.repeat(np.arange(len(per)), size), return_counts=True)
    df = np.bincount(key // len(per), minlength=len(place))
    return {"ids": ids, "sizes": _squeeze(size), "terms": zstandard.ZstdCompressor(level=1).compress(b" ".join(place)), "df": _squeeze(df.astype(np.uint32)),
            "docs": _squeeze((key % len(per)).astype(np.uint16)), "tf": _squeeze(tf.astype(np.uint32)), "n_docs": int((size > 0).sum()), "n_terms": int(size.sum())}


def build(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The index over all rows of `docs` with a term, one row per block, written to the shared folder."""
    slim = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    kind = slim.limit(0).toArrow().schema.field("id").type
    fields = [("ids", pa.list_(kind)), ("sizes", pa.binary()), ("terms", pa.binary()), ("df", pa.binary()), ("docs", pa.binary()), ("tf", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush():
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])))
            row = pack_block(ids, texts, order)
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in fields], names=[n for n, _ in fields])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(key)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES or len(ids) == BLOCK_DOCS:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    schema = StructType().add("ids", ArrayType(slim.schema["id"].dataType))
    for n, _ in fields[1:6]:
        schema = schema.add(n, BinaryType())
    schema = schema.add("n_docs", LongType()).add("n_terms", LongType())
    folder = f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    slim.mapInArrow(run, schema).write.option("compression", "none").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def weight(n: int, df: int) -> int:
    """A term's weight from the number of documents with terms and of those that hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """Impacts of the batch's terms in one block, and its pair lists."""

    def __init__(self, row: dict, place: dict[bytes, int], weights: np.ndarray, n: int, total: int, k: int):
        self.ids, self.k, self.n = row["ids"], k, len(row["ids"])
        m = 100 - 25 + 25 * _restore(row["sizes"], np.int64) * n // total
        terms = zstandard.ZstdDecompressor().decompress(row["terms"]).split()
        ends = np.cumsum(_restore(row["df"], np.uint32).astype(np.int64))
        docs, tf = _restore(row["docs"], np.uint16), _restore(row["tf"], np.uint32)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.top: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, int, int]] = {}
        for i, w in enumerate(terms):
            t = place.get(w)
            if t is not None:
                a, z = (int(ends[i - 1]) if i else 0), int(ends[i])
                at, f = docs[a:z].astype(np.int64), tf[a:z].astype(np.int64)
                impact = weights[t] * (1_000_000_000 * f // (1000 * f + 12 * m[at]))
                self.lists[t], self.top[t] = (at, impact), int(impact.max())

    def intersect(self, pairs: list[tuple[int, int]]) -> None:
        """Intersection lists with the joint maximum and the k-th largest joint impact."""
        for a, b in pairs:
            if a in self.lists and b in self.lists:
                (x, i), (y, j) = self.lists[a], self.lists[b]
                if len(x) > len(y):
                    x, i, y, j = y, j, x, i
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = y[at] == x
                joint = i[both] + j[at[both]]
                if len(joint):
                    kth = int(np.partition(joint, -self.k)[-self.k]) if len(joint) >= self.k else 0
                    self.pairs[a, b] = (x[both], int(joint.max()), kth)

    def best(self, groups: list[tuple[tuple[int, int], ...]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of at most k documents, those of score `floor` or more among them.
        groups: the item's terms with their repeats, by ones and twos."""
        have, least = [], floor
        for group in groups:
            group = [(t, q) for t, q in group if t in self.lists]
            if not group:
                continue
            alone, joint, both = max(q * self.top[t] for t, q in group), 0, None
            if len(group) == 2 and (pair := self.pairs.get((group[0][0], group[1][0]))):
                (a, p), (b, q) = group
                low, both = min(p, q), pair[0]
                joint = low * pair[1] + (p - low) * self.top[a] + (q - low) * self.top[b]
                least = max(least, low * pair[2])
            have.append((max(alone, joint), alone, joint, both, group))
        have.sort(key=lambda g: g[0])
        upto = np.cumsum([g[0] for g in have])
        skip = int(np.searchsorted(upto, max(least, 1), "left"))  # groups that together stay below what is needed
        acc = np.zeros(self.n, np.int64)
        for *_, group in have[skip:]:
            for t, q in group:
                at, impact = self.lists[t]
                acc[at] += q * impact
        left = np.flatnonzero(acc)
        for g in range(skip - 1, -1, -1):
            _, alone, joint, both, group = have[g]
            most = np.full(len(left), alone)
            if both is not None:
                most[np.isin(left, both, assume_unique=True)] = max(joint, alone)
            left = left[acc[left] + most + (upto[g - 1] if g else 0) >= least]
            for t, q in group:
                at, impact = self.lists[t]
                p = np.minimum(np.searchsorted(at, left), len(at) - 1)
                hit = at[p] == left
                acc[left[hit]] += q * impact[p[hit]]
        left = left[acc[left] >= max(least, 1)]
        left = left[np.lexsort((left, -acc[left]))[:self.k]]
        return left, acc[left]


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", item_col: str = "item_id", index: DataFrame | None = None, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of score above 0 for every item.

    Items are the different rows of (item_col, text); one id on two texts is ranked twice. Null and
    empty texts have no terms: such items give no rows and such documents are not counted. Every
    row of `docs` is a document, repeated ids included; equal scores rank by id, null ids last. An
    empty table on either side gives no rows. Items beyond `batch_terms` words go in several passes.
    """
    spark = docs.sparkSession
    index = build(docs, id_col) if index is None else index
    whole = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n, total = whole["n"], whole["l"]
    text = F.col("text").cast("string")
    asked = items.select(F.col(item_col).alias("item"), F.transform(words(text), lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("w"), F.xxhash64(F.col(item_col), text).alias("h"), text.alias("text")).distinct().where(F.size("w") > 0)
    batches = -(-(asked.agg(F.sum(F.size("w"))).first()[0] or 0) // batch_terms)
    item_type, doc_type = items.schema[item_col].dataType, index.schema["ids"].dataType.elementType
    schema = StructType().add("no", LongType()).add("item", item_type).add("id", doc_type).add("score", LongType())
    parts = [_batch(index, asked.where(F.pmod("h", F.lit(batches)) == b).select("item", "w").collect(), n, total, k, schema, b) for b in range(batches)] if n else []
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _batch(index: DataFrame, rows: list, n: int, total: int, k: int, schema: StructType, batch: int) -> DataFrame:
    """The best documents of every task for the items of one batch."""
    spark = index.sparkSession
    counts = [Counter(w.encode() for w in r["w"]) for r in rows]
    place = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    said = spark.sparkContext.broadcast(place)

    def count(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = said.value
        df = np.zeros(len(place), np.int64)
        for b in blocks:
            for terms, each in zip(b.column(0), b.column(1)):
                at = [place.get(w, -1) for w in zstandard.ZstdDecompressor().decompress(terms.as_py()).split()]
                at = np.array(at, np.int64)
                df[at[at >= 0]] += _restore(each.as_py(), np.uint32)[at >= 0]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["t", "df"])

    df = index.select("terms", "df").mapInArrow(count, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()  # the batch's terms at most
    weights = np.zeros(len(place), np.int64)
    for t, f in zip(df.column("t").to_pylist(), df.column("df").to_pylist()):
        weights[t] = weight(n, f)
    plans, pairs = [], {}
    for c in counts:
        terms = sorted((place[w] for w in c), key=lambda t: (weights[t], t))
        names = {place[w]: q for w, q in c.items()}
        groups = [tuple((t, names[t]) for t in sorted(terms[i:i + 2])) for i in range(0, len(terms), 2)]
        plans.append(groups)
        pairs.update(dict.fromkeys((g[0][0], g[1][0]) for g in groups if len(g) == 2))
    item_type = pa.array([r["item"] for r in rows]).type if any(r["item"] is not None for r in rows) else pa.null()
    given = spark.sparkContext.broadcast((weights, plans, list(pairs), [r["item"] for r in rows]))

    def rank(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = said.value
        weights, plans, pairs, names = given.value
        best: list[list[tuple]] = [[] for _ in plans]
        kind = None
        for b in blocks:
            kind = b.column(0).type.value_type
            for i in range(b.num_rows):
                block = Block(b.slice(i, 1).to_pylist()[0], place, weights, n, total, k)
                block.intersect(pairs)
                for q, groups in enumerate(plans):
                    floor = best[q][-1][0] if len(best[q]) == k else 0
                    at, scores = block.best(groups, floor)
                    if len(at):
                        best[q] = sorted([*best[q], *((s, block.ids[p]) for p, s in zip(at.tolist(), scores.tolist()))], key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out = [(batch << 40 | q, names[q], key, s) for q, top in enumerate(best) for s, key in top]
        if out:
            no, item, key, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(item, item_type), pa.array(key, kind), pa.array(score, pa.int64())], names=["no", "item", "id", "score"])

    return index.select("ids", "sizes", "terms", "df", "docs", "tf").mapInArrow(rank, schema)

"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit votes over word shingles. To find all pairs at Hamming distance 4 or
less, fingerprints are replicated to anchors: the words of a perfect code (Hamming code of
length 2^r - 1, covering radius 1, with one free bit). Anchors are met by a shared point: two
fingerprints at distance 2s have a point at distance s from both, that point has an anchor
within the covering radius, so both lie within covering radius + s of this anchor. Sharing the
threshold between the two partners needs far fewer replicas than giving it to one side only.

Two anchor sets are used one after the other:

1. Anchors of the whole word (r = 6), radius 1 + 1. All members of an anchor's ball are within
   4 bits of each other, so they are linked without any comparison: one star per anchor. This
   finds every pair at distance 2 or less and settles dense groups of near copies in linear work.
2. Of two fingerprints within 4 bits, one half differs in at most 2. Each half (r = 5) gets its
   own anchors with radius 1 + 1; members of an anchor are compared exactly, but only across
   the groups that step 1 found.

Per fingerprint this makes 33 + 34 rows at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import components

CHUNK = 1 << 16  # shingles counted at a time
BLOCK = 4096  # members of an anchor that one join key holds
THRESHOLD = 4


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash. Words split at ASCII white space after lower-casing A-Z; a text
    with fewer words than a shingle is one shingle; a text without words (or null) gives 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(buf)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(length + 1) - 1
        ends = stop[shingle - 1:].tolist()
        starts = (stop - length)[: len(ends)].tolist()
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(ends), CHUNK):
        h = np.array([digest(buf[s:e], seed) for s, e in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])], "<u8")
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp long): one row per input row; other columns of `docs` are not read."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, fp bigint").select(F.col("id").alias(id_col), "fp")


def _anchors(x: Column, r: int) -> Column:
    """Anchors within 2 of the 2^r-bit word x: bits 1.. form the Hamming code, bit 0 is free."""
    bits = [1 << p for p in range(1 << r)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    syndrome = F.lit(0)
    for j in range(r):
        mask = sum(bits[p] for p in range(1, 1 << r) if p >> j & 1)
        syndrome = syndrome + F.expr(f"{1 << j}") * (F.bit_count(x.bitwiseAND(F.lit(signed(mask)))) % 2)
    table = []
    for s in range(1 << r):
        near = bits[s] if s else 0
        pairs = [bits[i] | bits[i ^ s] for i in range(1, 1 << r) if s and i < i ^ s]
        table.append([near, near | 1, *pairs])
    literal = "array(" + ",".join("array(" + ",".join(f"{signed(v)}L" if signed(v) != -(1 << 63) else "shiftleft(1L, 63)" for v in row) + ")" for row in table) + ")"
    return F.transform(F.element_at(F.expr(literal), (syndrome + 1).cast("int")), lambda m: m.bitwiseXOR(x))


def link(fps: DataFrame) -> DataFrame:
    """(fp, root): for distinct fingerprints, one name per component of the graph with an edge at
    4 or fewer differing bits. Fingerprints linked to no other may be absent."""
    # 1. balls of whole-word anchors: members are linked through the smallest one
    ball = fps.select("fp", F.explode(_anchors(F.col("fp"), 6)).alias("anchor"))
    crowd = ball.groupBy("anchor").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = ball.join(crowd, "anchor").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    dense = components(stars)
    named = cut_lineage(fps.join(dense.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))

    # 2. anchors of each half: compare across groups only
    half = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    keys = F.concat(_anchors(half[0], 5), F.transform(_anchors(half[1], 5), lambda a: a + F.lit(1 << 32)))
    rep = named.select("fp", "root", F.explode(keys).alias("anchor"))
    per = rep.groupBy("anchor", "root").agg(F.count("*").alias("n"))
    mixed = per.groupBy("anchor").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("groups"))
    # an anchor's largest group needs no search among its own members: the others look at all
    mixed = cut_lineage(mixed.where("groups > 1").select("anchor", "top", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    members = rep.join(mixed, "anchor")
    ask = members.where("root <> top").select("anchor", F.col("fp").alias("p"), F.col("root").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    there = members.select("anchor", "fp", F.col("root").alias("b"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
    met = ask.join(there, ["anchor", "block"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= THRESHOLD))
    joined = components(met.select("a", "b"))
    return named.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp, component_id): fingerprint and smallest id of the component, per input row.

    Copies meet as one fingerprint before anything is compared. Null and word-free texts have
    fingerprint 0 and link like others. Rows with a null id keep it; they count for links, and a
    component with null ids only has a null component_id. An empty table gives an empty result.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    own = fps.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = cut_lineage(own.join(link(own.select("fp")), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    first = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(roots.join(first, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for every component: the one with the smallest id (null ids last, then by the
    text's digest). An id that stands on several texts is judged text by text."""
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))  # one struct, so that no column can clash
    texts = docs.select(digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    part = near_duplicates(texts, "digest", "text").select("digest", F.col("component_id").alias("component")).distinct()
    slim = rows.select("id", "digest").distinct().join(part, "digest")
    first = slim.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("s")).select(F.col("s.id").alias("keep_id"), F.col("s.digest").alias("keep"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep")), "left_semi")
    return kept.dropDuplicates(["id", "digest"]).select("row.*")

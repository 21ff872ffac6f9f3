"""Removal of repeated byte windows by a depth-limited, most-significant-digit radix sort of suffixes.

Suffixes are ordered only through their first `depth` bytes, digit by digit; groups that one
document holds alone are dropped after every pass, and the groups left after the last pass are
exactly the windows that documents share. The first digit, which deals suffixes out to tasks, is
the window's least 12-gram by hash: equal windows have the same one, and neighbours mostly share
it, so a run of neighbours travels as one piece of text (about 3.5 bytes a suffix before
compression). The next digits are eight bytes each, from the left, sorted in memory.

Blocks of text are sorted on their own first. Only windows whose smallest document within the
block isn't settled travel on, so a window that fills a third of all documents arrives once per
block. Buckets that stay too large (many different windows around one 12-gram) are dealt out
window by window by their next digit. With more than `FAN` buckets dealing takes two passes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

DEPTH = 50
GRAM = 12
BLOCK = 4 << 20  # bytes of text sorted in one go; longer texts go in pieces that overlap by depth - 1
WINDOWS = 12_000_000  # windows in a bucket; one with three times as many is split by the next digit
FAN = 1024  # buckets that one pass deals out to
SORTED = 1_500_000  # windows sorted at once in a bucket
LAST = np.iinfo(np.int64).max  # stands for a null id
_M, _N, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW = np.uint64(63)


def _squeeze(a: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _restore(packed: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _digits(padded: bytes) -> np.ndarray:
    """The eight bytes from every place on, as a number that sorts like them."""
    return np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))


def _grams(view: np.ndarray, at) -> np.ndarray:
    """Hash of the 12 bytes at these places, six low bits zero."""
    with np.errstate(over="ignore"):
        h = view[at].astype(np.uint64) * _M
        tail = view[slice(at.start + 4, at.stop + 4) if isinstance(at, slice) else at + 4].astype(np.uint64)
        h ^= (tail & np.uint64(0xFFFFFFFF)) * _N
        h ^= h >> np.uint64(31)
        h *= _P
    return h & ~_LOW


def least_grams(padded: bytes, n: int, depth: int) -> np.ndarray:
    """For the window from each of n places: the least hash of its 12-grams, with its place modulo 64."""
    width = min(depth - GRAM + 1, 52)
    m = n + width - 1
    v = _grams(_digits(padded), slice(0, m)) | (np.arange(m, dtype=np.uint64) & _LOW)
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:len(v) - step], v[step:])
        have += step
    return v[:n]


def shared_windows(padded: bytes, pos: np.ndarray, count: np.ndarray, key: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """Runs of `count` windows from `pos` on, each with its first digit and document: for all windows
    in a row, whether a smaller document holds the same one."""
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), bool)
    if not len(pos):
        return out
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] ^ np.uint64(1)))
    d = doc[order]
    alone = np.minimum.reduceat(d, edge) == np.maximum.reduceat(d, edge)
    size = np.diff(edge, append=len(order))
    use = order[~np.repeat(alone, size)]
    if not len(use):
        return out
    # equal runs count once, for the smallest of their documents
    ends = (pos + count + depth - 1)[use].tolist()
    seen: dict[bytes, int] = {}
    same = np.fromiter((seen.setdefault(padded[a:z], len(seen)) for a, z in zip(pos[use].tolist(), ends)), np.int64, len(use))
    del seen, ends
    by = np.lexsort((doc[use], same))
    heads = np.flatnonzero(np.diff(same[by], prepend=-1))
    rep = use[by[heads]]  # the run of the smallest document, for each kind of run
    of = rep[same]
    later = doc[use] > doc[of]
    rep = rep[np.argsort(key[rep], kind="stable")]
    group = np.cumsum(np.diff(key[rep], prepend=key[rep][:1]) != 0)
    start = np.flatnonzero(np.diff(group, prepend=-1))
    alone = np.minimum.reduceat(doc[rep], start) == np.maximum.reduceat(doc[rep], start)
    keep = ~np.repeat(alone, np.diff(start, append=len(rep)))
    rep, group = rep[keep], group[keep]
    view = _digits(padded)
    lo = 0
    upto = np.cumsum(count[rep])
    while lo < len(rep):  # whole groups, about SORTED windows at a time
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SORTED, "right"))
        hi = int(np.searchsorted(group, group[min(max(hi, lo + 1), len(rep)) - 1], "right"))
        _sort(view, rep[lo:hi], group[lo:hi], pos, count, first, doc, depth, out)
        lo = hi
    # what holds for a run holds for its equals; those of later documents go in any case
    for_all = np.repeat(later, count[use])
    base, runs = np.repeat(first[use], count[use]), np.repeat(first[of], count[use])
    off = np.arange(len(base)) - np.repeat(np.cumsum(count[use]) - count[use], count[use])
    out[base + off] = for_all | out[runs + off]
    return out


def _sort(view, runs, group, pos, count, first, doc, depth, out) -> None:
    """Digit passes over the windows of some groups; sets `out` where a smaller document has the same window."""
    c = count[runs]
    off = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    at, to = np.repeat(pos[runs], c) + off, np.repeat(first[runs], c) + off
    d, g = np.repeat(doc[runs], c), np.repeat(group, c)
    for digit in [*range(0, depth - 8, 8), depth - 8]:
        x = view[at + digit].astype(np.uint64)
        order = np.lexsort((x, g))
        x, g, d, at, to = x[order], g[order], d[order], at[order], to[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        edge = np.flatnonzero(new)
        low, size = np.minimum.reduceat(d, edge), np.diff(edge, append=len(g))
        keep = np.repeat(low != np.maximum.reduceat(d, edge), size)
        g, d, at, to, low = np.cumsum(new)[keep], d[keep], at[keep], to[keep], np.repeat(low, size)[keep]
        if not len(g):
            return
    out[to[d > low]] = True


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every stretch of true values."""
    step = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class _Block:
    """Texts (or pieces of them) one after the other."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.base, self.ids, self.keys, self.size = depth, [], [], [], [], 0

    def add(self, text: memoryview, base: int, key: int | None, digest: int) -> None:
        self.parts.append(text)
        self.base.append(base)
        self.ids.append(LAST if key is None else key)
        self.keys.append(digest)
        self.size += len(text)

    def close(self) -> None:
        self.text = b"".join(self.parts) + bytes(self.depth + 16)
        size = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        self.start = np.cumsum(size) - size
        self.base, self.ids, self.keys = (np.array(x, np.int64) for x in (self.base, self.ids, self.keys))
        self.valid = np.zeros(self.size + 1, np.int64)
        whole = size >= self.depth
        np.add.at(self.valid, self.start[whole], 1)
        np.add.at(self.valid, (self.start + size - self.depth + 1)[whole], -1)
        self.valid = np.cumsum(self.valid)[:-1] > 0  # windows that stay within their text
        self.least = least_grams(self.text, self.size, self.depth) if self.size else np.zeros(0, np.uint64)
        self.parts = []

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of flagged windows with one first digit: begin, number, text."""
        cut = np.flatnonzero(flags)
        if not len(cut):
            return cut, cut, cut
        head = np.ones(len(cut), bool)
        head[1:] = (np.diff(cut) > 1) | (self.least[cut[1:]] != self.least[cut[:-1]])
        at = np.flatnonzero(head)
        pos = cut[at]
        return pos, np.diff(at, append=len(cut)), np.searchsorted(self.start, pos, "right") - 1


def _blocks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[_Block]:
    """Blocks of (id, key, text) rows."""
    block = _Block(depth)
    for b in batches:
        for key, digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            whole = memoryview(text.as_buffer())
            for base in range(0, max(len(whole) - depth + 1, 1), BLOCK):
                part = whole[base:base + BLOCK + depth - 1]
                if block.size and block.size + len(part) > BLOCK:
                    block.close()
                    yield block
                    block = _Block(depth)
                block.add(part, base, key, digest)
    if block.ids:
        block.close()
        yield block


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((key >> np.uint64(6)) * _M >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


ROW = pa.schema([("bucket", pa.int64()), ("text", pa.binary()), *[(x, pa.binary()) for x in ("count", "anchor", "doc", "start", "ids", "keys")]])
ROW_TYPES = "bucket long, text binary, count binary, anchor binary, doc binary, start binary, ids binary, keys binary"


def _row(bucket: int, text: bytes | None, count, anchor, doc, start, ids, keys, wide: bool) -> dict:
    """Runs of windows (with text) or ranges (without; count is their end) of some documents."""
    different, no = np.unique(doc, return_inverse=True)
    return {"bucket": bucket, "text": text, "count": _squeeze(count.astype(np.int64)), "anchor": None if anchor is None else _squeeze(anchor.astype(np.uint8)), "doc": _squeeze(np.diff(no.astype(np.int64), prepend=0)),
            "start": _squeeze(start.astype(np.int64)), "ids": _squeeze(ids[different]), "keys": _squeeze(keys[different]) if wide else None}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ROW)


def _split(padded: bytes, pos, count, least_pos, doc, start, ids, keys, key, depth, buckets: int, splits: dict[int, int], wide: bool) -> Iterator[pa.RecordBatch]:
    """Runs dealt out to buckets, a row for each. Runs of a bucket that is split go window by window."""
    to = _bucket(key, buckets)
    if splits:
        hot = np.isin(to, np.fromiter(splits, np.int64))
        if hot.any():
            c = np.where(hot, count, 1)
            off = np.where(np.repeat(hot, c), np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c), 0)
            each = lambda x: np.repeat(x, c)
            single = np.repeat(hot, c)
            pos, count, least_pos, doc, start, to = each(pos) + off, np.where(single, 1, each(count)), each(least_pos), each(doc), each(start) + off, each(to)
            ways = np.array([splits.get(b, 1) for b in range(buckets)])
            next_digit = _bucket(_digits(padded)[pos].astype(np.uint64) * _N, 1 << 30)
            to = np.where(single, to + buckets * (next_digit % ways[to]), to)
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order], prepend=-1))
    raw = memoryview(padded)
    for a, z in zip(edge, np.append(edge[1:], len(order))):
        i = order[a:z]
        text = b"".join([raw[p:q] for p, q in zip(pos[i].tolist(), (pos[i] + count[i] + depth - 1).tolist())])
        yield _batch([_row(int(to[i[0]]), zstandard.ZstdCompressor(level=3).compress(text), count[i], least_pos[i] - pos[i], doc[i], start[i], ids, keys, wide)])


def _unpack(rows: Iterator[dict], depth: int):
    """Runs of many rows: (padded text, pos, count, anchor place, doc, start, ids, keys)."""
    texts, cols, ids, keys, size, docs = [], [], [], [], 0, 0
    for r in rows:
        text = zstandard.ZstdDecompressor().decompress(r["text"])
        count = _restore(r["count"], np.int64)
        pos = size + np.cumsum(count + depth - 1) - (count + depth - 1)
        cols.append((pos, count, pos + _restore(r["anchor"], np.uint8), np.cumsum(_restore(r["doc"], np.int64)) + docs, _restore(r["start"], np.int64)))
        ids.append(_restore(r["ids"], np.int64))
        keys.append(_restore(r["keys"], np.int64) if r["keys"] is not None else np.zeros(len(ids[-1]), np.int64))
        texts.append(text)
        size, docs = size + len(text), docs + len(ids[-1])
    if not texts:
        return None
    return (b"".join(texts) + bytes(depth + 16), *[np.concatenate(x) for x in zip(*cols)], np.concatenate(ids), np.concatenate(keys))


def repeated_spans(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id") -> DataFrame:
    """(id, text_key, start, stop): byte ranges of documents that are covered by windows of `depth`
    bytes which also start in a document with a smaller id. Ranges may overlap; their union is whole.
    text_key is the text's hash where an id stands on several texts, else 0. Null ids come last and
    are not compared with one another; rows with one id are one document."""
    if not 20 <= depth <= 4096:
        raise ValueError("depth must lie between 20 and 4096 bytes")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text")).where(F.length("text") >= depth)
    shape = rows.select("id", "key", F.length("text").alias("n")).groupBy("id", "key").agg(F.sum("n").alias("n")).groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("c")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("c").alias("c")).first()
    buckets, wide = max(1, -(-shape["n"] // WINDOWS)), (shape["c"] or 0) > 1
    splits: dict[int, int] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for block in _blocks(batches, depth):
            n += np.bincount(_bucket(block.least[block.valid] & ~_LOW, buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(n)], names=["bucket", "n"])

    if buckets > 1:  # one number per bucket
        sizes = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 3 * WINDOWS).collect()
        splits = {r["bucket"]: -(-r["n"] // WINDOWS) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = min(buckets, FAN)
        for block in _blocks(batches, depth):
            pos, n, part = block.runs(block.valid)
            gone = np.zeros(block.size, bool)
            found = shared_windows(block.text, pos, n, block.least[pos] & ~_LOW, block.ids[part], depth)
            at = np.repeat(pos, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone[at[found]] = True
            a, z = _runs(gone)
            if len(a):
                part = np.searchsorted(block.start, a, "right") - 1
                shift = (block.base - block.start)[part]
                yield _batch([_row(int(a[0]) % coarse, None, z + depth - 1 + shift, None, part, a + shift, block.ids, block.keys, wide)])
            pos, n, part = block.runs(block.valid & ~gone)
            least = block.least[pos]
            anchor = pos + ((least - pos.astype(np.uint64)) & _LOW).astype(np.int64)
            if buckets > FAN:  # the finer deal comes in the next pass
                yield from _split(block.text, pos, n, anchor, part, pos + (block.base - block.start)[part], block.ids, block.keys, least & ~_LOW, depth, FAN, {}, wide)
            else:
                yield from _split(block.text, pos, n, anchor, part, pos + (block.base - block.start)[part], block.ids, block.keys, least & ~_LOW, depth, buckets, splits, wide)

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush():
            got = _unpack(iter(held), depth)
            if got:
                padded, pos, n, anchor, doc, start, ids, keys = got
                yield from _split(padded, pos, n, anchor, doc, start, ids, keys, _grams(_digits(padded), anchor), depth, buckets, splits, wide)

        for b in batches:
            for r in b.to_pylist():
                if r["text"] is None:
                    yield _batch([r])
                    continue
                if held and held[0]["bucket"] != r["bucket"] or size > 4 * BLOCK:
                    yield from flush()
                    held, size = [], 0
                held.append(r)
                size += len(r["text"])
        yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        runs, out = [], []
        for r in table.to_pylist():
            if r["text"] is None:
                no, ids = np.cumsum(_restore(r["doc"], np.int64)), _restore(r["ids"], np.int64)
                keys = _restore(r["keys"], np.int64) if wide else np.zeros(len(ids), np.int64)
                out.append((ids[no], keys[no], _restore(r["start"], np.int64), _restore(r["count"], np.int64)))
            else:
                runs.append(r)
        got = _unpack(iter(runs), depth)
        if got:
            padded, pos, n, anchor, doc, start, ids, keys = got
            gone = shared_windows(padded, pos, n, _grams(_digits(padded), anchor), ids[doc], depth)
            first = np.cumsum(n) - n
            apart = np.zeros(len(gone) + len(n), bool)  # a gap after every run
            apart[np.arange(len(gone)) + np.repeat(np.arange(len(n)), n)] = gone
            a, z = _runs(apart)
            run = np.searchsorted(first + np.arange(len(n)), a, "right") - 1
            shift = start[run] - (first + np.arange(len(n)))[run]
            out.append((ids[doc[run]], keys[doc[run]], a + shift, z + shift + depth - 1))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"id": pa.array(cols[0], mask=cols[0] == LAST), "text_key": cols[1], "start": cols[2], "stop": cols[3]})

    dealt = rows.mapInArrow(deal, ROW_TYPES)
    if buckets > FAN:
        dealt = dealt.repartition(FAN, "bucket").sortWithinPartitions("bucket").mapInArrow(finer, ROW_TYPES)
    return dealt.groupBy("bucket").applyInArrow(settle, "id long, text_key long, start long, stop long").withColumn("text_key", F.when(F.lit(wide), F.col("text_key")).otherwise(F.lit(0)))


def merged(spans: DataFrame) -> DataFrame:
    """(id, text_key, spans): the maximal ranges of every document, in order."""
    own = Window.partitionBy("id", "text_key").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("island", F.sum("new").over(own))
    return islands.groupBy("id", "text_key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy("id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def cut_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_bytes, n_removed, spans, kept, kept_sha256) for every row of `docs`.

    spans are the maximal removed byte ranges of the text in UTF-8, kept the remaining bytes (which
    may split a character). Null texts are empty; rows with null ids are compared with all rows that
    have one, but not with each other; repeated rows are one document; other columns are left out;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/spans-{uuid.uuid4().hex}"
    merged(repeated_spans(docs, depth, id_col)).write.parquet(place)
    spans = spark.read.schema("id long, text_key long, spans array<struct<start:long,stop:long>>").parquet(place)
    wide = spans.where("text_key <> 0").limit(1).count() > 0
    text = F.col("text").cast("string")
    rows = docs.select(F.col(id_col).alias("row"), F.col(id_col).cast("long").alias("own"), (F.xxhash64(text) if wide else F.lit(0).cast("long")).alias("own_key"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    both = rows.join(spans, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key")), "left").select("row", "text", "spans")
    kind = both.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, digest = [], [], []
            for text, gone in zip(b.column(1), b.column(2).to_pylist()):
                raw, h, parts, at = memoryview(text.as_buffer()), hashlib.sha256(), [], 0
                for s in gone or []:
                    parts.append(raw[at:s["start"]])
                    at = s["stop"]
                parts.append(raw[at:])
                for p in parts:
                    h.update(p)
                kept.append(b"".join(parts))
                removed.append(len(raw) - len(kept[-1]))
                digest.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.as_buffer()) for t in b.column(1)], pa.int64()), pa.array(removed, pa.int64()), b.column(2), pa.array(kept, pa.binary()), pa.array(digest)],
                                             names=["row", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    out = both.mapInArrow(run, f"row {kind}, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string")
    return out.withColumnRenamed("row", id_col)

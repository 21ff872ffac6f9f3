"""Hierarchical Pitman-Yor language model, and scores of texts.

Every preceding word has a restaurant of the words that follow it; the parent of all of them is
one word restaurant, which gets a customer for each of their tables. The base measure of the word
restaurant spells words byte by byte: every context of two bytes that occurs is a restaurant, whose
parent is the restaurant of the last byte, whose parent is the one without context, whose parent is
uniform over 257 symbols. Each table of the word restaurant sends its word once through the spelling
restaurants. A text's end is the empty word, which also precedes its first word.

A Gibbs sweep takes all customers of a pair, word or spelling cell out and seats them anew by the
Chinese-restaurant process, given the others. Every seating is drawn once and kept: the customers
of a parent are exactly the tables of its children, so a sample is a proper distribution.
Sweeps run until the number of tables settles; then samples are taken, and their predictive
probabilities are averaged.

Spark holds packed arrays, not rows per word or pair. A block is part of a partition with its own
numbering of words. A word's home (by hash) numbers it, seats it and answers for it; pairs meet in
buckets by the hash of the whole pair, so a common word spreads over all buckets. A pair that occurs
once always has one table; only others are seated. Between sweeps a bucket tells the homes its
tables per word, and homes tell the buckets that ask what a word's probability and seats are. Only
spelling cells (bounded by the alphabet, whatever the corpus) reach the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

END = 256  # closes a word; also stands before its first byte
SYMBOLS = 257
STRENGTH = 1.0  # of every restaurant
SETTLED = 0.01  # relative change in the number of tables below which sampling begins
BURN_IN, KEPT = 6, 2  # sweeps before samples are taken, at most; samples
BLOCK_TOKENS, BLOCK_WORDS = 4_000_000, 500_000  # a block ends at the first of these
PAIRS = 3_000_000  # training tokens for each bucket of pairs
HOME_BYTES = 24_000_000  # bytes of text for each home of words
FINE = 1 << 14  # answers carry log probabilities in steps of 1/FINE


def tables(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating so many customers of one dish each. `new` is the weight of a new table,
    (strength + discount * other tables) * parent's probability. One by one for the first 32,
    then in blocks of a sixteenth within which the odds are taken as constant."""
    out = (customers > 0).astype(np.int64)
    left = np.flatnonzero(customers > 1)
    n = 1
    while len(left):
        step = np.minimum(1 if n < 32 else n // 16, customers[left] - n)
        a = new[left]
        out[left] += rng.binomial(step, a / (a + np.maximum(n - discount * out[left], 1e-9)))
        n += 1 if n < 32 else n // 16
        left = left[customers[left] > n]
    return out


def discount_of(ones: float, twos: float) -> float:
    """From the numbers of dishes seen once and twice."""
    return float(np.clip(ones / max(ones + 2.0 * twos, 1.0), 0.1, 0.9))


def codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cell (two bytes back, last byte, symbol) of each symbol of each word and its end, word of each cell)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - (size + 1)
    padded = np.full(int((size + 1).sum()), END, np.int64)
    word = np.repeat(np.arange(len(words)), size + 1)
    inside = np.ones(len(padded), bool)
    inside[start + size] = False
    padded[inside] = np.frombuffer(b"".join(words), np.uint8)
    one, two = np.empty_like(padded), np.empty_like(padded)
    one[1:], two[2:] = padded[:-1], padded[:-2]
    one[start] = two[start] = END
    two[(start + 1)[size > 0]] = END
    return (two * SYMBOLS + one) * SYMBOLS + padded, word


class Spelling:
    """Restaurants of byte contexts that occur, seated from the customers of their cells."""

    def __init__(self):
        self.none = np.full(SYMBOLS, 1.0 / SYMBOLS)
        self.one = np.full((SYMBOLS, SYMBOLS), 1.0 / SYMBOLS)
        self.contexts, self.two = np.zeros(0, np.int64), np.zeros((0, SYMBOLS))
        self.others = [np.zeros(SYMBOLS ** 2), np.zeros(SYMBOLS), np.zeros(1)]  # tables of every restaurant after the last sweep

    def _seat(self, level: int, place: np.ndarray, c: np.ndarray, parent: np.ndarray, rng) -> tuple[np.ndarray, float]:
        """New tables of cells with c customers in the restaurants `place`, and the discount."""
        d = discount_of(float((c == 1).sum()), float((c == 2).sum()))
        size = len(self.others[level])
        dishes = np.bincount(place, minlength=size)
        before = np.where(self.others[level] > 0, self.others[level], dishes)
        own = np.maximum(1.0, c * (before / np.maximum(np.bincount(place, weights=c, minlength=size), 1))[place])
        t = tables(c, (STRENGTH + d * np.maximum(before[place] - own, 0)) * parent, d, rng)
        self.others[level] = np.bincount(place, weights=t, minlength=size)
        return t, d

    def sweep(self, cell: np.ndarray, c: np.ndarray, rng) -> None:
        """cell: sorted, different; c: their customers, above 0."""
        context, symbol = cell // SYMBOLS, cell % SYMBOLS
        last = context % SYMBOLS
        t2, d2 = self._seat(0, context, c, self.spelled(cell, parent=True), rng)
        pair, c1 = np.unique(last * SYMBOLS + symbol, return_inverse=True)
        c1 = np.bincount(c1, weights=t2, minlength=len(pair)).astype(np.int64)
        t1, d1 = self._seat(1, pair // SYMBOLS, c1, self.none[pair % SYMBOLS], rng)
        c0 = np.bincount(pair % SYMBOLS, weights=t1, minlength=SYMBOLS).astype(np.int64)
        seen = np.flatnonzero(c0)
        t0, d0 = self._seat(2, np.zeros(len(seen), np.int64), c0[seen], np.full(len(seen), 1.0 / SYMBOLS), rng)
        self.none = (STRENGTH + d0 * t0.sum()) / SYMBOLS / (STRENGTH + c0.sum()) * np.ones(SYMBOLS)
        self.none[seen] += (c0[seen] - d0 * t0) / (STRENGTH + c0.sum())
        people = STRENGTH + np.bincount(pair // SYMBOLS, weights=c1, minlength=SYMBOLS)
        self.one = ((STRENGTH + d1 * self.others[1]) / people)[:, None] * self.none[None, :]
        self.one[pair // SYMBOLS, pair % SYMBOLS] += (c1 - d1 * t1) / people[pair // SYMBOLS]
        self.contexts, row = np.unique(context, return_inverse=True)
        people = STRENGTH + np.bincount(row, weights=c, minlength=len(self.contexts))
        self.two = ((STRENGTH + d2 * self.others[0][self.contexts]) / people)[:, None] * self.one[self.contexts % SYMBOLS]
        self.two[row, symbol] += (c - d2 * t2) / people[row]

    def spelled(self, cell: np.ndarray, parent: bool = False) -> np.ndarray:
        """Probability of cells; with `parent` in the restaurant of one byte."""
        if parent:
            return self.one[cell // SYMBOLS % SYMBOLS, cell % SYMBOLS]
        rows, logs = self.lookup()
        return np.exp(logs[rows[cell // SYMBOLS], cell % SYMBOLS])

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """(row for every context of two bytes, logs by row and symbol). Contexts that don't occur share the row of their last byte."""
        rows = len(self.contexts) + np.arange(SYMBOLS ** 2) % SYMBOLS
        rows[self.contexts] = np.arange(len(self.contexts))
        return rows.astype(np.int32), np.log(np.concatenate([self.two, self.one]))


def log_spelled(words: list[bytes], look: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log of the words' base probabilities."""
    if not words:
        return np.zeros(0)
    cells, word = codes(words)
    return np.bincount(word, weights=look[1][look[0][cells // SYMBOLS], cells % SYMBOLS], minlength=len(words))


def planes(a: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed: most planes are nearly empty. The first byte is the width."""
    width = 4 if not len(a) or a.max() < 1 << 32 else 8
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def unplane(packed: bytes) -> np.ndarray:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    return np.ascontiguousarray(rows.T).view(f"<u{packed[0]}").ravel().astype(np.int64)


def steps(values: np.ndarray) -> bytes:
    """Whole numbers as eight planes of bytes of their differences (modulo 2^64), compressed."""
    d = np.diff(values.astype("<u8"), prepend=np.zeros(1, "<u8"))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unstep(packed: bytes) -> np.ndarray:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(rows.T).view("<u8").ravel(), dtype=np.uint64)


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no white space; the empty word stands between two blanks."""
    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def unpack_words(packed: bytes, n: int) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b" ") if n else []


# columns of the tables that pass between blocks, homes and buckets
_FIELDS = {"kind": pa.int32(), "block": pa.int64(), "home": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "m": pa.int64(), "text": pa.binary(), **{k: pa.binary() for k in ("a", "b", "c", "d", "e")}}
_SQL = ", ".join(f"{k} {'int' if v == pa.int32() else 'long' if v == pa.int64() else 'binary'}" for k, v in _FIELDS.items())


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _FIELDS.items()], names=list(_FIELDS))


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def tokenise(docs: DataFrame, learn: Column, id_col: str, homes: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of tokenised documents: texts (of, id, held_out, ids), vocabularies (block, home, words
    `text`, their numbers `a` and training counts `b`), and the stored table behind both."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("words"), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = slim.schema["id"].dataType.simpleString()
    id_type = slim.limit(0).toArrow().schema.field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        rows: list[tuple[object, bool, np.ndarray]] = []
        tokens = 0

        def batch(ids, held, packed, part):
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(packed, pa.binary()), *_rows(part).columns], names=["id", "held_out", "ids", *_FIELDS])

        def flush():
            block = uuid.uuid4().int >> 65  # 63 bits
            for i in range(0, len(rows), 2000):
                part = rows[i:i + 2000]
                yield batch([r[0] for r in part], [r[1] for r in part], [planes(r[2]) for r in part], [{"kind": 0, "block": block}] * len(part))
            n = np.zeros(len(place), np.int64)
            learned = [ids for _, held, ids in rows if not held]
            if learned:
                n += np.bincount(np.concatenate(learned), minlength=len(place))
            words = list(place)
            home = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) * homes >> 32
            order = np.argsort(home, kind="stable")
            edge = np.searchsorted(home[order], np.arange(homes + 1))
            out = [{"kind": 1, "block": block, "home": h, "n": int(z - a), "text": pack_words([words[i] for i in order[a:z].tolist()]), "a": steps(order[a:z]), "b": planes(n[order[a:z]])} for h, (a, z) in enumerate(zip(edge, edge[1:])) if a < z]
            for i in range(0, len(out), 50):
                part = out[i:i + 50]
                yield batch([None] * len(part), [None] * len(part), [None] * len(part), part)

        for b in batches:
            for key, text, learned in zip(b.column(0), b.column(1), b.column(2)):
                words = text.as_py().encode().lower().split()
                words.append(b"")
                ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
                rows.append((key.as_py(), not learned.as_py(), ids))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS or len(place) >= BLOCK_WORDS:
                    yield from flush()
                    place, rows, tokens = {}, [], 0
        if rows:
            yield from flush()

    stored = scratch.store(slim.mapInArrow(run, f"id {kind}, held_out boolean, ids binary, {_SQL}"), "kind")
    return stored.where("kind = 0").select(F.col("block").alias("of"), "id", "held_out", "ids"), stored.where("kind = 1").select("block", "home", "n", "text", "a", "b"), stored


def merge_words(part: pa.Table) -> pa.Table:
    """A home's words: one row (kind 0: words in order, training counts; their sum in `bucket`, the trained ones in `m`) and an answer to every block (kind 1: its
    numbers, the words' places here). The end, the empty word, is marked for its block by its number + 1 in `m`."""
    rows = part.to_pylist()
    lists = [unpack_words(r["text"], r["n"]) for r in rows]
    words = sorted(set().union(*lists))
    place = {w: i for i, w in enumerate(words)}
    at = [np.fromiter(map(place.__getitem__, x), np.int64, len(x)) for x in lists]
    c = np.bincount(np.concatenate(at), weights=np.concatenate([unplane(r["b"]) for r in rows]).astype(float), minlength=len(words)).astype(np.int64)
    home = rows[0]["home"]
    out = [{"kind": 0, "home": home, "n": len(words), "m": int((c > 0).sum()), "text": pack_words(words), "a": planes(c), "bucket": int(c.sum())}]
    for r, x, own in zip(rows, at, lists):
        number = unstep(r["a"]).astype(np.int64)
        out.append({"kind": 1, "home": home, "block": r["block"], "n": len(x), "a": r["a"], "b": planes(x), "m": int(number[own.index(b"")]) + 1 if b"" in own else 0})
    return _table(out)


def pairs_of(docs: pa.Table, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(previous word, word, training count) of the different pairs of a block, and the pair of every token."""
    texts = [unplane(p.as_py()) for p in docs.column("ids")]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    word = np.concatenate(texts)
    last = np.empty_like(word)
    last[1:] = word[:-1]
    last[np.cumsum(size) - size] = end
    keys, pair = np.unique(last << 32 | word, return_inverse=True)
    learned = np.repeat(~np.asarray(docs.column("held_out").to_pylist(), bool), size)
    return keys >> 32, keys & 0xFFFFFFFF, np.bincount(pair[learned], minlength=len(keys)), pair


def bucket_of(last: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (last.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def numbers_of(answers: list[dict], homes: int) -> tuple[np.ndarray, int]:
    """Global number of each word of a block, and the block's number of the end."""
    out = np.zeros(sum(r["n"] for r in answers), np.int64)
    for r in answers:
        out[unstep(r["a"]).astype(np.int64)] = unplane(r["b"]) * homes + r["home"]
    return out, max(r["m"] for r in answers) - 1


def told_homes(wids: np.ndarray, homes: int, bucket: int, columns: list[np.ndarray], kind: int) -> list[dict]:
    """Rows (home, bucket, places `a`, columns `b`, `c`, ...) of words (in the order of by_home)."""
    home = wids % homes
    edge = np.flatnonzero(np.diff(home, prepend=-1))
    return [{"kind": kind, "home": int(home[a]), "bucket": bucket, "n": int(z - a), "a": steps(wids[a:z] // homes)} | {k: planes(x[a:z]) for k, x in zip("bcde", columns)} for a, z in zip(edge, np.append(edge[1:], len(wids)))]


def by_home(keys: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words of pairs, by home and place; the place among them of each pair's previous word, and of its word)."""
    both = np.concatenate([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)]).astype(np.int64)
    order, at = np.unique(both % homes << 32 | both // homes, return_inverse=True)
    return (order & 0xFFFFFFFF) * homes + (order >> 32), at[:len(keys)], at[len(keys):]


def merge_pairs(part: pa.Table, homes: int) -> pa.Table:
    """A bucket's pairs. Kinds: 0 those that occur more than once in training (keys `a`, counts `b`; numbers of pairs seen once and
    twice in `n`, `m`), 1 for every block its pairs' counts (`a`) and the places of those that are seated (`b`), 2 for homes: words
    with their tokens as previous word, and single pairs as previous word and as word, 3 for homes: words in seated pairs, with one table each."""
    rows = part.to_pylist()
    bucket = rows[0]["bucket"]
    keys = [unstep(r["a"]) for r in rows]
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(at, weights=np.concatenate([unplane(r["b"]) for r in rows]).astype(float), minlength=len(uniq)).astype(np.int64)
    more = c > 1
    place = np.cumsum(more) - 1
    out = [{"kind": 0, "bucket": bucket, "a": steps(uniq[more]), "b": planes(c[more]), "n": int((c == 1).sum()), "m": int((c == 2).sum())}]
    z = 0
    for r, k in zip(rows, keys):
        own, z = at[z:z + len(k)], z + len(k)
        out.append({"kind": 1, "bucket": bucket, "block": r["block"], "a": planes(c[own]), "b": steps(place[own][more[own]])})
    seen = c > 0
    wids, u, w = by_home(uniq[seen], homes)
    single = (c[seen] == 1).astype(float)
    sums = [np.bincount(u, weights=c[seen].astype(float), minlength=len(wids)), np.bincount(u, weights=single, minlength=len(wids)), np.bincount(w, weights=single, minlength=len(wids))]
    out += told_homes(wids, homes, bucket, sums, 2)
    wids, u, w = by_home(uniq[more], homes)
    out += told_homes(wids, homes, bucket, [np.bincount(x, minlength=len(wids)) for x in (u, w)], 3)
    return _table(out)


def word_seats(rows: list[dict], size: int) -> list[np.ndarray]:
    """Sums over buckets of the columns they tell."""
    out = [np.zeros(size, np.int64) for _ in range(3)]
    for r in rows:
        at = unstep(r["a"]).astype(np.int64)
        for total, k in zip(out, "bcd"):
            if r.get(k) is not None:
                total[at] += unplane(r[k])
    return out


def seat_words(customers: np.ndarray, log_base: np.ndarray, d: float, total: int, before: int, rng) -> np.ndarray:
    """Tables of words, given about so many of all words before."""
    own = np.where(customers > 0, np.maximum(1, customers * before / max(total, 1)), 0)
    return tables(customers, (STRENGTH + d * np.maximum(before - own, 0)) * np.exp(log_base), d, rng)


def word_logs(customers, t, log_base, d: float, total: int, all_tables: int) -> np.ndarray:
    """Log of the predictive probabilities of words; very long ones underflow, so it stays in logarithms."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(customers - d * t, 0.0)), np.log(STRENGTH + d * all_tables) + log_base) - np.log(STRENGTH + total)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", seed: int = 7, pairs_per_bucket: int = PAIRS, home_bytes: int = HOME_BYTES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row.

    Learns from the rows where `learn` holds (null counts as not); a null text is empty and has
    one token, its end. Without training rows every word is spelled from the uniform base. Base
    score: additive smoothing by a half over the V training tokens and one unknown. An empty table
    gives no rows. More than 2^32 different words are an error.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]
    homes = max(1, -(-text_bytes // home_bytes))
    texts, vocabularies, blocks = tokenise(docs, learn, id_col, homes, scratch)
    words = scratch.store(vocabularies.groupBy("home").applyInArrow(merge_words, _SQL), "kind")
    del vocabularies
    scratch.drop(blocks, part="kind=1")
    lexicon, answers = words.where("kind = 0"), words.where("kind = 1").select("block", "home", "n", "m", "a", "b")
    s = lexicon.agg(F.coalesce(F.sum("bucket"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("v"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    total, kinds = s["n"], s["v"]
    if s["most"] * homes >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    buckets = max(1, -(-total // pairs_per_bucket))
    kind = texts.schema["id"].dataType.simpleString()

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        wid, end = numbers_of(right.to_pylist(), homes)
        last, word, n, _ = pairs_of(left, end)
        last, word = wid[last], wid[word]
        at = bucket_of(last, word, buckets)
        key = last.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
        order = np.lexsort((key, at))
        edge = np.searchsorted(at[order], np.arange(buckets + 1))
        return _table([{"kind": 0, "bucket": b, "block": left.column("of")[0].as_py(), "a": steps(key[order[a:z]]), "b": planes(n[order[a:z]])} for b, (a, z) in enumerate(zip(edge, edge[1:])) if a < z])

    dealt = texts.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(deal, _SQL).select("bucket", "block", "a", "b")
    merged = scratch.store(dealt.groupBy("bucket").applyInArrow(lambda part: merge_pairs(part, homes), _SQL), "kind")
    del dealt
    scratch.drop()
    seated = merged.where("kind = 0").select("bucket", "a", "b")
    seen = merged.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("once"), F.coalesce(F.sum("m"), F.lit(0)).alias("twice")).first()
    d = discount_of(seen["once"], seen["twice"])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        return _table([{"kind": 0, "home": row["home"], "n": row["n"], "text": row["text"], "a": row["a"]} | {k: planes(x) for k, x in zip("bcd", word_seats(right.to_pylist(), row["n"]))}])

    # for each home: words, counts `a`, followers `b`, single pairs as previous word `c` and as word `d`
    facts = scratch.store(lexicon.select("home", "n", "text", "a").groupBy("home").cogroup(merged.where("kind = 2").select("home", "a", "b", "c", "d").groupBy("home")).applyInArrow(gather, _SQL))
    scratch.drop(merged, part="kind=2")
    told, now = merged.where("kind = 3").select("home", "bucket", "n", "a", "b", "c"), None  # every pair has one table
    spelling, rng = Spelling(), np.random.default_rng(seed)
    word_d, all_tables, old, kept, r = 0.5, 0, (-1, -1), [], 0
    while len(kept) < KEPT:
        state, people = _seat_homes(scratch, facts, told, spelling, word_d, all_tables, seed, r)
        cells = people.where("kind = 2").select("a", "b").mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        stats = people.where("kind = 1").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "m", "block", "bucket")]).first()
        customers, all_tables = stats["n"], stats["m"]
        cell, c = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
        order = np.argsort(cell)
        if len(cell):
            spelling.sweep(cell[order], c[order], rng)
        sample = _probabilities(state, spelling, word_d, customers, all_tables)
        settled = all(abs(x - y) <= SETTLED * x for x, y in zip((customers, all_tables), old))
        if r and (settled or kept or r >= BURN_IN):
            kept.append((scratch.store(sample(None)), now))
        if len(kept) < KEPT:
            after = scratch.store(_seat_buckets(seated, sample(True), d, homes, seed, r), "kind")
            if r and not any(now is x for _, x in kept):
                scratch.drop(now)
            now, told = after, after.where("kind = 3").select("home", "bucket", "n", "a", "b", "c")
        del sample, state
        scratch.drop(people)
        word_d, old, r = discount_of(stats["block"], stats["bucket"]), (customers, all_tables), r + 1

    # what blocks need: their words' values, and the counts and tables of their pairs
    samples = len(kept)

    def word_answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(right.to_pylist(), key=lambda x: x["m"])
        values = [unplane(rows[0]["a"]), unplane(rows[0]["b"])] + [unplane(x[k]) for x in rows[1:] for k in ("a", "b")]
        return _table([{"kind": 0, "block": x["block"], "home": x["home"], "n": x["n"], "m": x["m"], "a": x["a"], "b": x["b"], "text": b"".join(_framed(v[unplane(x["b"])]) for v in values)} for x in left.to_pylist()])

    own = facts.select("home", F.lit(-1).cast("long").alias("m"), "a", "b")
    for i, (values, _) in enumerate(kept):
        own = own.unionByName(values.select("home", F.lit(i).cast("long").alias("m"), "a", "b"))
    from_homes = answers.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(word_answer, _SQL)
    drawn = None
    for _, x in kept:
        part = x.where("kind = 0").select("bucket", "a")
        drawn = part if drawn is None else drawn.unionByName(part)

    def pair_answer(left: pa.Table, right: pa.Table) -> pa.Table:
        drawn = sum(unplane(x["a"]) for x in right.to_pylist())  # over the samples
        out = []
        for x in left.to_pylist():
            c = unplane(x["a"])
            t = np.where(c == 1, samples, 0)
            t[c > 1] = drawn[unstep(x["b"]).astype(np.int64)]
            out.append({"kind": 1, "block": x["block"], "bucket": x["bucket"], "a": x["a"], "b": planes(t)})
        return _table(out)

    from_buckets = merged.where("kind = 1").select("bucket", "block", "a", "b").groupBy("bucket").cogroup(drawn.groupBy("bucket")).applyInArrow(pair_answer, _SQL)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        mine, pairs = [x for x in rows if x["kind"] == 0], sorted((x for x in rows if x["kind"] == 1), key=lambda x: x["bucket"])
        wid, end = numbers_of(mine, homes)
        values = np.zeros((2 + 2 * samples, len(wid)), np.int64)
        for x in mine:
            values[:, unstep(x["a"]).astype(np.int64)] = _unframed(x["text"])
        c, follow = values[:2]
        last, word, _, pair = pairs_of(left, end)
        key = wid[last].astype(np.uint64) << np.uint64(32) | wid[word].astype(np.uint64)
        order = np.lexsort((key, bucket_of(wid[last], wid[word], buckets)))
        n, t = (np.zeros(len(order), np.int64) for _ in range(2))
        n[order], t[order] = (np.concatenate([unplane(x[k]) for x in pairs]) for k in ("a", "b"))
        with np.errstate(divide="ignore"):
            logs = [np.log(np.maximum(n - d * t / samples, 0.0))]
            for i in range(samples):
                logp, seats = values[2 + 2 * i] / -FINE, values[3 + 2 * i]
                logs.append(np.log((STRENGTH + d * seats[last]) / samples) + logp[word])
            logp = (np.logaddexp.reduce(logs, axis=0) - np.log(STRENGTH + follow[last])) / np.log(10)
        base = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        out, upto = [], 0
        for ids in left.column("ids"):
            i = unplane(ids.as_py())
            out.append((len(i), int((c[i] > 0).sum()), float(base[i].sum()), float(logp[pair[upto:upto + len(i)]].sum())))
            upto += len(i)
        cols = list(zip(*out))
        return pa.table({"id": left.column("id"), "held_out": left.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()),
                         "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})

    out = texts.groupBy("of").cogroup(from_homes.unionByName(from_buckets).groupBy("block")).applyInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _framed(values: np.ndarray) -> bytes:
    packed = planes(values)
    return len(packed).to_bytes(4, "little") + packed


def _unframed(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 4], "little")
        out.append(unplane(data[at + 4:at + 4 + n]))
        at += 4 + n
    return np.array(out)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spelling cells and their customers, row by row."""
    for b in batches:
        for cell, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(unstep(cell).astype(np.int64)), pa.array(unplane(n))], names=["cell", "n"])


def _seat_homes(scratch: Scratch, facts: DataFrame, told: DataFrame, spelling: Spelling, d: float, before: int, seed: int, r: int) -> tuple[DataFrame, DataFrame]:
    """The word restaurant seated anew. Returns the homes' states with what buckets ask, and the stored table: kind 0 states
    (words, customers `a`, tables `b`, seats as previous word `c`), 1 sums, 2 spelling cells (`a`, `b`), 3 questions (`a`, of `bucket`)."""
    look = facts.sparkSession.sparkContext.broadcast(spelling.lookup())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, asked = left.to_pylist()[0], right.to_pylist()
        tu, tw, _ = word_seats(asked, row["n"])
        customers, seats = unplane(row["d"]) + tw, unplane(row["c"]) + tu
        words = unpack_words(row["text"], row["n"])
        log_base = log_spelled(words, look.value)
        if before:
            t = seat_words(customers, log_base, d, row["m"], before, np.random.default_rng([seed, r, row["home"]]))
        else:
            t = (customers > 0).astype(np.int64)  # to begin with
        cells, word = codes(words) if words else (np.zeros(0, np.int64),) * 2
        cell, at = np.unique(cells[t[word] > 0], return_inverse=True)
        n = np.bincount(at, weights=t[word][t[word] > 0].astype(float), minlength=len(cell)).astype(np.int64)
        home = row["home"]
        return _table([{"kind": 0, "home": home, "n": row["n"], "text": row["text"], "a": planes(customers), "b": planes(t), "c": planes(seats)},
                       {"kind": 1, "n": int(customers.sum()), "m": int(t.sum()), "block": int((customers == 1).sum()), "bucket": int((customers == 2).sum())},
                       {"kind": 2, "a": steps(cell), "b": planes(n)}] + [{"kind": 3, "home": home, "bucket": x["bucket"], "n": x["n"], "a": x["a"]} for x in asked])

    # customers of all homes: a pair's first table and the others, known before any word is seated
    everyone = facts.select("d").mapInArrow(_total("d"), "n long").unionByName(told.select("c").mapInArrow(_total("c"), "n long")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = facts.select("home", "n", "text", "c", "d").withColumn("m", F.lit(everyone).cast("long"))
    stored = scratch.store(known.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(run, _SQL), "kind")
    return stored.where("kind in (0, 3)"), stored


def _total(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unplane(x).sum()) for x in b.column(0).to_pylist()], pa.int64())], names=["n"])

    return run


def _probabilities(state: DataFrame, spelling: Spelling, d: float, customers: int, all_tables: int):
    """sample(None): (home, logs `a`, seats `b`) of all words; sample(True): the answers to the buckets' questions."""
    look = state.sparkSession.sparkContext.broadcast(spelling.lookup())

    def values(row: dict) -> tuple[np.ndarray, np.ndarray]:
        c, t = unplane(row["a"]), unplane(row["b"])
        logs = word_logs(c, t, log_spelled(unpack_words(row["text"], row["n"]), look.value), d, customers, all_tables)
        return np.minimum(np.round(-logs * FINE), 2.0 ** 32 - 1).astype(np.int64), unplane(row["c"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                logs, seats = values(row)
                yield _rows([{"kind": 0, "home": row["home"], "a": planes(logs), "b": planes(seats)}])

    def answer(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        logs, seats = values(next(x for x in rows if x["kind"] == 0))
        out = []
        for x in rows:
            if x["kind"] == 3:
                at = unstep(x["a"]).astype(np.int64)
                out.append({"kind": 3, "home": x["home"], "bucket": x["bucket"], "a": planes(logs[at]), "b": planes(seats[at])})
        return _table(out)

    def sample(asked):
        return state.groupBy("home").applyInArrow(answer, _SQL).select("home", "bucket", "a", "b") if asked else state.where("kind = 0").mapInArrow(whole, _SQL).select("home", "a", "b")

    return sample


def _seat_buckets(seated: DataFrame, answers: DataFrame, d: float, homes: int, seed: int, r: int) -> DataFrame:
    """Pairs seated anew: kind 0 (bucket, tables `a`), kind 3 for the homes (places `a`, tables as previous word `b`, as word `c`)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        keys, c = unstep(row["a"]), unplane(row["b"])
        if not len(keys):
            return _table([{"kind": 0, "bucket": row["bucket"], "a": planes(c)}])
        wids, u, w = by_home(keys, homes)
        told = sorted(right.to_pylist(), key=lambda x: x["home"])
        logs, seats = (np.concatenate([unplane(x[k]) for x in told]) for k in ("a", "b"))
        rng = np.random.default_rng([seed, 1000 + r, row["bucket"]])
        t = tables(c, (STRENGTH + d * np.maximum(seats[u] - 1, 0)) * np.exp(logs[w] / -FINE), d, rng)  # about one of the tables is its own
        sums = [np.bincount(x, weights=t.astype(float), minlength=len(wids)) for x in (u, w)]
        return _table([{"kind": 0, "bucket": row["bucket"], "a": planes(t)}, *told_homes(wids, homes, row["bucket"], sums, 3)])

    return seated.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, _SQL)

"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import fim, maxscore, radix
from tabulens.llm.queries import QUERIES

from .conftest import SMALL


def plain_fim(text, key):
    h = [int(hashlib.sha256(key.encode()).hexdigest()[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    docs = duckdb.connect().execute(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    rows = fim.transform(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r["doc_id"]: r for r in fim.restore(rows).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        t = t or ""
        n, form, pre, mid, out = plain_fim(t, f"1:{i}")
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) == (n, form, pre, mid, out, t)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_awkward(spark, awkward, nothing):
    out = fim.restore(fim.transform(awkward).withColumn("row", F.lit(1)).withColumn("a b.c", F.lit(2)))
    rows = out.collect()
    assert len(rows) == awkward.count() and out.columns[-2:] == ["restored", "restored_sha256"]
    texts = sorted((r["text"] or "") for r in awkward.collect())
    assert sorted(r["restored"] for r in rows) == texts
    assert fim.transform(nothing).collect() == [] and fim.restore(fim.transform(nothing)).collect() == []
    with pytest.raises(ValueError):
        fim.restore(out)


def test_pieces_round_trip():
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice("aé😀<PSM> ") for _ in range(draw.randint(0, 12)))
        n, form, cuts, table = fim.arrange(text.encode(), str(draw.random()))
        assert n == len(text) and fim.rebuild(table.write(), form).write().decode() == text
        assert table.sha256() == hashlib.sha256(table.write()).hexdigest()
        if cuts:
            assert all(b in (fim.TEXT, fim.MARKS) for b, _, _ in table.pieces) and sum(z - a for b, a, z in table.pieces if b == fim.TEXT) == len(text.encode())
    t = fim.PieceTable.of(b"abcdef").cut([0, 2, 2, 6])
    assert [z - a for _, a, z in t.pieces] == [0, 2, 0, 4, 0] and t.write() == b"abcdef"
    assert t.permute((3, 1, 0, 2, 4)).inverse((3, 1, 0, 2, 4)).pieces == t.pieces


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain_search(docs, items, k):
    count = [(i, Counter(plain_terms(t))) for i, t in docs]
    count = [(i, c, sum(c.values())) for i, c in count if c]
    n, total = len(count), sum(x[2] for x in count)
    df = Counter(w for _, c, _ in count for w in c)
    out = []
    for item, text in set(items):
        rows = []
        for i, c, size in count:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in plain_terms(text) if w in c)
            if s > 0:
                rows.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,batch", [(4096, 200_000), (3, 200_000), (7, 25)])
def test_search(spark, monkeypatch, block, batch):
    draw = random.Random(block)
    vocabulary = [f"w{int(draw.paretovariate(0.5))}" for _ in range(400)]
    docs = [(draw.choice([None, *range(150)]), " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 30, 200]))).replace("w1", "W1")) for _ in range(200)] + [(7, "w1 w1 w2, w3"), (5, "w1 w1 w2, w3"), (7, "w1 w1 w2, w3"), (500, None)]
    items = [(i % 11, " ".join(draw.choices(vocabulary, k=draw.randint(1, 9)) + ["w1"] * (i % 3))) for i in range(14)] + [(3, None), (4, ""), (None, "w1 nowhere w2"), (None, "w1 nowhere w2"), (9, "nowhere")]
    monkeypatch.setattr(maxscore, "BLOCK_DOCS", block)
    # one task sees all blocks, so that thresholds carry over
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = maxscore.search(d, spark.createDataFrame(items, "item_id long, text string"), k=4, batch_terms=batch)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, items, 4)


def test_search_skips(monkeypatch):
    """Pair bounds leave more lists out than the sums of single maxima would."""
    docs = [f"a{i} common" if i % 2 else f"b{i} usual" for i in range(60)] + ["rare common usual"] * 3
    row = maxscore.pack_block(list(range(len(docs))), [d.encode() for d in docs], np.arange(len(docs)))
    place = {b"common": 0, b"usual": 1, b"rare": 2}
    block = maxscore.Block(row, place, np.array([10, 10, 100]), len(docs), 2 * len(docs) + 3, 2)
    block.intersect([(0, 1)])
    listed, joint, kth = block.pairs[0, 1]
    assert listed.tolist() == [60, 61, 62] and joint < block.top[0] + block.top[1] and kth == joint
    at, s = block.best([((0, 1), (1, 1)), ((2, 1),)], 0)
    assert at.tolist() == [60, 61] and len(set(s.tolist())) == 1


def test_search_awkward(spark, awkward, nothing):
    items = spark.createDataFrame([("a", "alpha école 日本語😀", 1), ("b", "the the of", 2)], "item_id string, text string, id long")
    got = maxscore.search(awkward, items).collect()
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(docs, [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert maxscore.search(nothing, items).collect() == [] and maxscore.search(awkward, items.where("false")).collect() == []


def plain_cut(docs, depth):
    first = {}
    for i, t in docs:
        for p in range(len(t) - depth + 1):
            w = t[p:p + depth]
            first[w] = min(first.get(w, math.inf), math.inf if i is None else i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - depth + 1):
            if first[t[p:p + depth]] < (math.inf if i is None else i):
                gone[p:p + depth] = b"\1" * depth
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", gone)), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("depth,block,windows,fan", [(50, 4 << 20, 12_000_000, 1024), (20, 300, 12_000_000, 1024), (33, 1000, 1500, 1024), (50, 500, 900, 2), (50, 2000, 400, 3)])
def test_windows(spark, monkeypatch, depth, block, windows, fan):
    """Blocks, buckets, split buckets and two deals give what a plain scan gives."""
    draw = random.Random(depth + block)
    vocabulary = ["alpha", "béta", "gam", "δ", "日本語", "x", "\n"]
    passages = [" ".join(draw.choices(vocabulary, k=40)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [draw.choice([draw.choice(passages), " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))]) for _ in range(draw.randint(0, 4))]
        text = "".join(parts)
        a = draw.randint(0, len(text))
        docs.append((draw.choice([None, *range(40)]), draw.choice([text, text[a:], text[:a]])))
    docs += [(100, "q" * 4000), (101, "q" * 70), (102, "q" * 49), (3, passages[0]), (3, passages[0]), (2, "z" * 300 + passages[1]), (2, passages[1] + "z" * 300), (103, ""), (104, None)]
    for name, value in (("BLOCK", block), ("WINDOWS", windows), ("FAN", fan), ("SORTED", 700)):
        monkeypatch.setattr(radix, name, value)
    # few hot 12-grams, so that some buckets are split
    got = radix.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), depth).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"] or []), bytes(r["kept"])) for r in got), key=repr)
    assert found == plain_cut([(i, (t or "").encode()) for i, t in docs], depth)
    assert all(r["kept_sha256"] == hashlib.sha256(bytes(r["kept"])).hexdigest() for r in got)


def test_windows_awkward(spark, awkward, nothing):
    got = radix.cut_repeats(awkward).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"] or []), bytes(r["kept"])) for r in got), key=repr)
    small = [(r["doc_id"], (r["text"] or "").encode()) for r in awkward.collect()]
    assert found == plain_cut(small, 50)
    assert radix.cut_repeats(nothing).collect() == []
    with pytest.raises(ValueError):
        radix.repeated_spans(awkward, 10)

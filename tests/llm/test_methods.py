"""The operators without a statement against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tabulens.llm import ann, graph, hpylm, language, lines, pieces, pii, simhash, winnow
from tabulens.llm.queries import QUERIES
from tabulens.llm.tagger import Tagger, encode

from .conftest import SMALL

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, limit=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    fps = list(fps)
    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= limit):
            x, y = find(f), find(fps[i + 1 + j])
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_documents(spark):
    rows = QUERIES["op1_simhash"](spark, SMALL).collect()
    docs = duckdb.connect().execute(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    fp = {i: plain_fingerprint(t) for i, t in docs}
    comp = plain_components(set(fp.values()))
    low = {}
    for i, f in fp.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", low[comp[f]]) for i, f in fp.items()}


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_links(spark, monkeypatch, block):
    """Dense balls, chains at distance 4, 3 + 1 splits over both halves, bit 0 and bit 63, noise."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(25):
            x = base
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
        x = base ^ rnd.getrandbits(64)
        for _ in range(8):  # a chain whose links all have distance 4
            fps.add(x)
            for b in rnd.sample(range(64), 4):
                x ^= 1 << b
    fps |= {rnd.getrandbits(64) for _ in range(200)} | {1, 1 << 63, (1 << 63) | 7}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = {r["fp"]: r["root"] for r in simhash.link(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    want = plain_components(fps)
    classes = lambda of: {frozenset(k for k in of if of[k] == r) for r in set(of.values())}
    assert classes({f: got.get(signed(f), signed(f)) for f in fps}) == classes(want)


def test_simhash_awkward(spark, awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert by[9]["component_id"] == by[6]["component_id"] == 6  # letter case does not matter
    assert by[None]["component_id"] is None
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "8", "None"])
    assert simhash.near_duplicates(nothing).collect() == [] and simhash.keep_one(nothing).collect() == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_pieces_match_the_library(spark):
    own, lib = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "▁", "a", "the", "É", "ß", "😀", "<s>", "<unk>", "<0x0A>", "12", "\x00", "ﬁ", "the▁re", "a" * 70, "日本", "\r\n", "\xa0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["", " ", "   ", "".join(rnd.choice("abcdefé") for _ in range(20_000))]
    texts += [r[0] for r in duckdb.connect().execute(f"select text from '{SMALL}/documents.parquet'").fetchall()]
    for t in texts:
        ids, start, end, decoded = own.encode(t)
        want = lib.encode(t)
        assert ids.tolist() == want and decoded.decode() == lib.decode(want) == own.decode(want)
        raw = t.encode()
        if want:  # spans are in order and cover the text
            assert start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all()
            for i, a, b in zip(want, start, end):
                piece = lib.id_to_piece(i)
                if not lib.is_byte(i) and raw[a:b].decode().replace(" ", "▁") != piece:
                    assert a == 0 and "▁" + raw[a:b].decode().replace(" ", "▁") == piece  # the added space has no bytes


def test_character_map():
    """A compiled map with two keys, laid out by hand: longest prefix, alignment, squeezed spaces."""
    # a double array for the keys "a" -> "x" and "ab" -> "yz"
    units = [0] * 512
    leaf = lambda v: 0x80000000 | v
    label = lambda c, offset, value: c | (offset << 10) | (256 if value else 0)
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = label(ord("a"), 4, True)
    units[a ^ 4] = leaf(0)
    b = (a ^ 4) ^ ord("b")
    units[b] = label(ord("b"), 8, True)
    units[b ^ 8] = leaf(2)
    import struct

    m = pieces.CharacterMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0")
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"acb", 0) == (1, b"x") and m.longest(b"cab", 0) is None and m.longest(b"cab", 1) == (2, b"yz")
    own = pieces.Pieces(MODEL)
    own.map, own.squeeze = m, 1
    norm, align = own.normalise(" ab  ca ")
    assert norm == "▁yz▁cx" and align.tolist() == [1, 1, 1, 1, 1, 3, 3, 3, 5, 6, 8]


def test_pieces_awkward(spark, awkward, nothing):
    rows = pieces.encode_documents(awkward, MODEL).collect()
    assert len(rows) == awkward.count() and all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] in (1, 2)] == [[], []]
    assert pieces.encode_documents(nothing, MODEL).collect() == []


def test_language(spark, awkward, nothing):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    out = {r["doc_id"]: r for r in QUERIES["op10_language"](spark, SMALL.replace("0.001", "0.01")).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r["held_out"]} == set(held)
    assert sum(out[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    model = language.fit(docs.select("text", "lang"), F.col("text"))
    assert model.families == ["germanic", "romance"] and model.languages["germanic"] == ["de", "en"]
    got = language.predict(awkward, model).collect()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert len(got) == awkward.count() and und == {1, 2, 3, 4} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in language.predict(awkward, None).collect()} == {"und"}
    kept = language.keep_known(docs.unionByName(awkward.select(docs.columns)), F.col("lang").isNotNull())
    assert kept.columns == docs.columns and kept.count() == docs.count() + awkward.count() - 4
    one = language.fit(spark.createDataFrame([("only words", "xx")], "text string, lang string"), F.col("text"))
    assert one.predict("any words") == ("xx", 1.0)


def test_long_text_features():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(3000))
    whole = language.features(text)
    size, language.PIECE = language.PIECE, 1000
    try:
        assert np.allclose(whole, language.features(text))
    finally:
        language.PIECE = size


def plain_winnow(docs, items):
    """Windows by brute force: {id: (n_words, n_hit, ids)}."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, u in items:
            v = words(u)
            n = min(13, len(v))
            wins = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if v else ():
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids.add(str(i))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_winnowing(spark, monkeypatch, limit):
    """Random texts over few words, so that spans repeat and overlap; both join paths."""
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", limit)
    rnd = random.Random(3)
    vocab = ["a", "B", "c", "É", "é", "dd"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(n))) for k, n in enumerate([1, 2, 5, 12, 13, 14, 40, 60, 0])]
    docs = []
    for d in range(60):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if d % 3 == 0:
            src = items[rnd.choice([4, 5, 6, 7])][1].split()
            at = rnd.randint(0, max(0, len(src) - 20))
            t[rnd.randint(0, len(t)):0] = [w.lower() if w in "B" else w for w in src[at:at + rnd.randint(10, 30)]]
        docs.append((d, ", ".join(t)))
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == plain_winnow(docs, items)


def test_winnowing_awkward(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, None), (None, "the and")], "item_id long, text string")
    rows = winnow.contamination(awkward, bench).collect()
    assert len(rows) == awkward.count()
    hit = {r["doc_id"]: r["contaminated"] for r in rows}
    assert hit[6] and hit[9] and hit[5] and not hit[1] and not hit[7]
    assert winnow.drop_contaminated(awkward, bench).columns == awkward.columns
    assert winnow.contamination(nothing, bench).collect() == []
    assert not any(r["contaminated"] for r in winnow.contamination(awkward, bench.where("false")).collect())


def plain_lines(docs, least):
    """{id: lines that are left}: every run with an earlier copy, tried at every length."""
    seq = {d: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for d, t in docs}
    first, gone = {}, {d: set() for d, _ in docs}
    for d, s in sorted(seq.items()):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                run = tuple(x for _, x in s[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    if run in first:
                        gone[d] |= {k for k, _ in s[i:j]}
                    else:
                        first[run] = (d, i)
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs}


def test_lines(spark):
    rnd = random.Random(6)
    pool = ["one", "two two", "three three three", "", "  ", "x y z u v", "only"]
    docs = [(d, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for d in range(40)]
    docs += [(50, docs[3][1]), (51, docs[3][1]), (52, "\n".join(["one"] * 30)), (53, "\n".join(f"u{k}" for k in range(20)))]
    frame = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, key string")
    got = {r["doc_id"]: r["text"] for r in lines.delete_repeats(frame, min_words=8).collect()}
    assert got == plain_lines(docs, 8)


def test_lines_awkward(spark, awkward, nothing):
    out = lines.delete_repeats(awkward, min_words=3)
    assert out.columns == [*awkward.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    text = [(r["doc_id"], r["text"], r["n_removed"]) for r in rows if r["doc_id"] in (1, 2, 6)]
    assert sorted(text, key=str) == [(1, None, 0), (2, "", 0), (6, "Alpha beta gamma", 0), (6, "Alpha beta gamma", 0)]
    assert lines.delete_repeats(nothing).collect() == []


def test_recall(spark):
    folder = SMALL.replace("0.001", "0.1")
    got = {}
    for r in QUERIES["op5_ann"](spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    data = duckdb.connect().execute(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall()
    ids, x = np.array([d[0] for d in data]), np.array([d[1] for d in data], float)
    found = 0
    for q in np.flatnonzero(ids % 100 == 0):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, dist)) if i != q][:10]
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda m: (m[2], m[1]))
        assert all(abs(dist[np.flatnonzero(ids == m[1])[0]] - m[2]) < 1e-12 for m in mine)
        found += len({int(ids[i]) for i in order} & {m[1] for m in mine})
    assert found >= 0.9 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()


def test_visits_hold_enough(spark, monkeypatch):
    """Tight far-apart groups, parts nearly empty: every query still gets k rows, with query blocks of a few rows."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.01, (n, 6)) for c, n in ((0, 700), (50, 6), (100, 5), (150, 4), (200, 285))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK", 50)
    got = ann.nearest(rows, rows.where("vec_id % 3 = 0 or vec_id between 700 and 715"), k=10).toPandas()
    assert (got.groupby("query_id").size() == 10).all() and got.query_id.nunique() == 345
    r = ann.Router(np.eye(2), np.zeros(2), np.eye(2), np.zeros(2), np.zeros(2), 1.0, probes=1)
    assert r.visits(np.array([[3.0, 1.0], [1.0, 3.0]]), np.array([2, 50]), 11) == [[0, 1], [1]]


def test_vectors_awkward(spark):
    rows = [(k, [1.0, 2.0]) for k in range(300)] + [(1000, None), (1001, [0.0, 0.0]), (1002, [1.0, None]), (1003, [float("nan"), 1.0]), (1004, [float("inf"), 1.0]), (1005, [1.0, 2.0, 3.0]), (1006, [4.0, 6.0]), (1006, [4.0, 6.0]), (None, [1.0, 2.0]), (1007, [])]
    d = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<float>, key string")
    got = {}
    for r in ann.nearest(d, d.where("vec_id in (0, 1000, 1001, 1006)")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 1006]
    assert sorted(got[0]) == [(k, k, 0.0) for k in range(1, 11)]
    assert sorted(got[1006]) == [(k + 1, k, 5.0) for k in range(10)]
    assert ann.nearest(d.where("false"), d).collect() == []


def naive_pii(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_patterns_and_windows():
    rnd = random.Random(1)
    bits = ["@", ".", "a", "b1", "1", "22", "255", "256", "300", " ", "-", "+", "(", ")", "a@b.c", "1.2.3.4", "4111111111111111", "+1 (227) 555-6608", "%", "é"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(5000)]
    for t in texts:
        assert pii.base_spans(t) == naive_pii(t)
        assert pii.windows(t) == [s for s in range(0, max(len(t), 1), pii.STEP) if pii.GATE.search(t, s, s + pii.WINDOW + pii.STEP)]
    for hard in ("a" * 200_000, "1" * 100_000, "1." * 50_000, "+1" * 50_000, "@" * 100_000, "a.b-" * 50_000):
        pii.base_spans(hard)  # linear time


def test_tagger_gradient_and_decoding():
    m, rng = Tagger(2, width=3, hidden=4), np.random.default_rng(0)
    x, y = rng.integers(0, 130, (3, 6)), np.array([[0, 1, 2, 2, 0, 3], [1, 2, 0, 3, 4, 0], [0, 0, 0, 1, 0, 0]])
    _, g = m.loss(x, y)
    for k, v in m.p.items():
        flat = v.ravel()
        for j in rng.integers(0, flat.size, 4):
            old = flat[j]
            flat[j] = old + 1e-5
            up = m.loss(x, y)[0]
            flat[j] = old - 1e-5
            down = m.loss(x, y)[0]
            flat[j] = old
            assert abs((up - down) / 2e-5 - g[k].ravel()[j]) < 1e-6
    import itertools

    em, tr = rng.normal(size=(1, 4, 5)), m.transitions()
    value = lambda p: em[0, range(4), p].sum() + m.start[p[0]] + sum(tr[a, b] for a, b in zip(p, p[1:]))
    assert m.decode(em)[0].tolist() == list(max(itertools.product(range(5), repeat=4), key=lambda p: value(list(p))))


def test_pii_long_stretches(monkeypatch):
    """A long text full of digits is decoded as one, wherever the windows that are read at a time end."""
    model, rnd = Tagger(4, seed=8), random.Random(2)
    model.p["tr"] = np.random.default_rng(1).normal(0, 1.0, (9, 9))
    model.p["out"] *= 4
    model.p["tr"][[5, 6, 7, 8], [6, 6, 8, 8]] += 3  # long spans
    monkeypatch.setattr(pii, "_good", lambda kind, s: True)
    phone = "227 (555) 660-8812"
    for offset in range(pii.STEP + 1):
        text = "".join(rnd.choice("0123456789 .-") for _ in range(16 * pii.STEP + offset)) + phone + "".join(rnd.choice("0123456789 .-") for _ in range(700))
        starts = pii.windows(text)
        length = starts[-1] + pii.WINDOW
        total, weight = np.zeros((1, length, 9)), np.zeros(length)
        near = np.minimum(np.arange(pii.WINDOW) + 1, pii.WINDOW - np.arange(pii.WINDOW))
        em = model.emissions(np.array([encode(text[s:s + pii.WINDOW], pii.WINDOW) for s in starts]))
        for s, e in zip(starts, em):
            total[0, s:s + pii.WINDOW] += e * near[:, None]
            weight[s:s + pii.WINDOW] += near
        row = model.decode(total / weight[:, None])[0]
        want = []
        for b in np.flatnonzero(row % 2 == 1):
            e = b + 1
            while e < length and row[e] == row[b] + 1:
                e += 1
            if b < len(text) and not (row[b] == 1 and b > 0 and text[b - 1] in pii.LOCAL_SET):
                want.append((int(row[b]) // 2, int(b), min(int(e), len(text))))
        assert want and pii.tag(model, ["7" * 40, text, "no", text[:500]])[1] == want


def test_stretches_apart():
    draw = random.Random(8)
    for _ in range(300):
        spans = [(0, a, a + draw.randint(1, 6)) for a in (draw.randint(0, 60) for _ in range(draw.randint(0, 12)))]
        begin, end = pii.apart(spans)
        covered = {x for _, a, z in spans for x in range(a, z)}
        assert {x for a, z in zip(begin, end) for x in range(a, z)} == covered and all(z <= a for z, a in zip(end, begin[1:]))


def test_pii_documents(spark, awkward, nothing):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    model = pii.fit(docs, F.col("doc_id"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain = Tagger(4)
    plain.p = model.p
    held = [t for t in text.values() if re.search("[0-9@]", t)]
    found, true = [set(x) for x in pii.tag(model, held)], [set(pii.base_spans(t)) for t in held]
    both = sum(len(a & b) for a, b in zip(found, true))
    assert both >= 0.5 * sum(map(len, true)) and both >= 0.8 * sum(map(len, found))
    for r in pii.find(docs, model).collect():
        t = text[r["doc_id"]]
        base = [(x["kind"], x["start"], x["stop"]) for x in r["base"]]
        spans = [(x["kind"], x["start"], x["stop"]) for x in r["spans"]]
        assert base == [(pii.KINDS[k], a, b) for k, a, b in naive_pii(t)] and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    rows = pii.find(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r["base"] == [] for r in rows)
    assert pii.fit(nothing, F.col("doc_id")) is None and pii.find(nothing, None).collect() == []


def test_tables_follow_the_restaurant():
    """Mean number of tables against the exact expectation of the seating process."""
    rng = np.random.default_rng(1)
    d, w, c = 0.5, 2.0, 400
    mean = hpylm.tables(np.full(4000, c), np.full(4000, w), d, rng).mean()
    p = np.zeros(c + 2)
    p[1] = 1.0
    for n in range(1, c):
        t = np.arange(c + 2)
        new = w / (w + np.maximum(n - d * t, 1e-9))
        q = p * (1 - new)
        q[1:] += (p * new)[:-1]
        p = q
    assert abs(mean / (p * np.arange(c + 2)).sum() - 1) < 0.03
    assert hpylm.tables(np.array([0, 1, 2]), np.ones(3), 0.5, rng)[:2].tolist() == [0, 1]


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(2)
    k = hpylm.SYMBOLS
    s = hpylm.Spelling()
    assert np.allclose(hpylm.log_spelled([b"ab", b""], s.lookup()), -np.log(k) * np.array([3, 1]))
    cell = np.unique(rng.integers(0, 6, (60, 3)) @ [k * k, k, 1])
    for _ in range(3):
        s.sweep(cell, rng.integers(1, 9, len(cell)), rng)
        assert np.allclose(s.two.sum(-1), 1) and np.allclose(s.one.sum(-1), 1) and abs(s.none.sum() - 1) < 1e-9 and (s.two > 0).all()
    words = [b"ab", b"", b"c"]
    cells, of = hpylm.codes(words)
    e = hpylm.END
    want = [(e, e, 97), (e, 97, 98), (97, 98, e), (e, e, e), (e, e, 99), (e, 99, e)]
    assert of.tolist() == [0, 0, 0, 1, 2, 2] and cells.tolist() == [(a * k + b) * k + c for a, b, c in want]
    rows, logs = s.lookup()
    assert logs[rows[5 * k + 200], 7] == np.log(s.one[200, 7])  # a context that doesn't occur


def test_packing():
    for a in (np.zeros(0, np.int64), np.array([0, 5, 1 << 31]), np.array([3, 1 << 40])):
        assert hpylm.unplane(hpylm.planes(a)).tolist() == a.tolist() and hpylm.unstep(hpylm.steps(a)).tolist() == a.tolist()
        assert hpylm._unframed(hpylm._framed(a) + hpylm._framed(a)).tolist() == [a.tolist()] * 2
    for words in ([], [b""], [b"a", b""], [b"", b"xyz"]):
        assert hpylm.unpack_words(hpylm.pack_words(words), len(words)) == words


def plain_model(texts, sweeps, burn, seed):
    """The same hierarchy of pairs over words over a fixed uniform spelling of 257 symbols, customer by customer. Returns
    the averaged predictive probability as a function of (previous word, word), with the given discounts."""
    draw = random.Random(seed)
    pairs = Counter()
    for t in texts:
        w = [*t.split(), ""]
        pairs.update(zip(["", *w], w))
    ones = lambda c: hpylm.discount_of(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d = ones(pairs)
    base = lambda w: hpylm.SYMBOLS ** -(len(w.encode()) + 1.0)
    t = Counter(dict.fromkeys(pairs, 1))  # tables of pairs
    people = Counter()
    for _, w in pairs:
        people[w] += 1
    wt = Counter(dict.fromkeys(people, 1))
    follow, samples = Counter(), []
    for (u, _), c in pairs.items():
        follow[u] += c

    def seat(c, strength, parent, d):
        k = 1
        for n in range(1, c):
            a = strength * parent
            k += draw.random() < a / (a + n - d * k)
        return k

    for s in range(sweeps):
        wd, n, all_t = ones(people), sum(people.values()), sum(wt.values())
        for w, c in people.items():
            all_t -= wt[w]
            wt[w] = seat(c, 1 + wd * all_t, base(w), wd)
            all_t += wt[w]
        word = lambda w, wt=dict(wt), people=dict(people), all_t=all_t, n=n, wd=wd: (max(people.get(w, 0) - wd * wt.get(w, 0), 0) + (1 + wd * all_t) * base(w)) / (1 + n)
        seats = Counter()
        for (u, _), k in t.items():
            seats[u] += k
        if s >= burn:
            samples.append(lambda u, w, t=dict(t), seats=dict(seats), word=word: (max(pairs[u, w] - d * t.get((u, w), 0), 0) + (1 + d * seats.get(u, 0)) * word(w)) / (1 + follow[u]))
        for (u, w), c in pairs.items():
            seats[u] -= t[u, w]
            people[w] -= t[u, w]
            t[u, w] = seat(c, 1 + d * seats[u], word(w), d)
            seats[u] += t[u, w]
            people[w] += t[u, w]
    return lambda u, w: sum(x(u, w) for x in samples) / len(samples), d, sum(t.values())


def test_scores_against_a_plain_sampler(spark, monkeypatch):
    """Scores on a small corpus against customer-by-customer seating, with the spelling held uniform."""
    rnd = random.Random(9)
    chain = {w: rnd.sample("abcdefghijkl", 4) for w in "abcdefghijkl"}

    def text():
        w = [rnd.choice("abc")]
        while len(w) < 40:
            w.append(rnd.choice(chain[w[-1]]) if rnd.random() < 0.9 else rnd.choice("abcdefghijkl"))
        return " ".join(w)

    texts = [text() for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i < 45) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(2)
    monkeypatch.setattr(hpylm.Spelling, "sweep", lambda self, cell, c, rng: None)
    monkeypatch.setattr(hpylm, "KEPT", 3)
    got = {r["doc_id"]: r for r in hpylm.score(docs, F.col("learn"), pairs_per_bucket=500, home_bytes=1000).collect()}
    plain, _, _ = plain_model(texts[:45], 25, 15, 1)
    for i in range(45, 60):
        w = [*texts[i].split(), ""]
        want = sum(math.log10(plain(u, x)) for u, x in zip(["", *w], w))
        assert abs(got[i]["score"] / want - 1) < 0.02, (i, got[i]["score"], want)


def test_words_are_a_distribution():
    """Known words and the mass of unknown ones add up to one, whatever was drawn."""
    rng = np.random.default_rng(3)
    words = [bytes([97 + i, 98]) for i in range(20)]
    customers = rng.integers(0, 40, 20)
    s = hpylm.Spelling()
    t = hpylm.seat_words(customers, hpylm.log_spelled(words, s.lookup()), 0.6, int(customers.sum()), 25, rng)
    cells, of = hpylm.codes(words)
    cell, at = np.unique(cells[t[of] > 0], return_inverse=True)
    s.sweep(cell, np.bincount(at, weights=t[of][t[of] > 0]).astype(np.int64), rng)
    base = hpylm.log_spelled(words, s.lookup())
    known = np.exp(hpylm.word_logs(customers, t, base, 0.6, int(customers.sum()), int(t.sum()))).sum()
    unknown = (hpylm.STRENGTH + 0.6 * t.sum()) / (hpylm.STRENGTH + customers.sum()) * (1 - np.exp(base).sum())
    assert abs(known + unknown - 1) < 1e-9


def test_model_scores(spark, awkward, nothing):
    rows = {r["doc_id"]: r for r in QUERIES["op9_hpylm"](spark, SMALL).collect()}
    docs = duckdb.connect().execute(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        w, r = tokens(t), rows[i]
        base = sum(math.log10((counts[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(counts[k] > 0 for k in w), n)
        assert abs(r["base_score"] - base) < 1e-9 * abs(base) and -20 * len(w) < r["score"] < 0
    odd = hpylm.score(awkward, F.lit(True)).collect()
    assert len(odd) == awkward.count() and all(math.isfinite(r["score"]) for r in odd)
    assert all(r["n_tokens"] == 1 for r in odd if r["doc_id"] in (1, 2, 3))
    none = hpylm.score(awkward, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)
    assert hpylm.score(nothing, F.lit(True)).collect() == []


def test_scores_follow_word_order(spark):
    """A held-out text in the order of the training texts scores higher than the same words shuffled,
    with many buckets as with one."""
    rnd = random.Random(4)
    rows = [(i, " ".join(f"{a}{k}" for k in rnd.sample(range(30), 10) for a in ("a", "b", "c")), True) for i in range(80)]
    text = rows[0][1].split()
    other = text[1::2] + text[::2]
    rows += [(100, " ".join(text), False), (101, " ".join(other), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    for more in ({}, {"pairs_per_bucket": 200, "home_bytes": 3000}):
        got = {r["doc_id"]: r for r in hpylm.score(docs, F.col("learn"), **more).collect()}
        assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > got[101]["score"] + 10
        assert got[100]["score"] > got[100]["base_score"]


def test_keep_known(spark):
    """Scripts and letter salads that no learned language covers go; without labels every text with a letter stays."""
    learned = [(i, " ".join(random.Random(i).choices(w, k=60)), g) for i in range(120) for g, w in (("en", "the of house tree water green walks this with over".split()), ("de", "das und haus baum wasser grün läuft dieser mit über".split()))]
    odd = [(1000, "日本語のテキストです。今日は天気がいい", None), (1001, "12 34", None), (1002, None, "en"), (1003, "the water of this green house walks over the tree with the house", None)]
    docs = spark.createDataFrame([(i * 2 + (g == "de"), t, g) for i, t, g in learned] + odd, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.keep_known(docs, F.col("doc_id") < 1000).collect()}
    assert kept == {*range(240), 1003}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_known(bare, F.lit(True)).count() == 242


def test_keep_one_judges_texts(spark):
    """One id on two texts, null ids and clashing columns: exactly one row per component, clean texts stay."""
    a = " ".join(f"w{i}" for i in range(80))
    b = " ".join(f"v{i}" for i in range(80))
    c = " ".join(f"u{i}" for i in range(80))
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c + " more"), (None, a), (7, None), (8, ""), (9, c)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, digest int, row int, keep_id int")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (7, None), (9, c)], key=repr) and simhash.keep_one(docs).columns == docs.columns


def test_clashing_columns(spark):
    passage = " ".join(f"b{i}" for i in range(60))
    names = "_lost _gone _first _key _id _k n_lines n_removed row key id".split()
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in ((1, passage), (2, passage + "\nnew line"), (3, "clean words"))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = lines.delete_repeats(docs)
    assert sorted(out.columns) == sorted(docs.columns) and {r["doc_id"]: (r["text"], r["_lost"]) for r in out.collect()} == {1: (passage, 0), 2: ("new line", 0), 3: ("clean words", 0)}
    kept = winnow.drop_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    words = [" ".join(random.Random(k).choice(["the", "of", "house", "tree", "water", "green", "walks"]) + str(random.Random(k * 99 + j).randint(0, 500)) for j in range(80)) for k in range(12)]
    passage = " ".join(f"bench{k}" for k in range(30))
    docs = [(k, t) for k, t in enumerate(words)]
    docs += [(20, words[0]), (21, words[1] + " extra"), (22, None), (23, "12 34 %%"), (24, f"start {passage} end"), (25, ""), (26, words[2] + "\nnew line here")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 20 is a copy, 21 a near copy, 22, 23 and 25 have no letters, 24 is contaminated, 26 keeps its new line
    assert sorted(got) == [*range(12), 26]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = lib.encode("new line here")
    assert got[26]["n_tokens"] == len(ids) and got[26]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "simhash", "decontamination", "sentencepiece"]


def test_decontamination_reads_documents_once(spark, tmp_path, monkeypatch):
    """One scan of the texts finds hits and counts words, and repeated rows and texts without words keep their rows; the path for large benchmarks agrees."""
    item = " ".join(f"w{i}" for i in range(15))
    rows = [(1, "a b " + item + " c"), (1, "a b " + item + " c"), (2, "short text"), (2, "other"), (None, item.upper()), (3, None), (4, ""), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([("7", item), ("8", "short text")], "item_id string, text string")
    out = winnow.contamination(docs, bench)
    flat = lambda rs: sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in rs)
    got = flat(out.collect())
    assert got == sorted([("1", 18, 15, 1, ["7"], True)] * 2 + [("2", 2, 2, 1, ["8"], True), ("2", 1, 0, 0, [], False), ("None", 15, 15, 1, ["7"], True), ("3", 0, 0, 0, [], False)] + [("4", 0, 0, 0, [], False)] * 2)
    assert str(tmp_path / "d") not in out._jdf.queryExecution().optimizedPlan().toString() and "Relation" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    assert flat(winnow.contamination(docs, bench).collect()) == got

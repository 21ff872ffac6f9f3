"""Personal data in texts: fixed patterns, and spans found by a character tagger.

The patterns give the base spans, in linear time whatever the text. The tagger is a
bidirectional LSTM with CRF transitions, fitted in numpy on windows around labelled spans of a
bounded sample. It reads overlapping windows of the whole text; windows with no digit or `@` in
them or close behind are outside by definition, since every kind needs one. The scores of overlapping windows are
averaged, and each connected stretch of windows is decoded once as a whole: windows are read some at
a time, forward scores and back pointers are carried from one share to the next. Spans that pass a
kind's minimum are added where they touch no base span.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tagger import Path, Tagger, encode

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STEP = 64, 32
SAMPLE_DOCS = 2000  # labelled texts that are looked at for training, about
SAMPLE_WINDOWS = 1500  # windows that are fitted at most
PER_TEXT = 50  # spans of one text that are fitted at most
BATCH = 2048  # windows tagged at a time
SHARE = 16  # windows of a stretch that are read at a time; the decoder is carried from share to share

# The patterns. Look-behinds only keep a search from starting inside a run again.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
GATE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of every kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        hit = DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if hit:
            out.append((0, start, hit.end()))
            done = hit.end()
        at = text.find("@", done)
    if re.search("[0-9]", text) is None:
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows (on a grid) with a digit or `@` in them or in the step behind them."""
    starts: list[int] = []
    hit = GATE.search(text)
    while hit:
        cell = hit.start() // STEP
        starts += [c * STEP for c in range(max(0, cell - 2), cell + 1) if not starts or c * STEP > starts[-1]]
        hit = GATE.search(text, (cell + 1) * STEP)
    return starts


def _tags(spans, start: int, length: int) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if a >= start and a < start + length:
            y[a - start] = 1 + 2 * kind
        lo, hi = max(a + 1, start), min(b, start + length)
        if lo < hi and a >= start:
            y[lo - start:hi - start] = 2 + 2 * kind
    return y


def examples(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled windows of one text. Phones also appear without their plus sign and cards with
    other gaps, so that the tagger learns forms beyond the patterns."""
    spans = base_spans(text)
    out = []
    for kind, a, b in spans[:PER_TEXT]:
        s = max(0, a - (a * 7 + b) % 24)
        whole = text[s:s + WINDOW]
        out.append((whole, [(k, x - s, y - s) for k, x, y in spans]))
        if kind == 3:
            cut = text[s:a] + text[a + 1:a + 1 + WINDOW]
            out.append((cut, [(3, a - s, b - s - 1)]))
        if kind == 2 and b - a == 16:
            new = "-".join(text[a + i:a + i + 4] for i in range(0, 16, 4))
            out.append((text[s:a] + new + text[b:b + WINDOW], [(2, a - s, a - s + 19)]))
    taken = [(a, b) for _, a, b in spans]
    for s in windows(text)[:4]:
        if not any(a < s + WINDOW and s < b for a, b in taken):
            out.append((text[s:s + WINDOW], []))
    return [(encode(t[:WINDOW], WINDOW), _tags([x for x in sp if x[1] >= 0], 0, WINDOW)) for t, sp in out]


def fit(docs: DataFrame, key: Column, sample: int = SAMPLE_DOCS) -> Tagger | None:
    """Tagger from the base spans of about `sample` texts with a digit or `@`, chosen by a hash of
    `key` (no sort, so nothing meets in one task); None if they hold no span."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(key), F.lit(1_000_003)).alias("at")).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, sample / max(rows.count(), 1))
    picked = rows.where(F.col("at") < int(1_000_003 * share) + 1).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [e for t in b.column(0) for e in examples(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint8).tobytes() for x, _ in got], pa.binary()), pa.array([y.astype(np.uint8).tobytes() for _, y in got], pa.binary())], names=["x", "y"])

    got = sorted((bytes(r["x"]), bytes(r["y"])) for r in picked.mapInArrow(run, "x binary, y binary").distinct().collect())  # a few hundred bytes for each window of the sample
    got = got[:: max(1, -(-len(got) // SAMPLE_WINDOWS))]
    if not any(any(y) for _, y in got):
        return None
    model = Tagger(len(KINDS))
    model.fit(np.array([np.frombuffer(x, np.uint8) for x, _ in got], np.int64), np.array([np.frombuffer(y, np.uint8) for _, y in got], np.int64))
    return model


def _good(kind: int, s: str) -> bool:
    """Least content of a tagged span."""
    n = len(_digits(s))
    if kind == 0:
        return "@" in s[1:-1] and not re.search(r"\s", s)
    if kind == 1:
        return s.count(".") == 3 and s[0].isdigit() and s[-1].isdigit() and all(p.isdigit() and int(p) <= 255 for p in s.split(".") if len(p) < 4) and all(len(p) < 4 for p in s.split("."))
    if kind == 2:
        return 16 <= n <= 19 and luhn(_digits(s))
    return 8 <= n <= 15 and re.fullmatch(r"[\x20().0-9+-]+", s) is not None and re.search(r"[().\x20-]", s) is not None


def tag(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) tagged in every text."""
    jobs = [(k, s) for k, t in enumerate(texts) for s in windows(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stretches: list[list[tuple[int, int]]] = []
    for j in jobs:
        last = stretches[-1] if stretches else None
        if last and last[-1][0] == j[0] and j[1] - last[-1][1] <= STEP:
            last.append(j)
        else:
            stretches.append([j])
    by_size: dict[int, list[list[tuple[int, int]]]] = {}
    for s in stretches:
        by_size.setdefault(len(s), []).append(s)
    near = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)  # a window knows its middle best
    for size, group in by_size.items():
        for i in range(0, len(group), max(1, BATCH // min(size, SHARE))):
            part = group[i:i + max(1, BATCH // min(size, SHARE))]
            path = Path(model, len(part))
            total, weight = np.zeros((len(part), WINDOW - STEP, model.tags)), np.zeros(WINDOW - STEP)  # what windows before left open
            for first in range(0, size, SHARE):
                n = min(SHARE, size - first)
                x = np.array([encode(texts[k][s:s + WINDOW], WINDOW) for st in part for k, s in st[first:first + n]])
                em = model.emissions(x).reshape(len(part), n, WINDOW, model.tags)
                total = np.concatenate([total, np.zeros((len(part), n * STEP, model.tags))], axis=1)
                weight = np.concatenate([weight, np.zeros(n * STEP)])
                for w in range(n):
                    at = slice(w * STEP, w * STEP + WINDOW)
                    total[:, at] += em[:, w] * near[:, None]
                    weight[at] += near
                done = n * STEP if first + n < size else total.shape[1]
                path.add(total[:, :done] / weight[None, :done, None])
                total, weight = total[:, done:], weight[done:]
            for (k, s), row in zip((st[0] for st in part), path.tags()):
                for b in np.flatnonzero(row % 2 == 1):
                    e = b + 1
                    while e < len(row) and row[e] == row[b] + 1:
                        e += 1
                    a, z = s + int(b), min(s + int(e), len(texts[k]))
                    cut = row[b] == 1 and a > 0 and texts[k][a - 1] in LOCAL_SET  # the start of an email is missing
                    if a < z and not cut and _good(int(row[b]) // 2, texts[k][a:z]):
                        out[k].append((int(row[b]) // 2, a, z))
    return out


def apart(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Begin and end of the disjoint stretches that spans cover, in order."""
    begin: list[int] = []
    end: list[int] = []
    for _, a, z in sorted(spans, key=lambda x: x[1]):
        if end and a < end[-1]:
            end[-1] = max(end[-1], z)
        else:
            begin.append(a)
            end.append(z)
    return begin, end


def find(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans): arrays of (kind, start, stop) in code points, by kind, then start.

    Null texts count as empty and give empty arrays; null ids stay null; other columns are not read; an
    empty table gives no rows. Spans of the
    tagger join those of the patterns where they overlap none; among themselves the first wins.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind_type = slim.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    named = lambda rows: [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                full = [list(b) for b in base]
                if m is not None:
                    for rows, more in zip(full, tag(m, texts)):
                        begin, end = apart(rows)
                        for k, a, z in sorted(more, key=lambda x: x[1]):
                            i = bisect.bisect_left(begin, z)
                            if not i or end[i - 1] <= a:
                                rows.append((k, a, z))
                                begin.insert(i, a)
                                end.insert(i, z)
                        rows.sort()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([named(b) for b in base], span), pa.array([named(f) for f in full], span)], names=["id", "base", "spans"])

    element = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return slim.mapInArrow(run, f"id {kind_type}, base {element}, spans {element}").withColumnRenamed("id", id_col)

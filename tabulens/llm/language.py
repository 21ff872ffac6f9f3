"""Language identification in two levels: family first, then one-against-one linear support
vector machines between the languages of that family.

Features are hashed byte n-grams (1 to 3) of the lower-cased letters of a whole text. Spark
makes the features and the predictions; the machines are fitted in numpy on a bounded sample
of labelled rows.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 4096
REJECT = 0.25  # least score of a recognised language: a toss-up on both levels (documents of learned languages scored 0.35 or more)
COVERED = 0.5  # least share of a recognised text's letters that are letters of the learned languages
LETTER_SHARE = 0.005  # of the sampled texts must hold a letter that counts as learned
SAMPLE_ROWS = 2000  # labelled rows that are fitted at most, shared evenly by the languages
PIECE = 1 << 20  # bytes counted at a time

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn mr ur pa gu ne",
    "semitic": "ar he mt am",
    "celtic": "ga cy gd br",
}
FAMILY_OF = {code: f for f, codes in FAMILIES.items() for code in codes.split()}
BLANK = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def family(code: str) -> str:
    return FAMILY_OF.get(code.lower().replace("_", "-").split("-")[0], code)


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted n-gram counts."""
    counts = np.zeros(DIMENSIONS, np.int64)
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(BLANK).split()) + b" "
    for i in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[max(0, i - 2):i + PIECE], np.uint8).astype(np.uint32)
        lead = 2 if i else 0  # the last two bytes before this piece, so that no n-gram is lost
        two = (b[:-1] << 8) | b[1:]
        for n, code in ((1, b[lead:]), (2, two[max(lead - 1, 0):]), (3, (two[:-1] << 8) | b[2:])):
            mixed = (code + np.uint32(n * 0x1000193)) * np.uint32(2654435761)
            counts += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
    v = np.sqrt(counts, dtype=np.float64)
    return v / max(np.linalg.norm(v), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1000.0, steps: int = 200) -> np.ndarray:
    """Weights (last one the offset) of a squared-hinge machine by accelerated descent; y is +1 or
    -1, both classes weigh alike. Works in single precision and copies no features."""
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    rate = 1.0 / (1.0 / c + 4.0)
    w = last = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(steps):
        z = w + np.float32(k / (k + 3.0)) * (w - last)
        pull = 2.0 * weight * np.maximum(0.0, 1.0 - y * (x @ z[:-1] + z[-1])) * y
        last, w = w, z - np.float32(rate) * (z / np.float32(c) - np.append(pull @ x, pull.sum()))
    return w.astype(np.float64)


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    level1: np.ndarray  # one row per pair of families
    level2: dict[str, np.ndarray]  # one row per pair of a family's languages
    letters: frozenset[str] = frozenset()  # of the learned languages, lower-cased

    def knows(self, text: str, least: float = REJECT) -> bool:
        """Whether a learned language is recognised in the text."""
        mine = [c for c in text.lower() if c.isalpha()]
        return bool(mine) and sum(c in self.letters for c in mine) >= COVERED * len(mine) and self.predict(text)[1] >= least

    @staticmethod
    def _vote(w: np.ndarray, names: list[str], v: np.ndarray) -> tuple[str, float]:
        """Winner of all pairs, and how sure its weakest win is (0 to 1)."""
        if len(names) == 1:
            return names[0], 1.0
        margin = w[:, :-1] @ v + w[:, -1]
        wins, worst = np.zeros(len(names)), np.full(len(names), np.inf)
        for m, (a, b) in zip(margin, itertools.combinations(range(len(names)), 2)):
            wins[a if m >= 0 else b] += 1
            worst[a], worst[b] = min(worst[a], m), min(worst[b], -m)
        best = max(range(len(names)), key=lambda k: (wins[k], worst[k]))
        return names[best], float(1.0 / (1.0 + np.exp(-4.0 * worst[best])))

    def predict(self, text: str) -> tuple[str, float]:
        v = features(text)
        f, p = self._vote(self.level1, self.families, v)
        lang, q = self._vote(self.level2[f], self.languages[f], v)
        return lang, p * q


def _pairs(names: list[str], of: np.ndarray, x: np.ndarray) -> np.ndarray:
    rows = []
    for a, b in itertools.combinations(names, 2):
        pick = (of == a) | (of == b)
        rows.append(fit_svm(x[pick], np.where(of[pick] == a, 1.0, -1.0)))
    return np.array(rows).reshape(len(rows), DIMENSIONS + 1)


def fit(labelled: DataFrame, key: Column, sample: int = SAMPLE_ROWS) -> Model | None:
    """Fit from (text, lang) rows; None without any labelled row.

    At most about `sample` whole rows are used: of every language the same number, chosen by a
    hash of `key`. The number of languages is that of the label column's codes.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.pmod(F.xxhash64(key), F.lit(1_000_003)).alias("at"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    each = max(2, sample // len(sizes))
    limits = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(1_000_003 * min(1.0, each / n)) + 1)])
    picked = rows.where(F.col("at") < limits[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                vec = [features(t.as_py()).astype(np.float16).tobytes() for t in part.column(0)]
                seen = ["".join(sorted({c for c in t.as_py().lower() if c.isalpha()})) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(vec, pa.binary()), pa.array(seen, pa.string())], names=["lang", "at", "vec", "letters"])

    got = picked.mapInArrow(run, "lang string, at long, vec binary, letters string").toArrow()
    got = got.sort_by([("lang", "ascending"), ("at", "ascending"), ("vec", "ascending")])
    x = np.empty((got.num_rows, DIMENSIONS), np.float32)
    for i, v in enumerate(got.column("vec")):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    langs = np.array(got.column("lang").to_pylist(), object)
    held = Counter(c for t in got.column("letters").to_pylist() for c in t)
    letters = frozenset(c for c, n in held.items() if n >= LETTER_SHARE * len(langs))
    del got
    fams = np.array([family(g) for g in langs], object)
    by = {f: sorted({g for g, h in zip(langs, fams) if h == f}) for f in sorted(set(fams))}
    return Model(list(by), by, _pairs(list(by), fams, x), {f: _pairs(by[f], langs[fams == f], x[fams == f]) for f in by}, letters)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row; only the text is looked at.

    `und` with score 0 if the text is null, empty or has no letter, or if nothing was learned.
    The model (a few weights per pair of languages) travels with the tasks.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = [("und", 0.0) if m is None or not t.is_valid else m.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["id", "lang_pred", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", sample: int = SAMPLE_ROWS) -> DataFrame:
    """(id_col, lang_pred, score): learned from the rows where `learn` holds, predicted for all."""
    model = fit(docs.where(learn).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col(id_col).cast("string").alias("k")), F.col("k"), sample)
    return predict(docs, model, id_col)


def keep_known(docs: DataFrame, learn: Column, id_col: str = "doc_id", sample: int = SAMPLE_ROWS, least: float = REJECT) -> DataFrame:
    """Rows of `docs` in a language that was learned, all columns as they were.

    Null, empty and letterless texts go, texts of which most letters belong to no learned language, and
    texts whose prediction scores below `least`. Where nothing was learned, all texts with a letter stay."""
    labelled = docs.where(learn).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col(id_col).cast("string").alias("k"))
    model = fit(labelled, F.col("k"), sample)
    lettered = docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    if model is None:
        return lettered
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [t.is_valid and sent.value.knows(t.as_py(), least) for t in b.column(at)]
            yield b.filter(pa.array(known, pa.bool_()))

    return lettered.mapInArrow(run, docs.schema)

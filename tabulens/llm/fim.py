"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, stop) over two immutable buffers, its UTF-8
text and the sentinels. Cutting splits descriptors, an arrangement permutes them and puts
sentinel descriptors between them, and the inverse permutation restores the text; no text is
copied until an output is written, and digests stream descriptor by descriptor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SALT = "1:"
PLAIN_FROM, SPM_BELOW = 90, 20  # percent: texts left as they are; of the others, suffix first
TEXT, MARKS = 0, 1
# order of (prefix, middle, suffix) in the output of each form
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


@dataclass
class PieceTable:
    """Descriptors over buffers that are never written."""

    buffers: tuple[bytes, bytes]
    pieces: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, text: bytes, sentinels: tuple[str, ...] = SENTINELS) -> PieceTable:
        return cls((text, "".join(sentinels).encode()), [(TEXT, 0, len(text))])

    def cut(self, offsets: list[int]) -> PieceTable:
        """Splits the descriptors at output offsets (ascending, repeats give empty pieces)."""
        out, seen, left = [], 0, list(offsets)
        for buffer, start, stop in self.pieces:
            while left and left[0] <= seen + stop - start:
                at = start + left.pop(0) - seen
                out.append((buffer, start, at))
                seen, start = seen + at - start, at
            out.append((buffer, start, stop))
            seen += stop - start
        return PieceTable(self.buffers, out)

    def permute(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def inverse(self, order: tuple[int, ...]) -> PieceTable:
        """Undoes permute(order)."""
        return self.permute(tuple(np.argsort(order).tolist()))

    def marked(self, marks: list[tuple[int, int]]) -> PieceTable:
        """Puts a range of the sentinel buffer before every piece."""
        return PieceTable(self.buffers, [p for mark, piece in zip(marks, self.pieces) for p in ((MARKS, *mark), piece)])

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        for buffer, start, stop in self.pieces:
            if start < stop:
                yield views[buffer][start:stop]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def write(self) -> bytes:
        return b"".join(self.stream())


def _ranges(sentinels: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where each sentinel stands in the sentinel buffer."""
    ends = np.cumsum([len(s.encode()) for s in sentinels]).tolist()
    return list(zip([0, *ends], ends))


def _offsets(text: bytes, places: tuple[int, ...], n: int) -> list[int]:
    """Byte offsets of code points."""
    if n == len(text):
        return list(places)
    leads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(leads[p]) if p < n else len(text) for p in places]


def arrange(text: bytes, key: str, sentinels: tuple[str, ...] = SENTINELS) -> tuple[int, str, tuple[int, int] | None, PieceTable]:
    """(code points, form, the two cuts in code points, pieces of the output). `key` draws cuts and form."""
    n = len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    table = PieceTable.of(text, sentinels)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or h[2] % 100 >= PLAIN_FROM or any(s.encode() in text for s in sentinels):
        return n, "plain", None, table
    form = "spm" if h[3] % 100 < SPM_BELOW else "psm"
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    order, marks = ORDERS[form], _ranges(sentinels)
    own = (marks[0], marks[2], marks[1])  # of prefix, middle, suffix
    return n, form, (a, b), table.cut(_offsets(text, (a, b), n)).permute(order).marked([own[i] for i in order])


def rebuild(output: bytes, form: str, sentinels: tuple[str, ...] = SENTINELS) -> PieceTable:
    """Pieces of the text that an output of this form was made of, as descriptors over the output.

    Such a text holds no sentinel, and a sentinel can't overlap a neighbour, so the first place of each is its own."""
    if form == "plain":
        return PieceTable.of(output, sentinels)
    order = ORDERS[form]
    own = (sentinels[0], sentinels[2], sentinels[1])
    heads = [own[i].encode() for i in order]
    at = [output.index(h) for h in heads]
    pieces = [(TEXT, a + len(h), z) for a, h, z in zip(at, heads, [*at[1:], len(output)])]
    return PieceTable((output, b""), pieces).inverse(order)


def transform(docs: DataFrame, id_col: str = "doc_id", salt: str = SALT, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output, output_sha256, pieces) for every row.

    n counts code points. Form is plain (the text itself) for empty texts, texts that hold a
    sentinel and a tenth of the others; prefix_chars and middle_chars are null then. pieces are
    the output's descriptors (buffer 0 the text, 1 the sentinels; byte ranges). The draw depends on
    `salt` and the id only, so equal ids draw alike; a null id draws as an empty one. Null texts are
    empty. Every row of `docs` gives one row; other columns are left out; an empty table gives none.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    piece = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _parts(b.column(2)):
                part, rows = b.slice(lo, hi - lo), []
                for key, text in zip(part.column(1).to_pylist(), part.column(2)):
                    n, form, cuts, table = arrange(text.as_py(), key, sentinels)
                    first, second = cuts or (None, None)
                    rows.append((n, form, first, second - first if cuts else None, table.write(), table.sha256(), [dict(zip(("buffer", "start", "stop"), p)) for p in table.pieces]))
                cols = list(zip(*rows))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), piece)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "pieces"])

    out = slim.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string, pieces array<struct<buffer:int,start:long,stop:long>>")
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restore(rows: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """`rows` (output, form, ...) with `restored`, the text rebuilt from them, and `restored_sha256`.

    A null output or form restores to null; a form that the output does not have is an error."""
    if {"restored", "restored_sha256"} & set(rows.columns):
        raise ValueError("rows already have restored columns")
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("output").cast("binary").alias("output"), "form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, digests = [], []
            for output, form in zip(b.column(1), b.column(2).to_pylist()):
                table = rebuild(output.as_py(), form, sentinels) if output.is_valid and form is not None else None
                texts.append(table and table.write())
                digests.append(table and table.sha256())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), pa.array(digests, pa.string())], names=["row", "restored", "restored_sha256"])

    out = packed.mapInArrow(run, StructType([packed.schema["row"]]).add("restored", BinaryType()).add("restored_sha256", StringType()))
    return out.select("row.*", F.col("restored").cast("string").alias("restored"), "restored_sha256")


def _parts(texts: pa.Array, limit: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text, so that long texts don't meet in one batch."""
    lo = size = 0
    for i, x in enumerate(texts):
        size += len(x.as_buffer() or b"")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)

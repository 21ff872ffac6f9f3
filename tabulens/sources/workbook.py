"""Workbooks (.xlsx, .xlsm) without an extra package: zip and XML are read where the file is.

Every file is one row of Spark's binary scan. Its first sheet streams by cell by cell; shared strings,
dates by number format, booleans and errors become typed cells. Column types come from all
cells of all files, so a late text cell makes its column text.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_header
from .files import UnusableTable

# Number formats that mean a date or a time.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
ROWS = 10_000  # rows of a sheet that travel together
CELLS = "file string, row long, cells array<struct<col:int,kind:string,value:string>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """Text of all runs, without phonetic hints."""
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t") if not any(_local(x.tag) == "rPh" for x in node) else "".join(
        t.text or "" for x in node if _local(x.tag) != "rPh" for t in x.iter() if _local(t.tag) == "t")


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """(path of the first sheet, whether days count from 1904)."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(x for x in root.iter() if _local(x.tag) == "sheet")
    rid = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    late = any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in root.iter())
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == rid)
    return (target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")), late


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")) for x in root.iter() if _local(x.tag) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", x.get("formatCode", "").lower()))}
    cells = next((x for x in root if _local(x.tag) == "cellXfs"), [])
    return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def cells_of(content: bytes) -> Iterator[tuple[int, list[tuple[int, str, str]]]]:
    """(row number, [(column, kind, value)]) of the first sheet; kinds are n, s, b, d and e. Empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, late = _first_sheet(book)
        dates, epoch, strings = _date_styles(book), EPOCH_1904 if late else EPOCH, []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, x in ElementTree.iterparse(f):
                    if _local(x.tag) == "si":
                        strings.append(_text(x))
                        x.clear()
        with book.open(path) as f:
            at = 0
            for _, x in ElementTree.iterparse(f):
                if _local(x.tag) != "row":
                    continue
                at = int(x.get("r", at + 1))
                out, col = [], -1
                for c in x:
                    col = _column(c.get("r")) if c.get("r") else col + 1
                    kind, value = c.get("t", "n"), next((v.text for v in c if _local(v.tag) == "v"), None)
                    if kind == "inlineStr":
                        kind, value = "s", next((_text(v) for v in c if _local(v.tag) == "is"), None)
                    elif kind == "s":
                        value = strings[int(value)] if value is not None else None
                    elif kind == "str":
                        kind = "s"
                    elif kind == "n" and value is not None and int(c.get("s", 0)) in dates:
                        kind, value = "d", (epoch + dt.timedelta(microseconds=round(float(value) * 86_400_000_000))).isoformat(sep=" ")
                    elif kind == "d" and value is not None:
                        value = value.replace("T", " ").rstrip("Z")
                    if value not in (None, ""):
                        out.append((col, kind, value))
                x.clear()
                yield at, out


def sheet_cells(books: DataFrame) -> DataFrame:
    """(file, row, cells) of the first sheets of (path, content) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.struct([("col", pa.int32()), ("kind", pa.string()), ("value", pa.string())])))])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for at, cells in cells_of(content.as_py()):
                    rows.append({"file": path, "row": at, "cells": [dict(zip(("col", "kind", "value"), c)) for c in cells]})
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return books.select("path", "content").mapInArrow(run, CELLS)


def table_of(books: DataFrame) -> DataFrame:
    """One table from the first sheets of workbooks with the same header. The first row with cells names the columns;
    a column is long, double, timestamp or boolean if all its cells are, else string. Error cells are null, empty rows
    are left out; files without rows are skipped; differing headers are an error."""
    cells = sheet_cells(books).where(F.size("cells") > 0).persist()
    first = cells.groupBy("file").agg(F.min("row").alias("row"))  # one row per file
    heads = cells.join(F.broadcast(first), ["file", "row"]).select(F.transform("cells", lambda c: F.struct(c["col"].alias("col"), c["value"].alias("value"))).alias("h")).distinct().limit(2).collect()
    if not heads:
        raise UnusableTable("table is empty", {"rows": 0}, ["provide a sheet with a header and rows"])
    if len(heads) > 1:
        raise UnusableTable("workbooks have different headers", {"headers": len(heads)}, ["read them one by one"])
    names = {c["col"]: c["value"] for c in heads[0]["h"]}
    rows = cells.join(F.broadcast(first.withColumnRenamed("row", "head")), "file").where("row > head")
    flat = rows.select(F.inline("cells")).where("kind <> 'e'")
    kinds = {r["col"]: r for r in flat.groupBy("col").agg(F.collect_set("kind").alias("k"), F.bool_and(F.col("value").rlike(r"^-?[0-9]{1,18}$")).alias("whole")).collect()}  # one row per column
    in_column = lambda col: lambda c: (c["col"] == col) & (c["kind"] != "e")
    out = []
    for col in sorted({*names, *kinds}):
        found = kinds[col]["k"] if col in kinds else []
        kind = {"n": "bigint" if col in kinds and kinds[col]["whole"] else "double", "d": "timestamp", "b": "boolean"}.get(found[0], "string") if len(found) == 1 else "string"
        cell = F.get(F.filter("cells", in_column(col)), F.lit(0))["value"]
        out.append((F.when(cell == "1", True).when(cell == "0", False) if kind == "boolean" else cell.cast(kind)).alias(names.get(col, f"_c{col}")))
    return clean_header(rows.select(*out))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of the workbooks under `path` as one table."""
    return table_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def write_workbook(header: list[str], rows: list[list]) -> bytes:
    """A workbook with one sheet; numbers, texts, booleans and times keep their types."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime | dt.date):
            at = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            return f'<c s="1"><v>{(at - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(v, int | float):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [header, *rows]) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()

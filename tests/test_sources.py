"""Workbooks and mixed encodings."""

import datetime as dt
import io
import zipfile

import pytest

from tabulens.sources import files, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def foreign(sheet: str, late: bool = False) -> bytes:
    """A workbook as office programs write them: shared strings, styles, the first sheet not called sheet1."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><workbookPr date1904="{int(late)}"/><sheets><sheet name="B" sheetId="7" r:id="x9"/><sheet name="A" sheetId="1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x9" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r></si><si><t>漢字</t><rPh sb="0" eb="2"><t>かんじ</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet/>")
        z.writestr("xl/worksheets/other.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_cells():
    sheet = ('<row r="2"><c r="B2" t="s"><v>0</v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c><c r="C5" s="1"><v>45000.5</v></c><c r="AA5" s="2"><v>3</v></c></row>'
             '<row><c t="s"><v>2</v></c><c t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c><c/><c t="str"><v>made</v></c></row>')
    assert list(workbook.cells_of(foreign(sheet))) == [
        (2, [(1, "s", "name")]), (5, [(0, "s", "rich text"), (2, "d", "2023-03-15 12:00:00"), (26, "n", "3")]), (6, [(0, "s", "漢字"), (1, "b", "1"), (2, "e", "#DIV/0!"), (4, "s", "made")])]
    assert list(workbook.cells_of(foreign('<row><c s="3"><v>0</v></c></row>', late=True))) == [(1, [(0, "d", "1904-01-01 00:00:00")])]


def test_workbooks_as_a_table(spark, tmp_path):
    when = dt.datetime(2024, 5, 6, 7, 8)
    (tmp_path / "a.xlsx").write_bytes(workbook.write_workbook(["id", "x", "ok", "when", "t", "mixed"], [[1, 1.5, True, when, "a<b", 7], [2, None, False, when, " ", "late text"], [None] * 6]))
    (tmp_path / "b.xlsx").write_bytes(workbook.write_workbook(["id", "x", "ok", "when", "t", "mixed"], [[3, 2.0, None, None, "é", None]]))
    d = files.read_table(spark, f"{tmp_path}/*.xlsx")
    assert dict(d.dtypes) == {"id": "bigint", "x": "double", "ok": "boolean", "when": "timestamp", "t": "string", "mixed": "string"}
    assert sorted(tuple(r) for r in d.collect()) == [(1, 1.5, True, when, "a<b", "7"), (2, None, False, when, " ", "late text"), (3, 2.0, None, None, "é", None)]
    (tmp_path / "c.xlsx").write_bytes(workbook.write_workbook(["other"], [[1]]))
    with pytest.raises(files.UnusableTable):
        workbook.read_workbooks(spark, f"{tmp_path}/*.xlsx")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.xlsx").write_bytes(workbook.write_workbook([], []))
    with pytest.raises(files.UnusableTable):
        workbook.read_workbooks(spark, f"{tmp_path}/d")


def test_charsets_leave_no_setting(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,v\nشكوى,1\n".encode("windows-1256"))
    (tmp_path / "b.csv").write_bytes("name,v\nشكوى,2\n".encode())
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    got = files.read_mixed_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    assert sorted(tuple(r) for r in got.collect()) == [("شكوى", 1), ("شكوى", 2)]

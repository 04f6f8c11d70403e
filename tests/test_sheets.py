"""Workbooks: what is written is read back, and hand-made parts with every kind of cell."""

import datetime as dt
import io
import zipfile

import pytest

from crosspanel.sources import sheets
from crosspanel.sources.tables import read_jumps, read_passages, restrict

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheet, strings="", styles="", properties="", second=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}>{properties}<sheets><sheet name="one" sheetId="1" r:id="a"/><sheet name="two &amp; more" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {MAIN}><sheetData>{second}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
    return out.getvalue()


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="&quot;day&quot; yyyy\\-mm"/><numFmt numFmtId="171" formatCode="[Red]0.0&quot; ms&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs>'


def test_cells_of_every_kind():
    cells = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2"><v>41.50</v></c><c r="E2"><v>7</v></c><c r="F2" s="1"><v>43831</v></c><c r="G2" s="4"><v>43831.75</v></c></row>'
        '<row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" t="str"><f>A1</f><v> kept </v></c><c r="D4" s="3"><v>3.25</v></c><c r="E4" s="2"><v>1</v></c><c r="AB4" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row>'
        "<row><c><v>1e-7</v></c><c/><c><v>12345678901234567890</v></c></row>"
    )
    strings = "<si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>"
    got = list(sheets.rows_of(book(cells, strings, STYLES)))
    assert got[0] == [] and got[1] == ["plain", None, "rich", "41.5", "7", "2020-01-01", "2020-01-01 18:00:00"] and got[2] == []
    assert got[3] == ["true", None, " kept ", "3.25", "1899-12-31", *[None] * 22, "inline"]
    assert got[4] == ["1e-07", None, "1.2345678901234567e+19"]
    late = book('<row r="1"><c r="A1" s="1"><v>0</v></c></row>', styles=STYLES, properties='<workbookPr date1904="1"/>')
    assert list(sheets.rows_of(late)) == [["1904-01-01"]]
    assert list(sheets.rows_of(book("", second='<row r="1"><c r="A1"><v>5</v></c></row>'), "two & more")) == [["5"]] and list(sheets.rows_of(book(""), 1)) == []
    for bad in ("none", 2):
        with pytest.raises(ValueError, match="no sheet"):
            list(sheets.rows_of(book(""), bad))
    with pytest.raises(ValueError, match="document type"):
        list(sheets.rows_of(_declared()))
    assert sheets.header_of([" a ", None, "a", ""]) == ["a", "column_2", "a_3", "column_4"]


def _declared():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<!DOCTYPE x [<!ENTITY a "b">]><workbook/>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships/>")
    return out.getvalue()


def test_sheet_round_trip(spark, tmp_path):
    rows = [(i, f"tëxt <&> \"{i}\"\n\r\x01 ", i / 3, i % 2 == 0, dt.date(1899, 12, 31) + dt.timedelta(97 * i), dt.datetime(2001, 2, 3, 4, 5, i % 60), None) for i in range(9000)]
    df = spark.createDataFrame(rows, "n long, t string, x double, b boolean, d date, at timestamp, gone string").repartition(3)
    path = f"{tmp_path}/table.xlsx"
    sheets.write_sheet(df, path, 'a "sheet" & more', ["n"])
    sheets.write_sheet(df, path, 'a "sheet" & more', ["n"])  # over the old one
    back = sheets.read_sheet(spark, path, 'a "sheet" & more')
    assert back.columns == df.columns and back.count() == 9000
    got = back.selectExpr("cast(n as long) n", "t", "cast(x as double) x", "cast(b as boolean) b", "cast(d as date) d", "cast(at as timestamp) at", "gone").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(n, t.replace("\x01", ""), *rest) for n, t, *rest in rows]
    assert sheets.read_sheet(spark, path, 0, ["d", "n"]).columns == ["d", "n"]
    with pytest.raises(ValueError, match="no columns"):
        sheets.read_sheet(spark, path, 0, ["nothing"])
    with pytest.raises(Exception):
        sheets.read_sheet(spark, f"{tmp_path}/none.xlsx")


def test_workbooks_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.xlsx").write_bytes(sheets.workbook([" date ", "description", "clarity"], iter([(dt.date(2020, 1, 1 + k), f"d{k}", 1.5 * k), (None, None, None), ("never", "x", "y")])))
    assert sorted(tuple(r) for r in read_jumps(spark, f"{tmp_path}/*.xlsx").filter("date is not null").collect()) == [(dt.date(2020, 1, 1 + k), f"d{k}", 1.5 * k) for k in range(3)]
    assert read_passages(spark, f"{tmp_path}/*.xlsx").filter("date is null").count() == 3
    (tmp_path / "part9.xlsx").write_bytes(sheets.workbook(["other"], iter([(1,)])))
    with pytest.raises(Exception, match="other headers"):
        read_jumps(spark, f"{tmp_path}/*.xlsx").collect()


def test_restriction_prefers_the_exact_name(spark):
    day = dt.date(2020, 1, 1)
    ic = spark.createDataFrame([("Alpha", day, 1.0), ("ALPHA", day, 2.0), ("beta", day, 3.0)], "alpha_id string, date date, ic double")
    take = lambda *ids: sorted(r["alpha_id"] for r in restrict(ic, spark.createDataFrame([(i,) for i in ids], "alpha_id string")).collect())
    assert take("ALPHA") == ["ALPHA"] and take("alpha") == ["ALPHA", "Alpha"] and take("Beta", "Alpha") == ["Alpha", "beta"]
    with pytest.raises(ValueError, match="gamma"):
        take("gamma", "beta")

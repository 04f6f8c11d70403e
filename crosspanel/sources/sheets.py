"""Spreadsheets: workbooks of zipped XML, read by Spark's own file reader so that any store will do, and small tables written as one.

A workbook is one record, a sheet at most 1,048,576 rows: it is parsed by one task, row by row, and workbooks by many. Cells
come as text: numbers without a needless fraction, dates as ISO dates by the cell's format, truth values as true and false, and
errors and empty cells as missing. Types are the caller's, by casts that miss rather than fail.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: the most rows of a sheet, date formats by number, the days from which dates count.
MOST_ROWS = 1_048_576
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
FIRST_DAY, FIRST_DAY_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
_BATCH = 4096


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _tree(book: zipfile.ZipFile, path: str) -> ET.Element | None:
    if path not in book.namelist():
        return None
    data = book.read(path)
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError(f"{path} declares a document type")
    return ET.fromstring(data)


def _text(element: ET.Element) -> str:
    """Text of a string item: its runs, without phonetic hints."""
    return "".join(t.text or "" for part in element for t in ([part] if _name(part) == "t" else [x for x in part if _name(x) == "t"] if _name(part) == "r" else []))


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date."""
    styles = _tree(book, "xl/styles.xml")
    if styles is None:
        return []
    codes = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in styles.iter() if _name(e) == "numFmt"}
    cells = next((e for e in styles if _name(e) == "cellXfs"), ())
    shown = lambda code: bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.lower())))
    return [int(x.get("numFmtId", 0)) in DATE_FORMATS or shown(codes.get(int(x.get("numFmtId", 0)), "")) for x in cells]


def _sheets(book: zipfile.ZipFile) -> tuple[dict[str, str], dt.datetime]:
    """The path of each sheet by its name, in the workbook's order, and the day from which dates count."""
    top, links = _tree(book, "xl/workbook.xml"), _tree(book, "xl/_rels/workbook.xml.rels")
    if top is None or links is None:
        raise ValueError("not a workbook")
    targets = {e.get("Id"): e.get("Target", "") for e in links}
    found = {}
    for e in top.iter():
        if _name(e) == "sheet":
            target = targets[next(v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id" and k != "id")]
            found[e.get("name", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    late = any(_name(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in top)
    return found, FIRST_DAY_1904 if late else FIRST_DAY


def _number(raw: str, dated: bool, first: dt.datetime) -> str:
    value = float(raw)
    if not dated:
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    moment = first + dt.timedelta(days=int(value), milliseconds=round((value - int(value)) * 86_400_000))
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(" ", "milliseconds" if moment.microsecond else "seconds")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def rows_of(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """Rows of a sheet (by name or place) from the first, each as long as its last cell; rows that aren't there are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        paths, first = _sheets(book)
        if isinstance(sheet, str) and sheet not in paths or isinstance(sheet, int) and sheet >= len(paths):
            raise ValueError(f"no sheet {sheet!r} among {list(paths)}")
        strings = _tree(book, "xl/sharedStrings.xml")
        shared = [] if strings is None else [_text(e) for e in strings if _name(e) == "si"]
        dated = _dated(book)
        at = 0
        with book.open(paths[sheet] if isinstance(sheet, str) else list(paths.values())[sheet]) as f:
            if b"<!DOCTYPE" in f.peek(4096)[:4096]:
                raise ValueError("the sheet declares a document type")
            for _, element in ET.iterparse(f):
                if _name(element) != "row":
                    continue
                number = int(element.get("r", at + 1))
                yield from ([] for _ in range(at + 1, number))
                at = number
                row: list[str | None] = []
                for cell in element:
                    place = _column(cell.get("r", "")) if cell.get("r") else len(row)
                    row += [None] * (place - len(row))
                    kind, parts = cell.get("t", "n"), {_name(p): p for p in cell}
                    raw = parts["v"].text if "v" in parts else None
                    if kind == "inlineStr":
                        row.append(_text(parts["is"]) if "is" in parts else None)
                    elif raw is None or kind == "e":
                        row.append(None)
                    elif kind == "s":
                        row.append(shared[int(raw)])
                    elif kind == "b":
                        row.append("true" if raw.strip() == "1" else "false")
                    elif kind in ("str", "d"):
                        row.append(raw)
                    else:
                        style = int(cell.get("s", 0))
                        row.append(_number(raw, style < len(dated) and dated[style], first))
                element.clear()
                yield row


def header_of(row: list[str | None]) -> list[str]:
    """Column names: outer white space goes, empty ones are named by place, repeated ones numbered."""
    names: list[str] = []
    for i, cell in enumerate(row):
        name = (cell or "").strip() or f"column_{i + 1}"
        names.append(name if name not in names else f"{name}_{i + 1}")
    return names


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, columns: list[str] | None = None) -> DataFrame:
    """A sheet's rows below its header as text columns; all of ``path``'s workbooks must have the same header.

    ``columns`` keeps some of them. Rows without any value are left out. The header of one workbook is read when this is called.
    """
    books = spark.read.format("binaryFile").load(path).select("content")
    head = books.limit(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"h": [header_of(next(rows_of(r["content"], sheet), []))]}) for b in batches for r in b.to_pylist()), "h array<string>").first()
    if head is None:
        raise ValueError(f"no workbook in {path}")
    names = head["h"]
    wanted = names if columns is None else columns
    if lacking := [c for c in wanted if c not in names]:
        raise ValueError(f"no columns {lacking} among {names}")
    places = [names.index(c) for c in wanted]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = rows_of(content.as_py(), sheet)
                if header_of(next(rows, [])) != names:
                    raise ValueError(f"workbooks of {path} have other headers than {names}")
                held: list[list[str | None]] = []
                for row in rows:
                    if any(c is not None for c in row):
                        held.append([row[p] if p < len(row) else None for p in places])
                    if len(held) == _BATCH:
                        yield _batch(held, wanted)
                        held = []
                if held:
                    yield _batch(held, wanted)

    return books.mapInArrow(parse, T.StructType([T.StructField(c, T.StringType()) for c in wanted]))


def _batch(rows: list[list[str | None]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


# The parts of a workbook with one sheet; the second cell style shows a date, the third a date and a time.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _letters(i: int) -> str:
    return ("" if i < 26 else _letters(i // 26 - 1)) + chr(65 + i % 26)


def _cell(value: object, ref: str) -> str:
    if value is None or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if isinstance(value, dt.datetime):
        return f'<c r="{ref}" s="2"><v>{(value - FIRST_DAY) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, dt.date):
        return f'<c r="{ref}" s="1"><v>{(dt.datetime(value.year, value.month, value.day) - FIRST_DAY).days}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'


def workbook(names: list[str], rows: Iterator[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook with one sheet of a header and rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for path, text in _PARTS.items():
            book.writestr(path, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook {_MAIN}><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet {_MAIN}><sheetData>'.encode())
            for n, row in enumerate([tuple(names), *rows] if isinstance(rows, list) else _chained(tuple(names), rows), 1):
                f.write(f'<row r="{n}">{"".join(_cell(v, f"{_letters(i)}{n}") for i, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def write_sheet(rows: DataFrame, path: str, sheet: str = "Sheet1", order: list[str] | None = None) -> None:
    """A results table as a workbook with one sheet, in ``order``. It passes the driver: tables beyond a sheet's rows are refused.

    Control characters that XML has no place for are left out of texts; arrays and structs must be joined to text before.
    """
    if (n := rows.count()) >= MOST_ROWS:
        raise ValueError(f"{n} rows: a sheet has at most {MOST_ROWS - 1} below its header")
    data = workbook(rows.columns, (tuple(r) for r in (rows.orderBy(*order) if order else rows).toLocalIterator()), sheet)
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} can't be written")

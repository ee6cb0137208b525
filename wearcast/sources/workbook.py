"""S3: the activity workbook itself (.xlsx), many files at a time.

Files come as ``(path, content)`` rows of Spark's binary-file source, so any
store that Spark reads will do and each file is parsed in one task; Spark bounds
the bytes of a batch.  A workbook is a zip of XML parts: the sheet's rows are
streamed, and only the columns asked for are kept.  Rows leave in batches, so a
task holds one file's bytes, its shared strings and one batch.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators.cleaning import drop_empty_rows
from wearcast.sources.files import typed_sheet

SHEET = "Activity Log2"
LAST_COLUMN = "Y"
COLUMNS = (*S.WORKBOOK_RENAMES, *[c for c in S.WORKBOOK_DROPS if c not in S.WORKBOOK_RENAMES.values()])
BATCH_ROWS = 10_000
#: number formats that stand for dates and times, of the fixed ones
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def column_number(letters: str) -> int:
    """'A' is 1, 'Y' 25, 'AA' 27."""
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _children(parent: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in parent if _tag(e) == name]


def _text(element: ElementTree.Element) -> str:
    """Text of a string item: its own and its runs', without phonetic hints."""
    return "".join((t.text or "") for e in element for t in ([e] if _tag(e) == "t" else _children(e, "t") if _tag(e) == "r" else []))


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles whose numbers are dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _tag(e) == "numFmt"}
    plain = {i: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code) for i, code in own.items()}
    dates = DATE_FORMATS | {i for i, code in plain.items() if re.search("[ymdhs]", code, re.I)}
    cells = [e for part in root if _tag(part) == "cellXfs" for e in part]
    return {i for i, e in enumerate(cells) if int(e.get("numFmtId", 0)) in dates}


def _sheet_part(book: zipfile.ZipFile, sheet: str) -> tuple[str, bool]:
    """The part that holds the named sheet, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    ids = {e.get("name"): next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in root.iter() if _tag(e) == "sheet"}
    if sheet not in ids:
        raise ValueError(f"no sheet {sheet!r}; there are {sorted(ids)}")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in links if e.get("Id") == ids[sheet])
    late = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"), late


def _value(cell: ElementTree.Element, strings: list[str], dates: set[int], late: bool) -> str | None:
    """A cell as text: TRUE/FALSE, ISO date and time, else as stored; an empty
    cell or an error is None."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(e) for e in _children(cell, "is")) or None
    held = next((e.text for e in _children(cell, "v")), None)
    if held is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(held)] or None
    if kind == "b":
        return "TRUE" if held == "1" else "FALSE"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        day = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
        return str(day + dt.timedelta(seconds=round(float(held) * 86400)))
    return held


def sheet_rows(content: bytes, sheet: str, columns: Sequence[str], last_column: str = LAST_COLUMN) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(row number, values by header) of a sheet's rows after its first one,
    which holds the headers; only ``columns`` up to ``last_column``."""
    last, wanted = column_number(last_column), set(columns)
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, late = _sheet_part(book, sheet)
        strings, dates = _shared_strings(book), _date_styles(book)
        names: dict[int, str] | None = None
        number = 0
        with book.open(part) as f:
            for _, e in ElementTree.iterparse(f):
                if _tag(e) != "row":
                    continue
                number = int(e.get("r", number + 1))
                values, at = {}, 0
                for c in _children(e, "c"):
                    ref = re.match("[A-Z]+", c.get("r", ""))
                    at = column_number(ref[0]) if ref else at + 1
                    if at <= last and (names is None or at in names):
                        values[at] = _value(c, strings, dates, late)
                e.clear()
                if names is None:
                    names = {at: v for at, v in values.items() if v in wanted}
                else:
                    yield number, {name: values.get(at) for at, name in names.items()}


def parse_workbooks(files: DataFrame, sheet: str = SHEET, columns: Sequence[str] = COLUMNS, last_column: str = LAST_COLUMN) -> DataFrame:
    """``(file, row, <columns> string)`` of every row of the sheet in every
    workbook of ``files(path, content)``; a header that a file lacks is NULL.
    A file that is no workbook or has no such sheet fails."""
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                held: list[tuple[int, dict]] = []
                name = path.as_py()
                try:
                    for row in sheet_rows(content.as_py(), sheet, columns, last_column):
                        held.append(row)
                        if len(held) == BATCH_ROWS:
                            yield table(name, held)
                            held = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    raise ValueError(f"{name}: {e}") from e
                if held:
                    yield table(name, held)

    def table(name: str, held: list[tuple[int, dict]]) -> pa.RecordBatch:
        values = [pa.array([r.get(c) for _, r in held], pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([n for n, _ in held], pa.int64()), *values], names=["_file", "_row", *columns])

    ddl = ", ".join(["_file string", "_row bigint", *[f"`{c}` string" for c in columns]])
    return files.select("path", "content").mapInArrow(run, ddl)


def read_workbooks(
    spark: SparkSession, path: str, sheet: str = SHEET, columns: Sequence[str] = COLUMNS, last_column: str = LAST_COLUMN, glob: str = "*.xlsx"
) -> DataFrame:
    """S3: the activity log of every workbook at ``path`` (a file or a folder
    at any depth): fully empty rows dropped, headers renamed, Yes/No parsed,
    numbers typed, as ``read_workbook_export`` gives them.  A file of no bytes
    has no rows (Spark's file sources leave it out)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return activity_log(parse_workbooks(files, sheet, columns, last_column))


def activity_log(rows: DataFrame) -> DataFrame:
    """Parsed rows in the activity log's columns and types."""
    return typed_sheet(drop_empty_rows(rows.drop("_file", "_row")))


# -- the other way --------------------------------------------------------------
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook_bytes(columns: Sequence[str], rows: Sequence[Sequence], sheet: str = SHEET) -> bytes:
    """A workbook of one sheet: headers, then the rows.  Numbers and booleans
    are stored as such, everything else as text; None leaves a cell out."""
    def cell(at: int, row: int, v) -> str:
        ref = f'r="{_letters(at)}{row}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {ref} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {ref}><v>{v!r}</v></c>"
        return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        book.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {_MAIN}><sheetData>".encode())
            for i, row in enumerate([columns, *rows], 1):
                f.write(f'<row r="{i}">{"".join(cell(at, i, v) for at, v in enumerate(row, 1))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def pack_workbooks(df: DataFrame, sheet: str = SHEET, rows_per_file: int = 100_000) -> DataFrame:
    """``df`` as workbooks: ``(path, content)`` rows of at most
    ``rows_per_file`` rows each, columns as headers."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            content = workbook_bytes(columns, held, sheet)
            return pa.RecordBatch.from_arrays([pa.array(["packed.xlsx"]), pa.array([content], pa.binary())], names=["path", "content"])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                held.append(row)
                if len(held) == rows_per_file:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return df.mapInArrow(run, "path string, content binary")

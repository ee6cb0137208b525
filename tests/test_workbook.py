"""The workbook source: cells of every kind, several files, awkward ones."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from wearcast.sources import workbook as WB

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _book(rows, strings=(), formats=(), styles=(), sheet="Activity Log2", before="", late=False, target="worksheets/other.xml"):
    """A workbook whose wanted sheet is the second one, in a part of its own."""
    parts = {
        "xl/workbook.xml": f'<workbook {WB._MAIN} xmlns:r="{REL}">{"<workbookPr date1904=%s1%s/>" % (chr(34), chr(34)) if late else ""}<sheets><sheet name="Notes" sheetId="1" r:id="rId7"/><sheet name="{sheet}" sheetId="2" r:id="rId9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="x"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="{target}"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {WB._MAIN}><sheetData/></worksheet>",
        "xl/worksheets/other.xml": f"<worksheet {WB._MAIN}>{before}<sheetData>{rows}</sheetData></worksheet>",
    }
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {WB._MAIN}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>"
    if styles:
        own = "".join(f'<numFmt numFmtId="{i}" formatCode="{c}"/>' for i, c in formats)
        parts["xl/styles.xml"] = f'<styleSheet {WB._MAIN}><numFmts>{own}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>{"".join(f"<xf numFmtId=%s{i}%s/>" % (chr(34), chr(34)) for i in styles)}</cellXfs></styleSheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _rows(content, columns, **kw):
    return list(WB.sheet_rows(content, "Activity Log2", columns, **kw))


def test_cells_of_every_kind():
    strings = ["<t>Date</t>", "<t>Light</t>", "<r><t>Wi</t></r><r><rPr/><t>nd</t></r><rPh><t>hint</t></rPh>", "<t>Yes</t>", "<t></t>"]
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="inlineStr"><is><t>Temp</t></is></c><c r="E1" t="str"><f>1</f><v>Humidity</v></c><c r="Z1" t="inlineStr"><is><t>Notes</t></is></c></row>'
        '<row r="2"><c r="A2" s="1"><v>45292.5</v></c><c r="B2" t="s"><v>3</v></c><c r="C2"><v>7</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="Z2"><v>1</v></c></row>'
        '<row r="5"><c r="A5" s="2"><v>45292</v></c><c r="B5" t="s"><v>4</v></c><c r="D5" t="b"><v>0</v></c></row>'
        '<row><c s="3"><v>45292</v></c><c><v>1.5E3</v></c></row>'
    )
    book = _book(rows, strings, [(170, 'yyyy\\-mm'), (171, '&quot;day&quot; 0.0 [Red]')], [0, 14, 170, 171])
    got = _rows(book, ["Date", "Light", "Wind", "Temp", "Humidity", "Notes"])
    assert got == [
        (2, {"Date": "2024-01-01 12:00:00", "Light": "Yes", "Wind": "7", "Temp": "TRUE", "Humidity": None}),
        (5, {"Date": "2024-01-01 00:00:00", "Light": None, "Wind": None, "Temp": "FALSE", "Humidity": None}),
        (6, {"Date": "45292", "Light": "1.5E3", "Wind": None, "Temp": None, "Humidity": None}),
    ]
    assert [sorted(r) for _, r in _rows(book, ["Notes", "Wind"])] == [["Wind"]] * 3
    assert _rows(book, ["Notes"], last_column="Z")[0] == (2, {"Notes": "1"})


def test_dates_from_1904_and_absolute_parts():
    rows = '<row r="1"><c t="inlineStr"><is><t>Date</t></is></c></row><row r="2"><c s="0"><v>0.25</v></c></row>'
    book = _book(rows, styles=[14], late=True, target="/xl/worksheets/other.xml")
    assert _rows(book, ["Date"]) == [(2, {"Date": str(dt.datetime(1904, 1, 1, 6))})]
    assert _rows(_book(""), ["Date"]) == []


def test_round_trip_of_awkward_text():
    rows = [("a<b>&\"'", 1.5, True, None), (" two  spaces ", -3, False, "é😀\nline"), (None, None, None, None)]
    back = list(WB.sheet_rows(WB.workbook_bytes(["t", "n", "b", "u"], rows, "S & \"x\""), "S & \"x\"", ["t", "n", "b", "u"]))
    assert [r for _, r in back] == [
        {"t": "a<b>&\"'", "n": "1.5", "b": "TRUE", "u": None}, {"t": " two  spaces ", "n": "-3", "b": "FALSE", "u": "é😀\nline"}, dict.fromkeys("tnbu")]
    assert [WB.column_number(WB._letters(n)) for n in (1, 26, 27, 52, 703)] == [1, 26, 27, 52, 703]


def test_folder_of_files(spark, tmp_path):
    """Files of different layouts; other files in the folder are left alone."""
    one = ["Date", "Activity", "Temp", "Feels like", "Light", "Gloves", "Outer Layer"]
    (tmp_path / "a.xlsx").write_bytes(WB.workbook_bytes(one, [["2024-01-01", "Run", 41.5, 39, "y", "No", "None"], [None] * 7, ["2024-01-02", "Run", "n/a", 39, "N", "Yes", "Vest"]]))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.xlsx").write_bytes(WB.workbook_bytes(["Gloves", "Feels like", "Mine"], [["n", 70, "x"]]))
    (tmp_path / "notes.txt").write_text("no workbook")
    out = WB.read_workbooks(spark, str(tmp_path))
    rows = sorted((str(r["temp_f"]), r["feels_like"], r["is_light"], r["gloves"], r["outer_layer"], r["activity"]) for r in out.collect())
    assert rows == [("41.5", 39.0, True, False, "None", "Run"), ("None", 39.0, False, True, "Vest", "Run"), ("None", 70.0, None, False, None, None)]
    assert "Mine" not in out.columns and "Notes" not in out.columns
    raw = WB.parse_workbooks(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(str(tmp_path)), columns=["Gloves"])
    assert sorted((r["_file"].rsplit("/", 1)[-1], r["_row"], r["Gloves"]) for r in raw.collect()) == [("a.xlsx", 2, "No"), ("a.xlsx", 3, None), ("a.xlsx", 4, "Yes"), ("b.xlsx", 2, "n")]


@pytest.mark.parametrize("content, said", [(b"no zip", "zip"), (WB.workbook_bytes(["a"], [], "Other"), "no sheet")])
def test_unreadable_files_fail_by_name(spark, tmp_path, content, said):
    (tmp_path / "bad.xlsx").write_bytes(content)
    with pytest.raises(Exception, match="bad.xlsx.*" + said):
        WB.read_workbooks(spark, str(tmp_path)).collect()


def test_many_rows_in_batches(spark, monkeypatch):
    df = spark.range(2500).select(F.col("id").cast("string").alias("Date"), (F.col("id") % 7).alias("Temp"))
    files = WB.pack_workbooks(df.coalesce(1), rows_per_file=1000)
    assert files.count() == 3
    monkeypatch.setattr(WB, "BATCH_ROWS", 100)
    back = WB.parse_workbooks(files, columns=["Temp", "Date"])
    assert back.count() == 2500 and back.select(F.sum("Date"), F.sum("Temp")).first() == df.select(F.sum("Date"), F.sum("Temp")).first()

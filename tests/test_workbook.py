import os
import tempfile
import zipfile
from datetime import date, datetime

import pytest

from panelspark.sources.io import load_responses
from panelspark.sources.workbook import read_workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, strings=(), formats=(), book=""):
    """A workbook of the given sheet rows (XML), shared strings (XML of an item) and custom formats."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        listed = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}">{book}<sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="{REL}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(names)))
        rels += f'<Relationship Id="x" Type="{REL}/sharedStrings" Target="/xl/sharedStrings.xml"/><Relationship Id="y" Type="{REL}/styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        custom = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{f}"/>' for i, f in enumerate(formats))
        xfs = '<xf numFmtId="0"/><xf numFmtId="14"/>' + "".join(f'<xf numFmtId="{164 + i}"/>' for i in range(len(formats)))
        z.writestr("xl/styles.xml", f"<styleSheet {MAIN}><numFmts>{custom}</numFmts><cellStyleXfs><xf numFmtId=\"22\"/></cellStyleXfs><cellXfs>{xfs}</cellXfs></styleSheet>")
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{sheets[n]}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def folder():
    out = tempfile.mkdtemp(prefix="panelspark-test-")
    strings = ["<t>Age Group</t>", "<r><t>Sco</t></r><r><t>re</t></r><rPh><t>no</t></rPh>", "<t>18-24</t>", "<t>When</t>", "<t xml:space=\"preserve\"> a_x000D_b </t>", "<t>Ok</t>"]
    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>3</v></c><c r="D2" t="s"><v>5</v></c></row>'
    body = ('<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>4</v></c><c r="C3" s="1"><v>45000</v></c><c r="D3" t="b"><v>1</v></c></row>'
            '<row r="4"><c r="A4" s="0"/></row>'
            '<row r="6"><c r="C6" s="2"><v>45000.75</v></c><c r="B6" t="e"><v>#N/A</v></c><c r="D6" t="b"><v>0</v></c></row>'
            '<row><c t="s"><v>4</v></c><c t="inlineStr"><is><t>many</t></is></c><c s="3"><v>2.5</v></c><c t="str"><v>TRUE</v></c></row>')
    workbook(f"{out}/one.xlsx", {"Answers": head + body, "Other": '<row><c><v>1</v></c></row>'}, strings,
             ["yyyy\\-mm\\-dd hh:mm", "0.00&quot;days&quot;[Red]"])
    # the same columns in another order, one missing, the other calendar
    workbook(f"{out}/two.xlsx", {"S": '<row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>Age Group</t></is></c></row>'
                                      '<row><c s="1"><v>0</v></c><c><v>0.1</v></c></row>'}, ["<t>When</t>"], book='<workbookPr date1904="1"/>')
    return out


DDL = "`Age Group` string, Score int, When timestamp, Ok boolean"


def test_reads_types_gaps_and_styles(spark, folder):
    got = read_workbooks(spark, f"{folder}/one.xlsx", DDL, row_column="n").orderBy("n").collect()
    assert [tuple(r) for r in got] == [
        ("18-24", 4, datetime(2023, 3, 15), True, 3),
        (None, None, datetime(2023, 3, 15, 18), False, 6),
        (" a\rb ", None, datetime(1900, 1, 2, 12), True, 7)]


def test_strings_by_header_without_a_schema(spark, folder):
    got = read_workbooks(spark, f"{folder}/one.xlsx")
    assert got.columns == ["Age Group", "Score", "When", "Ok"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("18-24", "4", "2023-03-15", "true"), (None, None, "2023-03-15 18:00:00", "false"), (" a\rb ", "many", "2.5", "TRUE")], key=str)


def test_folder_finds_columns_by_name(spark, folder):
    got = read_workbooks(spark, folder, "When date, `Age Group` string, Absent double", file_column="f")
    rows = {(os.path.basename(r.f), r["Age Group"], r.When, r.Absent) for r in got.collect()}
    assert rows == {("one.xlsx", "18-24", date(2023, 3, 15), None), ("one.xlsx", None, date(2023, 3, 15), None),
                    ("one.xlsx", " a\rb ", date(1900, 1, 2), None), ("two.xlsx", "0.1", date(1904, 1, 1), None)}


def test_named_sheet_by_place_and_candidates(spark, folder):
    assert [tuple(r) for r in read_workbooks(spark, f"{folder}/one.xlsx", "a double, b string", sheet="Other", header=False).collect()] == [(1.0, None)]
    got = load_responses(spark, [f"{folder}/absent.xlsx", f"{folder}/two.xlsx"], schema="`Age Group` double, When date")
    assert [tuple(r) for r in got.collect()] == [(0.1, date(1904, 1, 1))]


def test_many_rows_and_an_empty_sheet(spark):
    out = tempfile.mkdtemp(prefix="panelspark-test-")
    rows = "".join(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{i}</v></c><c r="AB{i + 2}"><v>{i * 0.5}</v></c></row>' for i in range(10000))
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>i</t></is></c><c r="AB1" t="inlineStr"><is><t>half</t></is></c></row>'
    workbook(f"{out}/b.xlsx", {"x": head + rows})
    workbook(f"{out}/a.xlsx", {"x": ""})
    got = read_workbooks(spark, out, "half double, i long").collect()
    assert sorted((r.i, r.half) for r in got) == [(i, i * 0.5) for i in range(10000)]
    assert read_workbooks(spark, f"{out}/a.xlsx").columns == []

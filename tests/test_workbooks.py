"""Workbooks as other programs write them, damaged ones, and round trips; extractors by source."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tamarack.sources import extract, store, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, strings="", styles="", pr=""):
    """A workbook from (name, sheetData XML)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{pr}<sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="/xl/ws/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, data) in enumerate(sheets):
            z.writestr(f"xl/ws/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{data}</sheetData></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return out.getvalue()


def rows(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: list(workbooks.sheet_rows(z, p)) for n, p in workbooks.sheet_names(z)}


def test_forms_of_cells():
    strings = '<si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh></si><si><t>a_x000D_b &lt;&amp;</t></si><si/>'
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm&quot; d&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="22"/><xf numFmtId="171"/></cellXfs>'
    data = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>2</v></c><c r="E2" t="s"><v>3</v></c></row><row r="3"><c r="B3"/></row>'
        '<row r="7"><c r="A7" s="1"><v>45292</v></c><c r="B7" s="2"><v>45292.75</v></c><c r="C7" s="3"><v>1.50</v></c><c r="D7" t="b"><v>1</v></c><c r="E7" t="str"><f>A1</f><v>x_x0041_</v></c><c r="F7" t="e"><v>#N/A</v></c><c r="AA7" t="inlineStr"><is><t>in</t></is></c></row>'
        '<row><c><v>7</v></c><c s="1"><v>59</v></c><c s="1"><v>61</v></c></row>'
    )
    got = rows(book([("one", data), ("two &amp; three", "")], strings, styles))
    assert got["two & three"] == [] and got["one"][0] == (2, ["plain", None, "rich text", "a\rb <&", ""])
    assert got["one"][1] == (7, ["2024-01-01", "2024-01-01 18:00:00", "1.50", "TRUE", "xA", "#N/A", *[None] * 20, "in"])
    assert got["one"][2] == (8, ["7", "1900-02-28", "1900-03-01"])
    old = rows(book([("s", '<row><c s="1"><v>1</v></c></row>')], "", styles, '<workbookPr date1904="1"/>'))
    assert old["s"] == [(1, ["1904-01-02"])]


def test_reading_many_files(spark, tmp_path):
    files = [("a/x.xlsx", book([("s", "<row><c><v>1</v></c></row>"), ("t", "<row><c><v>2</v></c></row>")])), ("bad.xlsx", b"not a zip"), ("cut.xlsx", book([("s", "<row><c><v>1</v></c>")])), ("a/note.txt", b"x")]
    store.write_files(spark.createDataFrame(files, "name string, body binary"), str(tmp_path))
    got = workbooks.workbooks(spark, str(tmp_path)).collect()
    assert sorted((r["sheet"], r["cells"]) for r in got if not r["error"]) == [("s", ["1"]), ("t", ["2"])]
    assert sorted(r["file"] for r in got if r["error"]) == ["bad.xlsx", "cut.xlsx"]
    assert [r["sheet"] for r in workbooks.workbooks(spark, str(tmp_path / "a"), "t").collect()] == ["t"]


def test_round_trip_of_awkward_values(spark, tmp_path):
    texts = ["", "  blanks  ", "<&>\"'", "line\nline", "carriage\rreturn", "_x0041_", "tab\t\x01\x1f", "😀 漢", None]
    data = [(i, t, None if i == 3 else i / 4, datetime.date(1999, 12, 31), i % 2 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "i long, t string, x double, d date, b boolean").withColumn("book", F.lit("one book"))
    assert workbooks.write_workbooks(df, str(tmp_path), "book", "i", ["i", "t", "x", "d", "b"]) == 1
    got = workbooks.sheet_table(workbooks.workbooks(spark, str(tmp_path)), ["t", "x", "d", "b", "other"]).orderBy("row").collect()
    assert [r["t"] for r in got] == texts and [r["row"] for r in got] == list(range(2, 11))
    assert [r["x"] and float(r["x"]) for r in got] == [None if i == 3 else i / 4 for i in range(9)]
    assert {r["d"] for r in got} == {"1999-12-31"} and [r["b"] for r in got] == ["TRUE" if i % 2 == 0 else "FALSE" for i in range(9)] and {r["other"] for r in got} == {None}


def test_extractors_are_chosen_by_source(spark):
    def words(page):
        return [("word", w) for w in page.split()]

    def broken(page):
        yield ("first", page)
        raise RuntimeError("half-way")

    data = [(1, "a", "x y"), (2, "b", "z"), (3, "c", "q"), (4, None, "q"), (5, "a", None), (6, "a", "x"), (6, "a", "x")] + [(100 + i, "a", f"w{i}") for i in range(200)]
    df = spark.createDataFrame(data, "id long, source string, html string").withColumn("share", F.lit("clash"))
    got = extract.extract_by_source(df, {"a": words, "b": broken}, "id", shares=4).collect()
    few = sorted((tuple(r) for r in got if r["id"] < 100), key=str)
    assert few == sorted([(1, "a", 0, "word", "x", None), (1, "a", 1, "word", "y", None), (2, "b", None, None, None, "RuntimeError: half-way"), (3, "c", None, None, None, "no extractor"), (4, None, None, None, None, "no extractor"), (6, "a", 0, "word", "x", None), (6, "a", 0, "word", "x", None)], key=str)
    assert len(got) == 207
    assert extract.extract_by_source(df.limit(0), {}, "id").count() == 0


@pytest.mark.parametrize("i,name", [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_column_letters(i, name):
    assert workbooks._letters(i) == name and workbooks._column(f"{name}12") == i

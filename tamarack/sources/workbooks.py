"""Spreadsheets (Office Open XML): sheets read as rows of cells straight out of the zip, and tables written as workbooks."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.sources import store

#: The format's own numbers of date and time formats, and the most rows of a sheet (fixed values).
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
MOST_ROWS = 1_048_576


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _plain(text: str) -> str:
    """Escapes of characters that XML can't hold (_x000D_) undone."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _texts(element: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    out = []
    for child in element:
        name = _local(child.tag)
        if name == "t":
            out.append(child.text or "")
        elif name == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return _plain("".join(out))


def _elements(book: zipfile.ZipFile, part: str, names: set[str]) -> Iterator[ElementTree.Element]:
    """Elements of a part as they end; each is cleared after use, so a part is never a whole tree in memory."""
    if part not in book.namelist():
        return
    with book.open(part) as f:
        root = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = e
            if event == "end" and _local(e.tag) in names:
                yield e
                e.clear()
                if e is not root and _local(e.tag) in ("row", "si"):
                    root.clear()


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    own, out = set(DATE_FORMATS), set()
    if "xl/styles.xml" not in book.namelist():
        return out
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    for e in tree.iter():
        if _local(e.tag) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower()):
            own.add(int(e.get("numFmtId", -1)))
    for e in tree.iter():
        if _local(e.tag) == "cellXfs":
            out = {i for i, x in enumerate(e) if int(x.get("numFmtId", 0)) in own}
    return out


def _date(serial: float, from_1904: bool) -> str:
    """ISO text of a serial day; the 1900 system counts a day that never was after day 59."""
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30 if serial >= 60 else 31)
    at = start + datetime.timedelta(seconds=round(serial * 86400))
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(" ")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in the workbook's order."""
    targets = {}
    for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        at = e.get("Target", "")
        targets[e.get("Id")] = at[1:] if at.startswith("/") else f"xl/{at}"
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    return [(e.get("name"), targets[next(v for k, v in e.attrib.items() if _local(k) == "id")]) for e in sheets]


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells): empty cells are None, dates ISO texts, booleans TRUE or FALSE, numbers as written."""
    strings = [_texts(e) for e in _elements(book, "xl/sharedStrings.xml", {"si"})]
    dates = _date_styles(book)
    from_1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter())
    last = 0
    for row in _elements(book, part, {"row"}):
        last = int(row.get("r", last + 1))
        cells: list[str | None] = []
        for c in row:
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [None] * (at - len(cells))
            kind, parts = c.get("t", "n"), {_local(x.tag): x for x in c}
            raw = parts["v"].text if "v" in parts else None
            if kind == "inlineStr":
                value = _texts(parts["is"]) if "is" in parts else None
            elif raw is None:
                value = None
            elif kind == "s":
                value = strings[int(raw)]
            elif kind == "b":
                value = "TRUE" if raw == "1" else "FALSE"
            elif kind == "n" and int(c.get("s", 0)) in dates:
                value = _date(float(raw), from_1904)
            else:
                value = _plain(raw) if kind == "str" else raw
            cells.append(value)
        if any(v is not None for v in cells):
            yield last, cells


def workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(file, sheet, row, cells, error) of all workbooks below a path, or of their sheets with one name.

    Spark reads the files, whole, as a zip's directory is at its end; parts are unpacked and parsed as they are read. A
    file that is no workbook, or a damaged one, is a row with an error. Rows without a value are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                file, held = batch.column(0)[i].as_py(), []
                try:
                    with zipfile.ZipFile(io.BytesIO(batch.column(1)[i].as_buffer())) as book:
                        for name, part in sheet_names(book):
                            if sheet in (None, name):
                                for n, cells in sheet_rows(book, part):
                                    held.append((file, name, n, cells, None))
                                    if len(held) == 4096:
                                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
                                        held = []
                except Exception as e:  # noqa: BLE001
                    held.append((file, None, None, None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, sheet string, row long, cells array<string>, error string")


def sheet_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(file, sheet, row, *columns) as text: columns are found by the names in each sheet's first row, missing ones null."""
    heads = rows.filter("error is null").groupBy("file", "sheet").agg(F.min_by("cells", "row").alias("_names"), F.min("row").alias("_first"))
    body = rows.filter("error is null").join(heads, ["file", "sheet"]).filter(F.col("row") > F.col("_first"))
    cell = lambda c: F.when(F.array_position("_names", c) > 0, F.get("cells", (F.array_position("_names", c) - 1).cast("int")))
    return body.select("file", "sheet", "row", *(cell(c).alias(c) for c in columns))


def _cell(ref: str, value: object, shared: dict[str, int]) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (datetime.date, datetime.datetime)):
        at = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
        return f'<c r="{ref}" s="1"><v>{(at - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1):.10g}</v></c>'
    if isinstance(value, (int, float)) or hasattr(value, "dtype") or type(value).__name__ == "Decimal":
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="s"><v>{shared.setdefault(str(value), len(shared))}</v></c>'


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _safe(text: str) -> str:
    """What XML can't hold, or would change (a carriage return), as _xHHHH_; texts that look so as well."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


def workbook_of(sheet: str, names: list[str], rows: Iterator[tuple]) -> bytes:
    """One sheet with a header row as a workbook's bytes."""
    shared: dict[str, int] = {}
    lines = []
    for n, row in enumerate([names, *rows], 1):
        lines.append(f'<row r="{n}">' + "".join(_cell(f"{_letters(i)}{n}", v, shared) for i, v in enumerate(row)) + "</row>")
    if len(lines) > MOST_ROWS:
        raise ValueError(f"a sheet has at most {MOST_ROWS} rows")
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{kind}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/><Relationship Id="rId3" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}" uniqueCount="{len(shared)}">' + "".join(f'<si><t xml:space="preserve">{_safe(t)}</t></si>' for t in shared) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + body)
    return out.getvalue()


def write_workbooks(rows: DataFrame, top: str, name: str, order: str, columns: list[str], sheet: str = "Sheet1") -> int:
    """A workbook <name>.xlsx below `top` for each value of `name`, rows by `order`, written by the executors.

    The caller's `name` bounds a workbook: a sheet holds at most 1,048,575 rows, and one with more is an error.
    """

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("_order", kind="stable")[[f"c{i}" for i in range(len(columns))]].astype(object)
        own = own.where(own.notna(), None)
        return pd.DataFrame({"name": [f"{key[0]}.xlsx"], "body": [workbook_of(sheet, columns, own.itertuples(index=False, name=None))]})

    table = rows.select(F.col(name).cast("string").alias("_name"), F.col(order).alias("_order"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    return store.write_files(table.groupBy("_name").applyInPandas(build, "name string, body binary"), top)

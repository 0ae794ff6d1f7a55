"""Excel workbooks (.xlsx) as relations: Spark lists and reads the files, tasks stream each sheet's XML.

A workbook is a zip of XML parts.  A task holds one file's compressed bytes,
its shared strings and one batch of rows; a sheet has at most 1,048,576 rows
by its format.  Files are read by Spark, so any file system of the cluster
will do, and each file is a task's own work.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 4096
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show a date or a time (fixed by the file format).
_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _text(el: ElementTree.Element) -> str:
    """The text of a string element: of its runs, without phonetic hints."""
    return "".join(t.text or "" for x in el if x.tag in (f"{_NS}t", f"{_NS}r") for t in ([x] if x.tag == f"{_NS}t" else x.iter(f"{_NS}t")))


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a part with a tag, one at a time."""
    with book.open(name) as f:
        parents: list[ElementTree.Element] = []
        for event, el in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(el)
                continue
            parents.pop()
            if el.tag == _NS + tag:
                yield el
                if parents:
                    parents[-1].clear()  # of what was read nothing is kept


class Workbook:
    """One file: where its sheets are, its strings and which styles are dates."""

    def __init__(self, content: bytes):
        self.book = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.book.namelist())
        root = ElementTree.fromstring(self.book.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.book.read("xl/_rels/workbook.xml.rels"))}
        # a target is a path from xl, or from the top if it starts with a slash
        self.sheets = {s.get("name"): posixpath.join("/xl", rels[s.get(_REL)]).lstrip("/") for s in root.iter(f"{_NS}sheet")}
        about = root.find(f"{_NS}workbookPr")
        late = about is not None and about.get("date1904") in ("1", "true")
        self.epoch = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)
        self.strings = [_text(x) for x in _elements(self.book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.book.read("xl/styles.xml"))
            own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter(f"{_NS}numFmt")}
            shown = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower()
            for x in styles.find(f"{_NS}cellXfs") if styles.find(f"{_NS}cellXfs") is not None else ():
                k = int(x.get("numFmtId", 0))
                self.dates.append(bool(re.search("[dmyhs]", shown(own[k]))) if k in own else k in _DATES)

    def cell(self, c: ElementTree.Element) -> Any:
        """A cell's value: text, number, boolean or date; None for blanks and errors."""
        kind, v = c.get("t", "n"), c.find(f"{_NS}v")
        if kind == "inlineStr":
            text = c.find(f"{_NS}is")
            return None if text is None else _text(text)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind == "d":
            return datetime.datetime.fromisoformat(v.text)
        if kind == "str":
            return v.text
        style, number = int(c.get("s", 0)), float(v.text)
        if style < len(self.dates) and self.dates[style]:
            return self.epoch + datetime.timedelta(milliseconds=round(number * 86_400_000))
        return number

    def rows(self, sheet: str | int) -> Iterator[tuple[int, dict[int, Any]]]:
        """(row number from 1, values by column from 0) of the rows that hold something."""
        names = list(self.sheets)
        name = names[sheet] if isinstance(sheet, int) else sheet
        if name not in self.sheets:
            raise ValueError(f"no sheet {name!r}, there are {', '.join(map(repr, names))}")
        at = 0
        for row in _elements(self.book, self.sheets[name], "row"):
            at, column, out = int(row.get("r", at + 1)), -1, {}
            for c in row.iter(f"{_NS}c"):
                ref = re.match("[A-Z]+", c.get("r", ""))
                column = column + 1
                if ref:
                    column = -1
                    for letter in ref[0]:
                        column = (column + 1) * 26 + ord(letter) - 65
                value = self.cell(c)
                if value is not None:
                    out[column] = value
            if out:
                yield at, out


def converted(value: Any, kind: T.DataType) -> Any:
    """A cell as a value of a Spark type; null where it does not fit, as a cast in SQL would give."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            if isinstance(value, float):
                return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
            return str(value).upper() if isinstance(value, bool) else str(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            when = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value).strip())
            return when.date() if isinstance(kind, T.DateType) else when
        if isinstance(value, datetime.datetime):
            return None
        number = float(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return number
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
        whole = int(value) if isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+\s*", value) else int(number)
        return whole if whole == number and -(1 << (bits - 1)) <= whole < 1 << (bits - 1) else None
    except (ValueError, OverflowError):
        return None


def scan_excel(spark: SparkSession, path: str, schema: str, sheet: str | int = 0, row_index: str | None = None) -> DataFrame:
    """The named columns of a sheet, by name or number, of each workbook under ``path``.

    The first row that holds something is the header; other columns of the
    sheet are not converted.  A missing column or sheet is an error that names
    it; of columns of one name the first counts.  Blank rows are passed over,
    blank and error cells are null, and so are cells that do not fit their
    column's type.  ``row_index`` adds a column with the row's place below the
    header, from 0, blank rows counted.  An empty sheet has no rows.
    """
    fields = T._parse_datatype_string(schema)
    out = T.StructType([*([T.StructField(row_index, T.LongType())] if row_index else []), *fields.fields])
    arrow = to_arrow_schema(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], arrow.names)

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c.as_py() for b in files for c in b.column("content")):
            columns, top, rows = None, 0, []
            for at, cells in Workbook(content).rows(sheet):
                if columns is None:
                    named: dict[str, int] = {}
                    for k, v in cells.items():
                        named.setdefault(str(v), k)
                    missing = [f.name for f in fields if f.name not in named]
                    if missing:
                        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
                    columns, top = [named[f.name] for f in fields], at
                    continue
                values = [converted(cells.get(k), f.dataType) for k, f in zip(columns, fields, strict=True)]
                rows.append((*([at - top - 1] if row_index else []), *values))
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, out)

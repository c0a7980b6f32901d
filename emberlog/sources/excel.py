"""Excel workbooks (.xlsx, .xlsm) as a Spark data source: one partition a sheet, whose XML is read as a stream."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store

#: Number formats of the file format that show dates or times
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
SCHEMA = "sheet string, sheet_no int, row long, cells array<string>"
MAIN, REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class ExcelError(ValueError):
    """A file that is no workbook, or has no sheet with a header and a row."""


def _opened(path: str) -> zipfile.ZipFile:
    """A workbook of any store that pyarrow reads; only the parts that are asked for are fetched."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    try:
        return zipfile.ZipFile(store.open_input_file(at))
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise ExcelError(f"{path} is no workbook: {e}") from e


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of one tag as they end; what has been read is given up, so that a part of any size is a stream."""
    if name not in book.namelist():
        return
    with book.open(name) as f:
        root = None
        for event, x in iterparse(f, ("start", "end")):
            if event == "start":
                root = x if root is None else root
            elif x.tag.endswith("}" + tag) or x.tag == tag:
                yield x
                root.clear()


def sheets(path: str) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in the workbook's order."""
    with _opened(path) as book:
        targets = {x.get("Id"): x.get("Target") for x in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
        found = [(x.get("name"), targets.get(x.get(f"{REL}id"), "")) for x in _elements(book, "xl/workbook.xml", "sheet")]
    if not found:
        raise ExcelError(f"{path} is no workbook: it has no sheets")
    return [(name, part.lstrip("/") if part.startswith("/") else f"xl/{part}") for name, part in found if part]


def _text(x) -> str:
    """Text of a shared or inline string, its runs joined and phonetic hints left out."""
    return "".join(t.text or "" for r in x if r.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([r] if r.tag == f"{MAIN}t" else r.iter(f"{MAIN}t")))


def _is_date(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', "", code, flags=re.I)
    return bool(re.search(r"[dmyhs]", plain.split(";")[0], re.I)) and "general" not in plain.lower()


def _dated_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    own = {int(x.get("numFmtId")): x.get("formatCode") or "" for x in _elements(book, "xl/styles.xml", "numFmt")}
    dated = DATE_FORMATS | {k for k, code in own.items() if _is_date(code)}
    for xfs in _elements(book, "xl/styles.xml", "cellXfs"):
        return {i for i, x in enumerate(xfs) if int(x.get("numFmtId", 0)) in dated}
    return set()


def _moment(value: float, epoch_1904: bool) -> str:
    """A serial number as text: a time of day below one, else date and time, rounded to milliseconds."""
    days, part = divmod(value, 1)
    rest = timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= value < 1 and rest < timedelta(days=1):
        return (datetime(2000, 1, 1) + rest).time().isoformat()
    base = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
    if not epoch_1904 and 0 < value < 60:
        days += 1  # the calendar of the format has a 29 February 1900
    return (base + timedelta(days=days) + rest).isoformat(sep=" ")


def _number(text: str) -> str:
    """Whole numbers without a fraction, others as Python writes them."""
    if re.fullmatch(r"-?\d+", text):
        return str(int(text))
    x = float(text)
    return str(int(x)) if x.is_integer() and abs(x) < 2**53 else str(x)


def _place(ref: str | None, usual: int) -> int:
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return usual
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows(path: str, part: str) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of each row of a sheet that has one; cells are texts, empty where nothing stands."""
    with _opened(path) as book:
        shared = [_text(x) for x in _elements(book, "xl/sharedStrings.xml", "si")]
        dated = _dated_styles(book)
        old = any(x.get("date1904") in ("1", "true") for x in _elements(book, "xl/workbook.xml", "workbookPr"))
        number = 0
        for row in _elements(book, part, "row"):
            number = int(row.get("r") or number + 1)
            cells: list[str] = []
            for c in row:
                at = _place(c.get("r"), len(cells))
                cells += [""] * (at + 1 - len(cells))
                kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    inner = c.find(f"{MAIN}is")
                    cells[at] = _text(inner) if inner is not None else ""
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind == "b":
                    cells[at] = "true" if v.text == "1" else "false"
                elif kind == "d":
                    cells[at] = v.text.replace("T", " ")
                elif kind in ("str", "e"):
                    cells[at] = v.text
                elif int(c.get("s") or 0) in dated:
                    cells[at] = _moment(float(v.text), old)
                else:
                    cells[at] = _number(v.text)
            if cells:
                yield number, cells


def header_of(cells: list[str]) -> list[str]:
    """Column names of a header row: as wide as its last name, gaps numbered by place, repeats by count."""
    width = max(i + 1 for i, v in enumerate(cells) if v)
    names, seen = [], {}
    for i, v in enumerate(cells[:width]):
        name = v.strip() or f"col_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


class _Sheet(InputPartition):
    def __init__(self, number: int, name: str, part: str):
        self.number, self.name, self.part = number, name, part


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only = options["path"], options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(i, name, part) for i, (name, part) in enumerate(sheets(self.path)) if self.only in (None, name)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        """Rows with something in them; the first of these has number 0 and is the header."""
        head, n = None, 0
        for _, cells in rows(self.path, partition.part):
            if not any(cells):
                continue
            if head is None:
                head = header_of(cells)
                yield partition.name, partition.number, 0, head
                continue
            values = (cells + [""] * len(head))[: len(head)]
            if any(values):
                n += 1
                yield partition.name, partition.number, n, values


class Workbook(DataSource):
    """``spark.read.format("workbook").load(path)``: (sheet, sheet_no, row, cells), row 0 the header; option ``sheet``: only that."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The table of each sheet with a header and a row, by name in the workbook's order; all columns are text, empty: null.

    Each table reads its own sheet alone. Old binary workbooks (.xls) are not read.
    """
    if path.lower().endswith(".xls"):
        raise ExcelError("old binary workbooks (.xls) are not read; save them as .xlsx")
    store.ship(spark)
    spark.dataSource.register(Workbook)
    whole = spark.read.format("workbook").load(path)
    filled = {r["sheet"] for r in whole.filter("row = 1").select("sheet").collect()}
    heads = {r["sheet"]: r["cells"] for r in whole.filter("row = 0").collect() if r["sheet"] in filled}
    if not heads:
        raise ExcelError("no sheet has a header and a row of data")
    out = {}
    for name, _ in sheets(path):
        if name in heads:
            one = spark.read.format("workbook").option("sheet", name).load(path).filter("row > 0")
            out[name] = one.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(heads[name])])
    return out

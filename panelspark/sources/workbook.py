"""Spreadsheet workbooks (zipped XML) as a source.

Workbooks are read with Spark's binary file scan, so any file system that Spark reaches will do, and each is parsed where its
task runs: the sheet is streamed row by row and leaves in Arrow batches.  A workbook is one task's work; its format
ends a sheet at 1,048,576 rows, which bounds that task, and a folder of workbooks spreads over the cluster.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = (".xlsx", ".xlsm")
_BATCH = 4096
_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.')
# The built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.items() if _name(k) == name), None)


def _text(element) -> str:
    """Text of a string item: its runs, without the reading aids beside them."""
    parts = []
    for child in element:
        if _name(child.tag) == "t":
            parts.append(child.text or "")
        elif _name(child.tag) == "r":
            parts += [t.text or "" for t in child if _name(t.tag) == "t"]
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _column(reference: str) -> int:
    """Number of a column, from 0, by the letters of a cell's reference."""
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n - 1


class Workbook:
    """One workbook's bytes: shared strings and date formats are read first, rows are streamed."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.members = set(self.zip.namelist())
        root = self._relations("", "officeDocument")
        self.book = root[0] if root else "xl/workbook.xml"
        tree = ElementTree.fromstring(self.zip.read(self.book))
        self.sheets = {}
        self.days_from = datetime(1899, 12, 30)
        targets = self._targets(self.book)
        for element in tree.iter():
            kind = _name(element.tag)
            if kind == "sheet":
                self.sheets[element.get("name")] = targets[next(v for k, v in element.items() if k.endswith("}id"))]
            elif kind == "workbookPr" and (element.get("date1904") or "0") in ("1", "true"):
                self.days_from = datetime(1904, 1, 1)
        self.strings = [s for path in self._relations(self.book, "sharedStrings") for s in self._shared(path)]
        self.dated = [d for path in self._relations(self.book, "styles") for d in self._date_styles(path)]

    def _relation_rows(self, member: str) -> list[tuple[str, str, str]]:
        folder, base = posixpath.split(member)
        path = posixpath.join(folder, "_rels", f"{base}.rels")
        if path not in self.members:
            return []
        rows = ElementTree.fromstring(self.zip.read(path))
        return [(r.get("Id"), r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/" + folder, r.get("Target", ""))).lstrip("/"))
                for r in rows]

    def _targets(self, member: str) -> dict[str, str]:
        return {key: target for key, _, target in self._relation_rows(member)}

    def _relations(self, member: str, kind: str) -> list[str]:
        return [target for _, k, target in self._relation_rows(member) if k == kind and target in self.members]

    def _shared(self, path: str) -> Iterator[str]:
        with self.zip.open(path) as source:
            for _, element in ElementTree.iterparse(source):
                if _name(element.tag) == "si":
                    yield _text(element)
                    element.clear()

    def _date_styles(self, path: str) -> list[bool]:
        """For each cell style: whether it shows a date or time."""
        tree = ElementTree.fromstring(self.zip.read(path))
        dates, styles = set(_DATE_FORMATS), []
        for element in tree.iter():
            if _name(element.tag) == "numFmt" and re.search("[ymdhs]", _QUOTED.sub("", element.get("formatCode", "")).lower().replace("general", "")):
                dates.add(int(element.get("numFmtId")))
        for group in tree:
            if _name(group.tag) == "cellXfs":
                styles = [int(xf.get("numFmtId") or 0) in dates for xf in group]
        return styles

    def moment(self, serial: float) -> datetime | None:
        """Date and time of a day number; the first calendar counts a 29 February 1900 that never was."""
        if self.days_from.year == 1899 and serial < 60:
            serial += 1
        try:
            return self.days_from + timedelta(microseconds=round(serial * 86_400_000_000 / 1000) * 1000)
        except OverflowError:
            return None

    def _value(self, cell):
        """A cell as text, number, truth value or time; None where it is empty or an error."""
        kind, text = cell.get("t", "n"), None
        for child in cell:
            if _name(child.tag) == "v":
                text = child.text
            elif _name(child.tag) == "is":
                return _text(child)
        if text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(text)]
        if kind == "str":
            return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        if kind == "b":
            return text.strip() == "1"
        if kind == "d":
            return datetime.fromisoformat(text).replace(tzinfo=None)
        style = int(cell.get("s") or 0)
        number = float(text)
        return self.moment(number) if style < len(self.dated) and self.dated[style] else number

    def rows(self, sheet: str | None = None) -> Iterator[tuple[int, dict[int, object]]]:
        """Row number (from 1) and values by column of the rows that hold any; the first sheet unless one is named."""
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r} among {list(self.sheets)}")
        path = self.sheets[sheet] if sheet is not None else next(iter(self.sheets.values()))
        number = 0
        with self.zip.open(path) as source:
            events = ElementTree.iterparse(source, ("start", "end"))
            data = None
            for event, element in events:
                kind = _name(element.tag)
                if event == "start":
                    data = element if kind == "sheetData" else data
                    continue
                if kind != "row":
                    continue
                number = int(element.get("r") or number + 1)
                values, at = {}, -1
                for cell in element:
                    if _name(cell.tag) != "c":
                        continue
                    at = _column(cell.get("r")) if cell.get("r") else at + 1
                    value = self._value(cell)
                    if value is not None:
                        values[at] = value
                if data is not None:
                    data.clear()
                if values:
                    yield number, values


def _label(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    if isinstance(value, datetime):
        return str(value.date()) if value.time() == datetime.min.time() else str(value)
    return value


def _number(book: Workbook, value) -> float | None:
    if isinstance(value, datetime):
        days = (value - book.days_from) / timedelta(days=1)
        return days - 1 if book.days_from.year == 1899 and days <= 60 else days
    try:
        return float(value)
    except ValueError:
        return None


def _whole(book: Workbook, value) -> int | None:
    if isinstance(value, str) and re.fullmatch(r"\s*[+-]?[0-9]{1,18}\s*", value):
        return int(value)
    number = _number(book, value)
    return int(number) if number is not None and number == number and abs(number) < 2 ** 63 and number.is_integer() else None


def _moment(book: Workbook, value) -> datetime | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        try:
            return datetime.fromisoformat(value.strip()).replace(tzinfo=None)
        except ValueError:
            return None
    return value if isinstance(value, datetime) else book.moment(value) if value == value else None


def _day(book: Workbook, value) -> date | None:
    found = _moment(book, value)
    return None if found is None else found.date()


def _truth(book: Workbook, value) -> bool | None:
    if isinstance(value, str):
        return {"true": True, "false": False}.get(value.strip().lower())
    return None if isinstance(value, datetime) else bool(value)


def _reader(kind: T.DataType):
    """Python's conversion for a column, and the type in which it travels."""
    if isinstance(kind, T.BooleanType):
        return _truth, pa.bool_()
    if isinstance(kind, T.DateType):
        return _day, pa.date32()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _moment, pa.timestamp("us")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _number, pa.float64()
    if isinstance(kind, T.IntegralType):
        return _whole, pa.int64()
    return (lambda _, value: _label(value)), pa.string()


_TRAVEL = {pa.bool_(): "boolean", pa.date32(): "date", pa.timestamp("us"): "timestamp_ntz", pa.float64(): "double",
           pa.int64(): "bigint", pa.string(): "string"}


def _unique(labels: Sequence[str]) -> list[str]:
    """Names of the columns: empty ones by their place, repeated ones numbered."""
    out: list[str] = []
    for i, label in enumerate(labels):
        name, k = label or f"_c{i}", 1
        while name in out:
            name, k = f"{label or f'_c{i}'}.{k}", k + 1
        out.append(name)
    return out


def _header(values: dict[int, object]) -> list[str]:
    return _unique([_label(values[i]) if i in values else "" for i in range(max(values, default=-1) + 1)])


def _files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)) \
        .where(F.lower("path").rlike(r"\.xls[xm]$") & ~F.col("path").rlike(r"/~\$[^/]*$"))


def _names(spark: SparkSession, paths: Sequence[str], sheet: str | None, header: bool) -> list[str]:
    """Columns of the first workbook in path order: its header, or numbers as far as its first row goes."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                values = next(Workbook(content.as_py()).rows(sheet), (0, {}))[1]
                names = _header(values) if header else [f"_c{i}" for i in range(max(values, default=-1) + 1)]
                yield pa.RecordBatch.from_pydict({"names": pa.array([names], pa.list_(pa.string()))})

    path = _files(spark, paths).agg(F.min("path").alias("path")).first().path
    if path is None:
        return []
    one = spark.read.format("binaryFile").load(path.replace("%20", " ")).select("content")
    return one.mapInArrow(first, "names array<string>").first().names


def read_workbooks(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None,
                   sheet: str | None = None, header: bool = True, row_column: str | None = None,
                   file_column: str | None = None) -> DataFrame:
    """Rows of a sheet (the first unless named) of all workbooks at the paths: files, folders or patterns.

    With ``header`` the first row that holds a value names the columns, and columns of ``schema`` are found by name in each
    workbook, wherever they stand; one that a workbook lacks is null.  Without it they go by place.  Without ``schema`` the
    first workbook names the columns and all are strings.  Day numbers become dates and times by the cell's format, or by
    the column's type, in the session's time zone.  A value that does not fit its column's type is null, as are errors.
    Rows without any value are not rows; of merged cells the first holds the value.  No workbook, or one without rows,
    gives none.  ``row_column`` adds the row's number in its sheet, ``file_column`` the path.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in _names(spark, paths, sheet, header)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wanted = [f.name for f in schema.fields]
    readers, kinds = zip(*[_reader(f.dataType) for f in schema.fields]) if wanted else ((), ())
    columns = [f"c{i}" for i in range(len(wanted))]
    arrow = pa.schema([*zip(columns, kinds), ("row", pa.int64()), ("file", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                book, held = Workbook(content.as_py()), []
                rows = book.rows(sheet)
                places = list(range(len(wanted)))
                if header:
                    found = {n: i for i, n in enumerate(_header(next(rows, (0, {}))[1]))}
                    places = [found.get(n, -1) for n in wanted]

                def emit() -> pa.RecordBatch:
                    cells = [[None if p not in v else read(book, v[p]) for _, v in held] for p, read in zip(places, readers)]
                    out = [pa.array(c, k) for c, k in zip(cells, kinds)]
                    out += [pa.array([n for n, _ in held], pa.int64()), pa.array([path.as_py()] * len(held), pa.string())]
                    held.clear()
                    return pa.RecordBatch.from_arrays(out, schema=arrow)

                for row in rows:
                    held.append(row)
                    if len(held) == _BATCH:
                        yield emit()
                if held:
                    yield emit()

    travel = ", ".join([*(f"{c} {_TRAVEL[k]}" for c, k in zip(columns, kinds)), "row bigint", "file string"])
    rows = _files(spark, paths).select("path", "content").mapInArrow(parse, travel)
    out = [F.col(c).try_cast(f.dataType).alias(f.name) for c, f in zip(columns, schema.fields)]
    out += [F.col("row").alias(row_column)] if row_column else []
    out += [F.col("file").alias(file_column)] if file_column else []
    return rows.select(*out)

"""Office packages (docx, xlsx, pptx) as a Spark data source, read with the standard library.

``spark.read.format("office").load(folder)`` gives one row an object:
``path, kind, unit, ord, type, text, ref, hidden``, of a folder that every executor
sees as a local one. ``packages(spark, path)`` gives the same rows from any file
system that Spark reads; on a cluster it is the one to use. Files that cannot be
opened give one row of type "error" and never fail the job. One partition holds a
bounded number of bytes of files, so large folders spread over the cluster.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, unit string, ord int, type string, text string, ref string, hidden boolean"
_ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in SCHEMA.split(", ")])
PARTITION_BYTES = 64 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Names inside a package that carry active content, and formulas that reach outside (fixed values).
ACTIVE_PARTS = re.compile(r"vbaProject\.bin$|/embeddings/|oleObject|activeX|externalLinks/", re.I)
ACTIVE_FORMULAS = re.compile(r"\b(?:DDE|DDEAUTO|WEBSERVICE|HYPERLINK|IMPORTDATA|CALL|REGISTER\.ID|EXEC)\s*\(|\|'?[^']*'?!", re.I)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def split_ref(ref: str) -> tuple[int, int] | None:
    """"B7" as (7, 2); anything else is None."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?(\d{1,7})", ref)
    return (int(m.group(2)), column_number(m.group(1))) if m else None


def make_ref(row: int, column: int) -> str:
    letters = ""
    while column:
        column, k = divmod(column - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row}"


def range_bounds(text: str) -> tuple[int, int, int, int] | None:
    ends = [split_ref(p) for p in text.split(":")]
    if not 1 <= len(ends) <= 2 or None in ends:
        return None
    (r0, c0), (r1, c1) = ends[0], ends[-1]
    return min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)


def serial_date(serial: float, date1904: bool = False) -> str:
    """ISO date of a spreadsheet day number; the calendar of 1900 counts a leap day that never was."""
    from datetime import date, timedelta

    start = date(1904, 1, 1) if date1904 else date(1899, 12, 30) if serial >= 60 else date(1899, 12, 31)
    return (start + timedelta(days=int(serial))).isoformat()


def _xml(package: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(package.read(name))
    except (KeyError, ElementTree.ParseError):
        return None


def _document(package: zipfile.ZipFile) -> Iterator[tuple]:
    root = _xml(package, "word/document.xml")
    body = root.find(f"{_W}body") if root is not None else None
    for k, node in enumerate(body if body is not None else ()):
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            kind = "heading" if name.lower().startswith(("heading", "title")) else "list" if node.find(f"{_W}pPr/{_W}numPr") is not None else "paragraph"
            runs = list(node.iter(f"{_W}r"))
            text = "".join(t.text or "" for t in node.iter(f"{_W}t"))
            hidden = bool(runs) and all(r.find(f"{_W}rPr/{_W}vanish") is not None for r in runs)
            if text.strip():
                yield "body", k, kind, text, None, hidden
        elif node.tag == f"{_W}tbl":
            for i, row in enumerate(node.iter(f"{_W}tr"), 1):
                for j, cell in enumerate(row.iter(f"{_W}tc"), 1):
                    yield "body", k, "cell", "".join(t.text or "" for t in cell.iter(f"{_W}t")), make_ref(i, j), False


def _workbook(package: zipfile.ZipFile) -> Iterator[tuple]:
    shared = _xml(package, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in shared] if shared is not None else []
    book, links = _xml(package, "xl/workbook.xml"), _xml(package, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in links} if links is not None else {}
    for sheet in book.iter(f"{_S}sheet") if book is not None else ():
        name, target = sheet.get("name", ""), targets.get(sheet.get(f"{_R}id"), "")
        root = _xml(package, target if target.startswith("xl/") else f"xl/{target}")
        if root is None:
            continue
        off = sheet.get("state", "visible") != "visible"
        columns = {c for col in root.iter(f"{_S}col") if col.get("hidden") == "1" for c in range(int(col.get("min")), int(col.get("max")) + 1)}
        for row in root.iter(f"{_S}row"):
            for cell in row.iter(f"{_S}c"):
                value, formula = cell.find(f"{_S}v"), cell.find(f"{_S}f")
                text = value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                if cell.get("t") == "s" and text:
                    text = strings[int(text)] if int(text) < len(strings) else ""
                place = split_ref(cell.get("r", ""))
                hidden = off or row.get("hidden") == "1" or bool(place and place[1] in columns)
                if formula is not None and formula.text:
                    yield name, int(row.get("r", 0)), "active" if ACTIVE_FORMULAS.search(formula.text) else "formula", formula.text, cell.get("r"), hidden
                if text:
                    yield name, int(row.get("r", 0)), "cell", text, cell.get("r"), hidden
        for merge in root.iter(f"{_S}mergeCell"):
            yield name, 0, "merge", "", merge.get("ref"), off


def _slides(package: zipfile.ZipFile) -> Iterator[tuple]:
    names = sorted((n for n in package.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for slide, part in enumerate(names, 1):
        root = _xml(package, part)
        for k, shape in enumerate(root.iter(f"{_P}sp") if root is not None else ()):
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")).strip()
            place, size = shape.find(f".//{_A}xfrm/{_A}off"), shape.find(f".//{_A}xfrm/{_A}ext")
            box = ",".join(e.get(a, "0") for e, a in ((place, "x"), (place, "y"), (size, "cx"), (size, "cy")) if e is not None)
            hidden = size is not None and (size.get("cx") == "0" or size.get("cy") == "0") or place is not None and (int(place.get("x", 0)) < 0 or int(place.get("y", 0)) < 0)
            title = any(p.get("type") in ("title", "ctrTitle") for p in shape.iter(f"{_P}ph"))
            if text:
                yield f"slide {slide}", k, "heading" if title else "paragraph", text, box or None, bool(hidden)


_READERS = {"docx": _document, "xlsx": _workbook, "pptx": _slides}


def read_file(path: str, content: bytes | None = None) -> Iterator[tuple]:
    """Rows of one package, from its bytes or, without them, from a local file."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        with zipfile.ZipFile(path if content is None else io.BytesIO(content)) as package:
            for n in package.namelist():
                if ACTIVE_PARTS.search(n):
                    yield path, kind, "package", 0, "active", n, None, False
                elif n.endswith(".rels") and (root := _xml(package, n)) is not None:
                    for r in root:
                        if r.get("TargetMode") == "External":
                            yield path, kind, "package", 0, "link", r.get("Target"), None, False
            for row in _READERS[kind](package):
                yield (path, kind, *row)
    except (zipfile.BadZipFile, OSError, KeyError, ValueError) as e:
        yield path, kind, "package", 0, "error", type(e).__name__, None, False


def packages(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of all packages under the paths, on any file system that Spark reads: listed, split and read by its binary file source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx,pptx,DOCX,XLSX,PPTX}").option("recursiveFileLookup", "true").load(list(paths))
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, content in zip(frame.column(0), frame.column(1)):
                rows = list(read_file(path.as_py(), content.as_py()))
                yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema=_ARROW)

    return files.select("path", "content").mapInArrow(read, SCHEMA)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        files = [self.folder] if Path(self.folder).is_file() else sorted(str(p) for p in Path(self.folder).rglob("*") if p.suffix.lower()[1:] in _READERS)
        parts, size = [[]], 0
        for f in files:
            bytes_ = Path(f).stat().st_size
            if parts[-1] and size + bytes_ > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += bytes_
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            yield from read_file(path)


class OfficeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://").removeprefix("file:"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfficeDataSource)

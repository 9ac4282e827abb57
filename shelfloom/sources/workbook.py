"""Workbooks of rows: a data source with a partition for each file, which streams the first sheet, and a writer with a file for each task.

A workbook is a zip of XML parts. The reader takes the sheet's rows one after another as they are unpacked; of a file, only its
table of shared strings is held.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a sheet at the most, its header's included: a fixed value of the format.
MOST_ROWS = 1 << 20
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Rows" sheetId="1" r:id="r1"/></sheets></workbook>'
_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_UNSAID = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ET.Element) -> str:
    """The text of a string cell: its runs together, without phonetic ones."""
    return "".join(t.text or "" for part in ([e] if _name(e) == "t" else [c for c in e if _name(c) in ("t", "r", "is")]) for t in ([part] if _name(part) == "t" else part.iter()) if _name(t) == "t")


def _finished(stream, name: str) -> Iterator[ET.Element]:
    """Elements of a name as they end; what has ended is let go."""
    above: list[ET.Element] = []
    for event, e in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if _name(e) == name:
            yield e
            e.clear()
            if above:
                above[-1].remove(e)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(file) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an opened workbook, as texts; empty cells are null, blank rows are left out."""
    with zipfile.ZipFile(file) as book:
        there = set(book.namelist())
        ids = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheet = next(e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if _name(e) == "sheet")
        target = ids[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared: list[str] = []
        if "xl/sharedStrings.xml" in there:
            with book.open("xl/sharedStrings.xml") as f:
                shared = [_texts(e) for e in _finished(f, "si")]
        with book.open(target) as f:
            for row in _finished(f, "row"):
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    kind, value = c.get("t", "n"), next((v for v in c if _name(v) in ("v", "is")), None)
                    text = None if value is None else _texts(value) if kind == "inlineStr" else shared[int(value.text)] if kind == "s" else value.text
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = None if kind == "e" else {"0": "false", "1": "true"}.get(text, text) if kind == "b" else text
                if any(v not in (None, "") for v in cells):
                    yield cells


class FilePartition(InputPartition):
    def __init__(self, uri: str, number: int) -> None:
        self.uri, self.number = uri, number


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path = schema.names, options["path"]

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith(".xlsx"))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [FilePartition(f"{scheme}{n}", k) for k, n in enumerate(names)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, file = fs.FileSystem.from_uri(partition.uri)
        schema = pa.schema([(n, pa.int64() if n == "__row" else pa.string()) for n in self.names])
        with store.open_input_file(file) as raw:
            rows, header, held = sheet_rows(io.BufferedReader(raw)), None, []
            for k, cells in enumerate(rows):
                if header is None:
                    header = [(c or "").strip() for c in cells]
                    place = [header.index(n) if n in header else -1 for n in self.names]
                    continue
                held.append([(partition.number << 32) + k if n == "__row" else cells[p] if 0 <= p < len(cells) else None for n, p in zip(self.names, place, strict=True)])
                if len(held) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class WorkbookSource(DataSource):
    """Columns by the names of each file's first row; text all of them. A column __row (long) numbers the rows by file and place."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        raise ValueError("a workbook source needs the columns to read: .schema('SKU string, ...')")

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)


def read_workbooks(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of all workbooks of a path (.xlsx, at any depth; a file or a folder), each read in a task of its own.

    The named columns as text, null where a file lacks one or a cell is empty, and __row, the order of the rows.
    """
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").schema(", ".join([*(f"`{c}` string" for c in columns), "`__row` long"])).load(path)


def write_workbooks(df: DataFrame, path: str, most: int = MOST_ROWS - 1) -> DataFrame:
    """Writes df as workbooks of one sheet, one for each task and more where a sheet is full; returns file and rows of each.

    Numbers are number cells, everything else is text; nulls are empty cells. Files are written under a draft name and moved.
    """
    names, kinds = df.columns, dict(df.dtypes)
    number = [kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal") for c in names]

    def cell(value, is_number: bool) -> str:
        if value is None:
            return "<c/>"
        if is_number:
            return f"<c><v>{value}</v></c>"
        text = _UNSAID.sub("", str(value)).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = next(rows, None)
        done = []
        while held is not None:
            store.create_dir(root, recursive=True)
            own, n = uuid.uuid4().hex, 0
            with store.open_output_stream(f"{root}/.draft-{own}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as book:
                book.writestr("[Content_Types].xml", _TYPES)
                book.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml"))
                book.writestr("xl/workbook.xml", _BOOK)
                book.writestr("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml"))
                with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                    sheet.write((_SHEET + "<row>" + "".join(cell(c, False) for c in names) + "</row>").encode())
                    while held is not None and n < most:
                        sheet.write(("<row>" + "".join(map(cell, held, number)) + "</row>").encode())
                        n, held = n + 1, next(rows, None)
                    sheet.write(b"</sheetData></worksheet>")
            store.move(f"{root}/.draft-{own}", f"{root}/rows-{own}.xlsx")
            done.append((f"rows-{own}.xlsx", n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["file", "rows"])

    written = df.mapInArrow(write, "file string, rows long")
    written.write.parquet(f"{path}/manifest")  # written once
    return df.sparkSession.read.parquet(f"{path}/manifest")

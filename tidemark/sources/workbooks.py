"""Workbooks of several sheets: read as one row a cell, and written.

A workbook is a zip of XML. It is read by one task a file, row by row as its XML comes, and written by one task a workbook:
the format bounds a sheet to MOST_ROWS rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .named_files import write_contents

# Names of the format, and its greatest number of rows.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576

CELL = "sheet string, row int, col int, kind string, text string, number double"
_FILE_CELL = f"file string, {CELL}"


def column_number(letters: str) -> int:
    """A is 1, Z 26, AA 27."""
    return reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0)


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text_of(element) -> str:
    """All text runs of a string, without its phonetic ones."""
    return "".join(t.text or "" for part in element for t in ([part] if part.tag == f"{{{MAIN}}}t" else part.findall(f"{{{MAIN}}}t") if part.tag == f"{{{MAIN}}}r" else []))


def read_cells(content: bytes) -> Iterator[tuple[str, int, int, str, str | None, float | None]]:
    """sheet, row, col (both from 1), kind (number, text, boolean, error), text and number of every cell that has a value, sheet by sheet in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                for _, element in ElementTree.iterparse(part):
                    if element.tag == f"{{{MAIN}}}si":
                        shared.append(_text_of(element))
                        element.clear()
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
            target = links[sheet.get(f"{{{DOCUMENT}}}id")]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if path in names:
                with book.open(path) as part:
                    yield from ((sheet.get("name"), *cell) for cell in _sheet_cells(part, shared))


def _sheet_cells(part, shared: list[str]) -> Iterator[tuple[int, int, str, str | None, float | None]]:
    row = 0
    for _, element in ElementTree.iterparse(part):
        if element.tag != f"{{{MAIN}}}row":
            continue
        row, col = int(element.get("r", row + 1)), 0
        for cell in element.findall(f"{{{MAIN}}}c"):
            place = re.match(r"[A-Z]+", cell.get("r", ""))
            col = column_number(place[0]) if place else col + 1
            kind, value, inline = cell.get("t", "n"), cell.findtext(f"{{{MAIN}}}v"), cell.find(f"{{{MAIN}}}is")
            if kind == "inlineStr" and inline is not None:
                yield row, col, "text", _text_of(inline), None
            elif value is None:
                continue
            elif kind == "s":
                yield row, col, "text", shared[int(value)], None
            elif kind in ("str", "d"):
                yield row, col, "text", value, None
            elif kind == "b":
                yield row, col, "boolean", value, float(value)
            elif kind == "e":
                yield row, col, "error", value, None
            else:
                yield row, col, "number", value, float(value)
        element.clear()


def cells(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """A row for each cell with a value of all workbooks under ``path``, with the file's name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in _FILE_CELL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for cell in read_cells(content.as_py()):
                    rows.append((file.as_py(), *cell))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return found.mapInArrow(run, _FILE_CELL)


def sheet(found: DataFrame, name: str, schema: str, header: bool = True) -> DataFrame:
    """The rows of a sheet of all files: file, row and columns by position, as ``schema`` names and types them; a missing cell is null."""
    own = found.filter((F.col("sheet") == name) & (F.col("row") > (1 if header else 0)))
    columns = []
    for k, field in enumerate(schema.split(", "), 1):
        column, kind = field.split()
        value = F.col("text") if kind == "string" else F.col("number").cast(kind)
        columns.append(F.max(F.when(F.col("col") == k, value)).alias(column))
    return own.groupBy("file", "row").agg(*columns)


def as_cells(df: DataFrame, file: str | Column, name: str, order: list[str]) -> DataFrame:
    """file, sheet, row, col, kind, text and number of a table as a sheet ``name``: a header, then its rows by ``order``, at most MOST_ROWS of a file."""
    file = F.lit(file) if isinstance(file, str) else file
    numbered = df.withColumn("__file", file).withColumn("__row", F.row_number().over(Window.partitionBy("__file").orderBy(*order)) + 1)
    kinds = dict(df.dtypes)

    def cell(k: int, c: str) -> Column:
        text = kinds[c] in ("string", "date", "timestamp")
        return F.struct(F.lit(k).alias("col"), F.lit("text" if text else "number").alias("kind"), F.when(F.lit(text), F.col(c).cast("string")).alias("text"), (F.lit(None) if text else F.col(c)).cast("double").alias("number"))

    body = numbered.select(F.col("__file").alias("file"), F.lit(name).alias("sheet"), F.col("__row").alias("row"), F.inline(F.array(*(cell(k, c) for k, c in enumerate(df.columns, 1)))))
    titles = F.array(*(F.struct(F.lit(k).alias("col"), F.lit("text").alias("kind"), F.lit(c).alias("text"), F.lit(None).cast("double").alias("number")) for k, c in enumerate(df.columns, 1)))
    head = numbered.select("__file").distinct().select(F.col("__file").alias("file"), F.lit(name).alias("sheet"), F.lit(1).alias("row"), F.inline(titles))
    return head.union(body).filter(F.col("text").isNotNull() | F.col("number").isNotNull())


def workbook(table: pa.Table) -> bytes:
    """The bytes of a workbook with these cells (sheet, row, col, text, number); sheets are in order of their names."""
    out = io.BytesIO()
    order = table.sort_by([("sheet", "ascending"), ("row", "ascending"), ("col", "ascending")])
    titles = order.column("sheet").unique().to_pylist()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(titles) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{DOCUMENT}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(titles) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        sheets = "".join(f'<sheet name={quoteattr(title)} sheetId="{k}" r:id="rId{k}"/>' for k, title in enumerate(titles, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}"><sheets>{sheets}</sheets></workbook>')
        rows = zip(*(order.column(c).to_pylist() for c in ("sheet", "row", "col", "text", "number")))
        part, now, line = None, None, None
        for title, row, col, text, number in rows:
            if title != now:
                if part:
                    part.write(b"</row></sheetData></worksheet>")
                    part.close()
                now, line = title, None
                part = book.open(f"xl/worksheets/sheet{titles.index(title) + 1}.xml", "w")
                part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
            if row != line:
                if row > MOST_ROWS:
                    raise ValueError(f"a sheet has at most {MOST_ROWS} rows")
                part.write((("</row>" if line else "") + f'<row r="{row}">').encode())
                line = row
            place = f"{column_letters(col)}{row}"
            part.write((f'<c r="{place}"><v>{number!r}</v></c>' if text is None else f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>').encode())
        if part:
            part.write(b"</row></sheetData></worksheet>")
            part.close()
    return out.getvalue()


def write(found: DataFrame, folder: str) -> None:
    """Write a workbook for each ``file`` of the cells, all in one job and with one commit."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        return pa.table({"name": [key[0].as_py()], "content": pa.array([workbook(own)], pa.binary())})

    write_contents(found.select("file", "sheet", "row", "col", "text", "number").groupBy("file").applyInArrow(run, "name string, content binary"), folder)

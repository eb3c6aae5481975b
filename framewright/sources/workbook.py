"""A workbook of many sheets as one Office Open XML package, written and read as streams.

Spark makes each sheet's rows as XML and writes them in order; a task then copies these parts, one after the other, into
the package, so that no sheet is held in memory, by the driver or the task. Reading goes the other way: a task for each
sheet parses its rows as they come, and Spark has them as a table again.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.readers import file_system
from framewright.staging import shared_dir

# The format's most rows and longest name of a sheet, and digits that a number keeps.
MOST_ROWS, LONGEST_NAME, DIGITS = 1_048_576, 31, 15
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _plain(text: Column) -> Column:
    """Text for XML: escaped, without the characters that XML can't hold."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def _cell(name: str, kind: str) -> Column:
    """A cell: empty for NULL, a number where it keeps its digits, a truth value, or text."""
    c = F.col(f"`{name}`")
    text = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _plain(c.cast("string")), F.lit("</t></is></c>"))
    out = text
    if kind in NUMBERS:
        value = F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))
        exact = ~(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))) if kind in ("float", "double") else F.abs(c) < F.lit(10**DIGITS)
        out = F.when(exact, value).otherwise(text)
    elif kind == "boolean":
        out = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    return F.coalesce(out, F.lit("<c/>"))


def write_workbook(spark: SparkSession, sheets: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """The sheets (table, order) as one workbook; a header row each, rows in their order.

    A sheet of more rows than the format allows, or whose name is too long or repeats, is an error, not cut.
    """
    if len({n.lower() for n in sheets}) < len(sheets) or any(len(n) > LONGEST_NAME or set(n) & set("[]:*?/\\") for n in sheets):
        raise ValueError("names of sheets repeat or aren't allowed")
    root = f"{shared_dir(spark)}/framewright-workbook-{uuid.uuid4().hex}"
    for i, (name, (df, order)) in enumerate(sheets.items()):
        cells = F.concat(F.lit("<row>"), *[_cell(c, kind) for c, kind in df.dtypes], F.lit("</row>"))
        df.orderBy(*order).select(cells.alias("value")).write.text(f"{root}/{i}")
        if (n := spark.read.text(f"{root}/{i}").count()) >= MOST_ROWS:
            raise ValueError(f"{n} rows are too many for sheet {name}")
    heads = [(i, name, "".join(f"<c t=\"inlineStr\"><is><t>{_escape(c)}</t></is></c>" for c in df.columns)) for i, (name, (df, _)) in enumerate(sheets.items())]

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for _ in batches:
            where, folder = file_system(root)
            out, target = file_system(path)
            with out.open_output_stream(target) as stream, zipfile.ZipFile(_Unseekable(stream), "w", zipfile.ZIP_DEFLATED) as package:
                for part, text in _package([n for _, n, _ in heads]).items():
                    package.writestr(part, text)
                for i, _, head in heads:
                    with package.open(f"xl/worksheets/sheet{i + 1}.xml", "w", force_zip64=True) as sheet:
                        sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData><row>{head}</row>'.encode())
                        files = sorted(f.path for f in where.get_file_info(fs.FileSelector(f"{folder}/{i}")) if f.base_name.startswith("part-"))
                        for file in files:
                            with where.open_input_stream(file) as rows:
                                while data := rows.read(1 << 20):
                                    sheet.write(data)
                        sheet.write(b"</sheetData></worksheet>")
            yield pd.DataFrame({"path": [path]})

    spark.range(1, numPartitions=1).mapInPandas(assemble, "path string").collect()  # one package has one writer


class _Unseekable(io.RawIOBase):
    """A stream that zip may only append to."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        return self.stream.write(bytes(data))


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _package(names: list[str]) -> dict[str, str]:
    """The parts of the package besides the sheets."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    numbers = range(1, len(names) + 1)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{SHEET_TYPE}.worksheet+xml"/>' for i in numbers)
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, names, strict=True))
    links = "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{SHEET_TYPE}.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
    }


def _rows(package: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    """The rows of a sheet's part, one at a time; an empty cell is None."""
    with package.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{{{MAIN}}}row":
                row = []
                for cell in e:
                    value = cell.find(f"{{{MAIN}}}v")
                    text = cell.find(f"{{{MAIN}}}is/{{{MAIN}}}t")
                    row.append(value.text if value is not None else (text.text or "") if text is not None else None)
                yield row
                e.clear()


def sheet_names(path: str) -> list[str]:
    """The names of a workbook's sheets, in order."""
    where, name = file_system(path)
    with where.open_input_file(name) as f, zipfile.ZipFile(f) as package:
        return [e.get("name") for e in ElementTree.fromstring(package.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]


def read_sheets(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """sheet, row (from 0), cells: the header's fields and their texts, NULL for empty cells; a task for each sheet."""
    every = sheet_names(path)
    wanted = [(every.index(n) + 1, n) for n in (every if names is None else names)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, name in zip(pdf.number, pdf.sheet, strict=True):
                where, file = file_system(path)
                with where.open_input_file(file) as f, zipfile.ZipFile(f) as package:
                    rows = _rows(package, f"xl/worksheets/sheet{number}.xml")
                    head, held = next(rows), []
                    for i, row in enumerate(rows):
                        held.append((name, i, dict(zip(head, row, strict=True))))
                        if len(held) == 1000:
                            yield pd.DataFrame(held, columns=["sheet", "row", "cells"])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["sheet", "row", "cells"])

    parts = spark.createDataFrame(wanted, "number int, sheet string").repartition(max(len(wanted), 1), "number")
    return parts.mapInPandas(read, "sheet string, row long, cells map<string,string>")


def sheet_table(cells: DataFrame, sheet: str, like: DataFrame) -> DataFrame:
    """A sheet of read_sheets() as a table with the columns and types of another."""
    value = lambda c, kind: (F.col("cells")[c] == "1") if kind == "boolean" else F.col("cells")[c].cast(kind)
    return cells.where(F.col("sheet") == sheet).select(*[value(c, kind).alias(c) for c, kind in like.dtypes])


def unequal(cells: DataFrame, sheet: str, df: DataFrame) -> DataFrame:
    """The rows that a sheet, read back, and its table don't have equally often, with side: sheet or table.

    Numbers are compared to 12 digits; missing values must stay missing.
    """
    def shown(t: DataFrame) -> DataFrame:
        return t.select(*[F.format_string("%.12e", c).alias(c) if kind in ("float", "double") else F.col(f"`{c}`").cast("string").alias(c) for c, kind in t.dtypes])

    a, b = shown(sheet_table(cells, sheet, df)), shown(df)
    return a.exceptAll(b).withColumn("side__", F.lit("sheet")).unionByName(b.exceptAll(a).withColumn("side__", F.lit("table")))

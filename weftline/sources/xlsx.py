"""Spreadsheet sheets as a Spark data source, without a spreadsheet library.

``spark.dataSource.register(SheetSource)``, then ``spark.read.format("sheet").option("sheet", name).load(path)`` gives
(row_idx long, cells array<string>): every row in file order, values as text, empty cells null. A file is one task, as
its rows are one XML stream; Spark reads many files in parallel. ``write_workbook`` is a driver-side export of small tables.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from glob import glob
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_index(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        sheets = {s.get("name"): s.get(RELATION) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise ValueError(f"no sheet {name!r} in {path}: {sorted(sheets)}")
        with z.open("xl/" + targets[sheets[name]].removeprefix("/xl/")) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    at = column_index(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value = c.find(f"{MAIN}v")
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    else:
                        text = value.text if value is not None else None
                        if c.get("t") == "s" and text is not None:
                            text = shared[int(text)]
                    cells.append(text or None)
                yield int(row.get("r", 0)) - 1, cells
                row.clear()


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob(self.path)) or [self.path]]

    def read(self, partition):
        yield from sheet_rows(partition.value, self.sheet)


class SheetSource(DataSource):
    @classmethod
    def name(cls):
        return "sheet"

    def schema(self):
        return "row_idx long, cells array<string>"

    def reader(self, schema):
        return _Reader(self.options)


def with_header(sheet: DataFrame) -> DataFrame:
    """The rows below the first as named string columns."""
    head = [c or f"column_{i}" for i, c in enumerate(sheet.filter("row_idx = 0").first()["cells"])]
    return sheet.filter("row_idx > 0").selectExpr(*[f"get(cells, {i}) AS `{name}`" for i, name in enumerate(head)])


def write_workbook(tables: dict[str, DataFrame], path: str, most_rows: int = 100_000) -> None:
    """One sheet per table, all values as text; a table with more than ``most_rows`` rows is refused."""
    names = list(tables)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, n in enumerate(names):
            rows = tables[n].limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"table {n!r} has more than {most_rows} rows; write it as Parquet")
            body = []
            for k, row in enumerate([tables[n].columns, *rows]):
                cells = "".join(f'<c r="{column_name(j)}{k + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for j, v in enumerate(row) if v is not None)
                body.append(f'<row r="{k + 1}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(body)}</sheetData></worksheet>')

"""Workbooks of sheets: pools and cluster reports as xlsx files, one for each selection date.

Files are read by Spark's scan of binary files, so from any store that Spark reads, and
taken apart in the tasks, a file a row. They are written a file a group, under a name of
their own first and then moved, so a task that runs again leaves one whole file. A
workbook holds one selection, so a group is of the size of a pool.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the format (fixed values).
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Sheets of a cluster report (fixed values of the reports).
POOL_SHEET, CORRELATION_SHEET, DETAIL_SHEET = "动态指数池", "相关性矩阵", "聚类明细"

_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def column_name(k: int) -> str:
    """A, B, …, Z, AA, … of the column k from 0."""
    name = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        name = chr(65 + rest) + name
    return name


def column_number(name: str) -> int:
    k = 0
    for c in name:
        k = k * 26 + ord(c) - 64
    return k - 1


def _sheet_xml(rows: Iterable[Sequence[str | None]], numeric: Sequence[bool]) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="', MAIN[1:-1], '"><sheetData>']
    for i, row in enumerate(rows, 1):
        out.append(f'<row r="{i}">')
        for j, value in enumerate(row):
            if value is None:
                continue
            at = f"{column_name(j)}{i}"
            if i > 1 and numeric[j]:
                out.append(f'<c r="{at}"><v>{value}</v></c>')
            else:
                out.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", value))}</t></is></c>')
        out.append("</row>")
    out.append("</sheetData></worksheet>")
    return "".join(out)


def workbook_bytes(sheets: Sequence[tuple[str, Sequence[Sequence[str | None]], Sequence[bool]]]) -> bytes:
    """A workbook of (name, rows with the header first, which columns are numbers)."""
    n = range(1, len(sheets) + 1)
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{SHEET_TYPE}.worksheet+xml"/>' for k in n)
    names = "".join(f'<sheet name="{escape(s[0], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, sheets, strict=True))
    links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{SHEET_TYPE}.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
    }
    parts |= {f"xl/worksheets/sheet{k}.xml": _sheet_xml(s[1], s[2]) for k, s in zip(n, sheets, strict=True)}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return data.getvalue()


def sheet_rows(data: bytes, sheet: str) -> list[list[str | None]]:
    """The cells of a sheet as text, row by row; a workbook without the sheet is a ValueError."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        found = [s.get(LINK) for s in book.iter(f"{MAIN}sheet") if s.get("name") == sheet]
        if not found:
            raise ValueError(f"no sheet {sheet}")
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(x.get("Target") for x in links if x.get("Id") == found[0])
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        page = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in page.iter(f"{MAIN}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{MAIN}c"):
            at = re.match("[A-Z]+", c.get("r") or "")
            k = column_number(at[0]) if at else len(cells)
            cells += [None] * (k + 1 - len(cells))
            kind, v = c.get("t"), c.find(f"{MAIN}v")
            if kind == "inlineStr":
                cells[k] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            elif v is not None and v.text is not None:
                cells[k] = shared[int(v.text)] if kind == "s" else v.text
        rows.append(cells)
    return rows


def scan_workbooks(spark: SparkSession, folder: str, sheet: str, columns: Sequence[str]) -> DataFrame:
    """(file, row, columns…) as text: the named columns of a sheet of every xlsx file of one folder (not of folders in it).

    A column that a file lacks is null; a file without the sheet fails the query."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", False).load(folder).select("path", "content")
    wanted = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(content, sheet)
                head = {h: k for k, h in enumerate(rows[0] if rows else []) if h is not None}
                body = [[i, *[r[head[c]] if c in head and head[c] < len(r) else None for c in wanted]] for i, r in enumerate(rows[1:], 1)]
                out = pd.DataFrame(body, columns=["row", *wanted])
                out.insert(0, "file", path.rsplit("/", 1)[-1])
                yield out

    return raw.mapInPandas(run, ", ".join(["file string", "row int", *[f"`{c}` string" for c in wanted]]))


@dataclass(frozen=True)
class Sheet:
    """A sheet of many workbooks: df has ``file``, which names the workbook, and the sheet's columns; rows are in the order of ``order``."""

    name: str
    df: DataFrame
    order: tuple[str, ...]


def write_workbooks(sheets: Sequence[Sheet], folder: str) -> DataFrame:
    """(file, n_rows, n_bytes) of the workbooks written to the folder, a group of rows each."""
    parts, plan = None, []
    for k, s in enumerate(sheets):
        columns = [c for c in s.df.columns if c != "file"]
        types = dict(s.df.dtypes)
        plan.append((s.name, columns, [types[c].split("(")[0] in ("double", "float", "int", "bigint", "decimal", "smallint", "tinyint") for c in columns]))
        row = F.row_number().over(Window.partitionBy("file").orderBy(*s.order))
        one = s.df.select("file", F.lit(k).alias("sheet"), row.alias("row"), F.array(*[F.col(f"`{c}`").cast("string") for c in columns]).alias("cells"))
        parts = one if parts is None else parts.unionByName(one)

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        group = group.sort_values(["sheet", "row"])
        made = [(name, [columns, *[list(c) for c in group.cells[group.sheet == k]]], numeric) for k, (name, columns, numeric) in enumerate(plan)]
        data = workbook_bytes(made)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{keys[0]}.part") as out:
            out.write(data)
        store.move(f"{root}/.{keys[0]}.part", f"{root}/{keys[0]}")
        return pd.DataFrame([(keys[0], len(group), len(data))], columns=["file", "n_rows", "n_bytes"])

    return parts.groupBy("file").applyInPandas(run, "file string, n_rows long, n_bytes long")

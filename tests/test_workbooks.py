"""Workbooks: cells, many sheets and files, odd texts, what other programs write."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.sources import workbook


def test_column_names():
    assert [workbook.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook.column_number(workbook.column_name(k)) == k for k in range(3000))


def test_cells_come_back():
    rows = [["代码", "x", "空"], ["510001.SH", "1.5", None], [' a <b> & "c" ', "-2e-07", "\n"], [None, None, None], ["\x01z", "7", "é"]]
    data = workbook.workbook_bytes([("一", rows, [False, True, False]), ('b "&', [["h"]], [False])])
    got = workbook.sheet_rows(data, "一")
    assert got[:3] == [rows[0], rows[1][:2], rows[2]] and got[3] == [] and got[4] == ["z", "7", "é"]
    assert workbook.sheet_rows(data, 'b "&') == [["h"]]
    with pytest.raises(ValueError):
        workbook.sheet_rows(data, "none")


def test_shared_strings_and_gaps():
    """As other programs write: shared strings in runs, cells left out, absolute targets."""
    main = workbook.MAIN[1:-1]
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{workbook.OFFICE}"><sheets><sheet name="S" sheetId="1" r:id="r9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{workbook.PACKAGE}/relationships"><Relationship Id="r9" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="C2"><v>4.25</v></c></row></sheetData></worksheet>',
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    assert workbook.sheet_rows(data.getvalue(), "S") == [["one", None, "two"], [None, None, "4.25"]]


def test_folder_of_workbooks(spark, tmp_path):
    rows = [(f"2021_0{m}_28.xlsx", f"I{i}", i * 1.25, None if i == 2 else "n") for m in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "file string, code string, value double, note string").repartition(3)
    corr = df.select("file", "code", (F.col("value") / 10).alias("corr"))
    folder = f"file://{tmp_path}/books"
    sheets = [workbook.Sheet(workbook.POOL_SHEET, df, ("code",)), workbook.Sheet(workbook.CORRELATION_SHEET, corr, ("code",)), workbook.Sheet(workbook.DETAIL_SHEET, df.where("value > 1").drop("note"), ("code",))]
    assert {r.n_rows for r in workbook.write_workbooks(sheets, folder).collect()} == {4 + 4 + 3}
    (tmp_path / "books" / "deeper").mkdir()
    (tmp_path / "books" / "deeper" / "x.xlsx").write_bytes(b"no workbook")
    (tmp_path / "books" / "x.txt").write_bytes(b"no workbook")
    got = workbook.scan_workbooks(spark, folder, workbook.POOL_SHEET, ("code", "note", "value", "absent"))
    assert sorted(str((r.file, r.code, float(r.value), r.note, r.absent)) for r in got.collect()) == sorted(str((f, c, v, n, None)) for f, c, v, n in rows)
    assert [r.row for r in got.where("file = '2021_01_28.xlsx'").orderBy("code").collect()] == [1, 2, 3, 4]
    assert workbook.scan_workbooks(spark, folder, workbook.DETAIL_SHEET, ("code",)).count() == 9


def test_fifteen_digits(spark):
    dice = random.Random(1)
    values = [0.0, 1.0, -1.5, 100.0, 123456789012345.0, 1234567890123456.0, 1e15, 999999999999999.9, 0.1 + 0.2, 1 / 3, 1e-4, 9.9e-5, -2.5e-10, 1e300, 12.5, 120.0]
    values += [dice.uniform(-1, 1) * 10 ** dice.randint(-8, 18) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalars.fifteen_digits(F.col("x")).alias("t")).collect()
    # a shortest text of 16 digits that ends in 5 is a tie, which is rounded up
    assert all(r.t == f"{r.x:.15g}" or float(r.t) == pytest.approx(r.x, rel=1e-14) for r in got)
    assert sum(r.t == f"{r.x:.15g}" for r in got) > 0.95 * len(got)

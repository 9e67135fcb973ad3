"""Workbooks read by row ranges and written by tasks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from abaculus.sources import cells, workbooks

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def shared_book(path, rows=300):
    """Shared texts, one of them in two runs, a date format, no references in some cells, and no extent."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="一" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">' + "".join(f"<si><r><t>text </t></r><r><t>{n}</t></r></si>" for n in range(rows)) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        body = "".join(f'<row r="{n + 1}"><c r="A{n + 1}" t="s"><v>{rows - 1 - n}</v></c><c s="1"><v>{45000 + n}</v></c><c r="AB{n + 1}"/></row>' for n in range(rows))
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{NS}"><sheetData>{body}</sheetData></worksheet>')


def test_shared_texts_dates_and_ranges(spark, tmp_path):
    shared_book(tmp_path / "a.xlsx")
    (tmp_path / "~$a.xlsx").write_bytes(b"x")
    all_cells = {(r.sheet, r.row, r.col): r.value for r in workbooks.read_workbooks(spark, str(tmp_path), rows=64).collect()}
    assert len(all_cells) == 600 and all_cells["一", 1, 1] == "text 299" and all_cells["一", 1, 2] == "2023-03-15" and all_cells["一", 300, 1] == "text 0"
    some = workbooks.read_workbooks(spark, str(tmp_path), first_row=10, last_row=12, columns=[1]).collect()
    assert [(r.row, r.col, r.value) for r in some] == [(10, 1, "text 290"), (11, 1, "text 289"), (12, 1, "text 288")]
    assert workbooks.read_workbooks(spark, str(tmp_path), sheets=["none"]).count() == 0
    content = (tmp_path / "a.xlsx").read_bytes()
    assert {(s, r, c): v for s, r, c, v in cells.xlsx_cells(content)} == all_cells


def test_written_cells_come_back_in_ranges(spark, tmp_path):
    data = spark.range(2500).select(
        F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.concat(F.lit('s "<&'), F.col("id") % 3).alias("sheet"), (F.col("id") + 1).cast("int").alias("row"), F.lit(28).alias("col"),
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("<t> & "), F.col("id"))).when(F.col("id") % 5 == 1, F.lit("007")).when(F.col("id") % 5 == 2, F.lit(" lead ")).otherwise((F.col("id") / 4).cast("decimal(10,2)").cast("string")).alias("value"),
    )
    folder = str(tmp_path / "out")
    workbooks.write_cells(data, folder)
    got = workbooks.read_workbooks(spark, folder, rows=100)
    assert got.rdd.getNumPartitions() == 150  # six sheets in ranges of 100 rows
    key = lambda df: sorted((r.sheet, r.row, r.col, r.value) for r in df.collect())
    assert key(got) == key(data)
    assert {r.file.rsplit("/", 1)[1] for r in got.select("file").distinct().collect()} == {"f0.xlsx", "f1.xlsx"}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".part")]


def test_broken_files_and_no_files(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04 no archive")
    shared_book(tmp_path / "good.xlsx", 3)
    with pytest.raises(Exception, match="zip"):
        workbooks.read_workbooks(spark, str(tmp_path)).count()
    assert workbooks.read_workbooks(spark, str(tmp_path), ignore_broken=True).count() == 6
    (tmp_path / "none").mkdir()
    assert workbooks.read_workbooks(spark, str(tmp_path / "none")).count() == 0


def test_report_has_a_sheet_for_each_table(spark, tmp_path):
    a, b = spark.createDataFrame([(2, "y"), (1, None)], "k int, v string"), spark.createDataFrame([], "z string")
    workbooks.write_report({"first": (a, [F.col("k")]), "second": (b, [F.col("z")])}, str(tmp_path / "r"), "report.xlsx")
    got = sorted((r.sheet, r.row, r.col, r.value) for r in workbooks.read_workbooks(spark, str(tmp_path / "r")).collect())
    assert got == [("first", 1, 1, "k"), ("first", 1, 2, "v"), ("first", 2, 1, "1"), ("first", 3, 1, "2"), ("first", 3, 2, "y"), ("second", 1, 1, "z")]


def test_small_sheets_share_slices_of_the_directory(spark, tmp_path, monkeypatch):
    """Planning opens no sheet that can't be large, and a partition holds few sheets' names; all cells come back, from archives with wide fields too."""
    data = spark.range(3000).select(F.lit("f").alias("file"), F.concat(F.lit("s"), F.col("id") % 700).alias("sheet"), (F.floor(F.col("id") / 700) + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.concat(F.lit("v"), "id").alias("value"))
    folder = str(tmp_path / "out")
    workbooks.write_cells(data, folder)
    reader = workbooks.WorkbookReader({"path": folder, "rows": "500"})
    opened, plain = [], workbooks.Workbook.extent
    monkeypatch.setattr(workbooks.Workbook, "extent", lambda self, member: opened.append(member) or plain(self, member))
    assert [p.ranges for p in reader.partitions()] == [[]] and not opened
    monkeypatch.setattr(workbooks, "PACK", 10_000)
    planned = reader.partitions()
    assert len(planned) > 5 and not opened
    got = [r for p in planned for b in reader.read(p) for r in b.drop_columns("file").to_pylist()]
    want = [r.asDict() for r in data.drop("file").collect()]
    key = lambda r: tuple(r.values())
    assert sorted(map(key, got)) == sorted(map(key, want))
    monkeypatch.undo()
    with zipfile.ZipFile(f"{folder}/f.xlsx") as z, open(f"{folder}/f.xlsx", "rb") as stream:
        first, last, off = workbooks.directory(stream)
        assert [(m.filename, m.file_size, m.compress_size, m.header_offset) for _, m in workbooks.members(stream, first, last, off)] == [(m.filename, m.file_size, m.compress_size, m.header_offset) for m in z.infolist()]


def test_sheets_of_one_workbook_are_packed_by_several_tasks(spark, tmp_path):
    """No task holds a whole workbook's cells: its sheets are dealt out, then copied packed; the archive is sound and lists them by name."""
    data = spark.range(6000).select(F.lit("f").alias("file"), F.concat(F.lit("s"), F.lpad((F.col("id") % 40).cast("string"), 2, "0")).alias("sheet"), (F.floor(F.col("id") / 40) + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.concat(F.lit("<&v"), "id").alias("value"))
    seen, plain = tmp_path / "seen", workbooks.packed_sheets
    seen.mkdir()

    def watched(batches, parts):
        for batch in plain(batches, parts):
            for name in batch.column("part").unique().to_pylist():
                (seen / name.rsplit("/", 1)[1]).touch()
            yield batch

    workbooks.packed_sheets = watched
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        workbooks.write_cells(data, str(tmp_path / "out"))
    finally:
        workbooks.packed_sheets = plain
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["f.xlsx"]
    with zipfile.ZipFile(tmp_path / "out" / "f.xlsx") as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist())) == 44
        listed = z.read("xl/workbook.xml").decode()
    places = [listed.index(f'name="s{n:02d}"') for n in range(40)]
    assert places == sorted(places)
    key = lambda df: sorted((r.sheet, r.row, r.col, r.value) for r in df.collect())
    assert key(workbooks.read_workbooks(spark, str(tmp_path / "out"))) == key(data)
    assert len(list(seen.iterdir())) > 1

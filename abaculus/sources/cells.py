"""Files that Spark has read, as cells (file, sheet, row, col, value), decoded by tasks.

Workbooks that need no other reader are better read by ``workbooks``, which opens them by range.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abaculus.schema import CELLS
from abaculus.session import ship_package
from abaculus.sources.workbooks import Workbook, texts

def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Non-empty cells of all sheets as text; numbers in date formats become dates."""
    book = Workbook(io.BytesIO(content))
    dates = book.date_styles()
    for sheet, member, _ in book.sheets():
        numbers = {int(value) for _, cells in book.rows(member) for _, value, kind, _ in cells if kind == "s"}
        for cell in texts(book.rows(member), book.shared_texts(numbers), dates):
            yield sheet, *cell


def csv_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Cells of a text table in UTF-8 or GBK; the separator is the more frequent of comma, semicolon and tab in its head."""
    for encoding in ("utf-8-sig", "gbk"):
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = content.decode("utf-8", "replace")
    separator = max(",;\t", key=text[:4096].count)
    for r, row in enumerate(csv.reader(io.StringIO(text), delimiter=separator), 1):
        for c, value in enumerate(row, 1):
            if value != "":
                yield "csv", r, c, value


def read_cells(files: DataFrame) -> DataFrame:
    """Cells of all files (path, content, format). Files of other formats need an optional reader and give no cells."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, kind in zip(batch["path"], batch["content"], batch["format"]):
                read = {"xlsx": xlsx_cells, "xlsm": xlsx_cells, "csv": csv_cells}.get(kind)
                for some in batched(read(bytes(content)), 10_000) if read else ():
                    yield pd.DataFrame([(path, *cell) for cell in some], columns=["file", "sheet", "row", "col", "value"])

    return files.select("path", "content", "format").mapInPandas(run, CELLS)


def effective_rows(cells: DataFrame, blank_run: int = 10) -> DataFrame:
    """Cells above the first run of ``blank_run`` blank rows of their sheet; blanks don't count, zeros do."""
    filled = cells.where(F.trim("value") != "").select("file", "sheet", "row").distinct()
    each = Window.partitionBy("file", "sheet").orderBy("row")
    gaps = filled.withColumn("gap", F.col("row") - F.coalesce(F.lag("row").over(each), F.lit(0)) > blank_run)
    ends = gaps.where("gap").groupBy("file", "sheet").agg(F.min("row").alias("end"))
    return cells.join(ends, ["file", "sheet"], "left").where(F.col("end").isNull() | (F.col("row") < F.col("end"))).drop("end")

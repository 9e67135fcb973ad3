"""Workbooks as a Spark data source: cells read by row range, and written, one workbook after the other.

    register(spark)
    spark.read.format("workbook").option("rows", 50_000).load(folder)        # (file, sheet, row, col, value)
    write_cells(cells, folder)                                               # a workbook per value of ``file``

A scan has a partition per sheet and range of ``rows`` rows; small sheets share one, of up to ``PACK`` bytes. Planning streams
each archive's directory and opens only sheets that may hold more than ``rows`` rows, so what the driver holds doesn't grow with
the number of sheets; a task gets a slice of the directory and looks up the names of its own sheets. What it opens is read by range. Rows are parsed as a stream, leave in batches of ``chunk`` cells, and are forgotten. Sheets, columns and a range of rows are
asked for by options of the scan (a filter pushed down to a Python source would hold for all scans of the same
relation): other sheets and ranges get no partition, other columns aren't kept, and a task ends behind its last row. Shared texts are gone through once per task; only those are kept whose number stands
in the range. So a task holds what its own range refers to, whatever the size of the workbook.

Writing deals cells out by sheet: tasks compress their sheets into parts, and a task per workbook then joins the packed sheets
as bytes. So a task holds cells of single sheets, which the format bounds, and of a workbook only the names of its sheets.

Defined results: empty cells give no rows; numbers in date formats become dates; a workbook without sheets gives
no rows; files that are no archives fail the job, or are left out with ``ignoreBroken``.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from itertools import batched, groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from abaculus.operators.numbering import numbered
from abaculus.schema import CELLS
from abaculus.session import ship_package

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The format numbers of dates and times in workbooks.
DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57))
#: Fixed value: the most rows that a sheet can have.
SHEET_ROWS = 1_048_576
ROWS, CHUNK = 50_000, 4000
#: Bytes of small sheets, not compressed, that share a partition.
PACK = 32 << 20
#: Fixed value: the fewest bytes of a row with a cell, <row><c><v>1</v></c></row>.
ROW_BYTES = 27
#: Parts of a workbook that readers of any sheet need.
PARTS = frozenset(("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml"))
SCHEMA = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:/", path) else f"file://{path}")


@dataclass
class Ranges(InputPartition):
    """Of a workbook ranges of rows of large sheets, as (sheet, member, first, last), or the sheets in a slice of its
    directory; and the places in the directory of the other members that are needed."""

    file: str
    places: list[int]
    ranges: list[tuple[str, str, int, int]]
    slice: tuple[int, int] | None = None

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Wanted:
    """What a scan is asked for: rows from first to last, and the sheets and columns (None: all)."""

    first: int = 1
    last: int = SHEET_ROWS
    sheets: frozenset | None = None
    columns: frozenset | None = None

    @classmethod
    def of(cls, options: dict) -> Wanted:
        listed = lambda name, kind: frozenset(map(kind, json.loads(options[name]))) if name in options else None
        return cls(int(options.get("firstrow", 1)), min(int(options.get("lastrow", SHEET_ROWS)), SHEET_ROWS), listed("sheets", str), listed("columns", int))


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    return column_letters((n - 1) // 26) + chr(65 + (n - 1) % 26) if n else ""


class _Archive(zipfile.ZipFile):
    """An archive of which only the members that are added are known."""

    def _RealGetContents(self):
        pass

    def add(self, member: zipfile.ZipInfo) -> None:
        self.NameToInfo[member.filename] = member


def directory(stream) -> tuple[int, int, int]:
    """Start and end of an archive's directory, and how far the places given in it are off."""
    size = stream.seek(0, 2)
    first = max(0, size - 65_557 - 76)
    stream.seek(first)
    tail = stream.read(size - first)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise zipfile.BadZipFile("no directory")
    (length, offset), end = struct.unpack("<II", tail[at + 12 : at + 20]), first + at
    if 0xFFFFFFFF in (length, offset) or tail[at + 10 : at + 12] == b"\xff\xff":
        if tail[at - 20 : at - 16] == b"PK\x06\x07":
            end = first + at - 20 - 56
            stream.seek(end)
            length, offset = struct.unpack("<QQ", stream.read(56)[40:])
    if end < length:
        raise zipfile.BadZipFile("no directory")
    return end - length, end, end - length - offset


def members(stream, first: int, last: int, off: int, one: bool = False) -> Iterator[tuple[int, zipfile.ZipInfo]]:
    """(place in the directory, member) of a slice of it, read as a stream; or only the first one."""
    held, at, end = b"", 0, first  # what has been read of the directory, up to ``end``
    while (place := end - len(held) + at) < last:
        if len(held) - at < 1 << 18 and end < last:
            stream.seek(end)
            more = stream.read(min(last - end, 1 << 12 if one else 1 << 20))
            held, at, end = held[at:] + more, 0, end + len(more)
            if not more:
                raise zipfile.BadZipFile("short directory")
            continue
        flags, method, crc, packed, plain, n, m, k, offset = struct.unpack("<HH4xIIIHHH8xI", held[at + 8 : at + 46])
        raw, extra = held[at + 46 : at + 46 + n], held[at + 46 + n : at + 46 + n + m]
        found = zipfile.ZipInfo(raw.decode("utf-8" if flags & 0x800 else "cp437"))
        while len(extra) >= 4:  # sizes and places beyond 32 bits
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                plain, packed, offset = (next(wide, v) if v == 0xFFFFFFFF else v for v in (plain, packed, offset))
            extra = extra[4 + length :]
        found.flag_bits, found.compress_type, found.CRC, found.compress_size, found.file_size, found.header_offset = flags, method, crc, packed, plain, offset + off
        yield place, found
        if one:
            return
        at += 46 + n + m + k


class Workbook:
    """An open archive: its sheets, and the rows of one of them as a stream. Of its members all are known, or those at
    ``places`` and in a slice of the directory."""

    def __init__(self, stream, places: list[int] | None = None, slice: tuple[int, int] | None = None):
        first, last, off = directory(stream)
        self.zip, self.small = _Archive(stream), set()
        for _, member in members(stream, *((first, last) if places is None else slice or (0, 0)), off):
            self.zip.add(member)
            self.small.add(member.filename)
        for place in places or ():
            self.zip.add(next(members(stream, place, last, off, True))[1])
        self.names = self.zip.NameToInfo.keys()

    def named(self, wanted: set[str]) -> Iterator[tuple[str, str]]:
        """(name, member) of the sheets that these members hold; the lists are gone through as streams."""
        if "xl/workbook.xml" not in self.names:
            return
        targets = {}
        with self.zip.open("xl/_rels/workbook.xml.rels") as stream:
            for r in _elements(stream, "}Relationship"):
                target = r.get("Target")
                member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if member in wanted:
                    targets[r.get("Id")] = member
        with self.zip.open("xl/workbook.xml") as stream:
            for sheet in _elements(stream, f"{MAIN}sheet"):
                if member := targets.get(sheet.get(LINK)):
                    yield sheet.get("name"), member

    def extent(self, member: str) -> int:
        """The last row as far as the sheet tells, else the most that there can be."""
        with self.zip.open(member) as head:
            found = re.search(rb'<dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', head.read(4096))
        return int(found[1]) if found else SHEET_ROWS

    def sheets(self) -> Iterator[tuple[str, str, int]]:
        """(name, member, last row) of all known sheets."""
        for sheet, member in self.named(set(self.names)):
            yield sheet, member, self.extent(member)

    def date_styles(self) -> list[bool]:
        if "xl/styles.xml" not in self.names:
            return []
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {f.get("numFmtId") for f in styles.iter(f"{MAIN}numFmt") if re.search("[ymd]", f.get("formatCode", ""), re.I)}
        return [x.get("numFmtId") in own or int(x.get("numFmtId", 0)) in DATE_FORMATS for x in styles.iterfind(f"{MAIN}cellXfs/{MAIN}xf")]

    def shared_texts(self, numbers: set[int]) -> dict[int, str]:
        """The shared texts with these numbers."""
        found: dict[int, str] = {}
        if not numbers or "xl/sharedStrings.xml" not in self.names:
            return found
        n, last = 0, max(numbers)
        with self.zip.open("xl/sharedStrings.xml") as stream:
            for text in _elements(stream, f"{MAIN}si"):
                if n in numbers:
                    found[n] = "".join(t.text or "" for t in text.iter(f"{MAIN}t"))
                if n == last:
                    break
                n += 1
        return found

    def rows(self, member: str, first: int = 1, last: int = SHEET_ROWS, columns: frozenset | None = None) -> Iterator[tuple[int, list[tuple[int, str, str | None, int]]]]:
        """(row, [(column, raw value, kind, style)]) from ``first`` to ``last``."""
        before = 0
        with self.zip.open(member) as stream:
            for element in _elements(stream, f"{MAIN}row"):
                row = before = int(element.get("r", before + 1))
                if row > last:
                    return
                if row < first:
                    continue
                cells, col = [], 0
                for c in element.iterfind(f"{MAIN}c"):
                    place = re.match(r"[A-Z]+", c.get("r", ""))
                    col = column_number(place[0]) if place else col + 1
                    if columns is None or col in columns:
                        kind = c.get("t")
                        value = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else c.findtext(f"{MAIN}v")
                        if value not in (None, ""):
                            cells.append((col, value, kind, int(c.get("s", 0))))
                yield row, cells


def _elements(stream, tag: str) -> Iterator[ElementTree.Element]:
    """The elements with this tag; what has been given is forgotten."""
    parents: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if element.tag == tag or (tag[0] == "}" and element.tag.endswith(tag)):
            yield element
            if parents:
                parents[-1].clear()


def texts(rows: Iterable, strings: dict[int, str], dates: list[bool]) -> Iterator[tuple[int, int, str]]:
    for row, cells in rows:
        for col, value, kind, style in cells:
            if kind == "s":
                value = strings.get(int(value), "")
            elif kind in (None, "n") and style < len(dates) and dates[style]:
                value = (datetime(1899, 12, 30) + timedelta(days=float(value))).isoformat(" ", "seconds").removesuffix(" 00:00:00")
            if value:
                yield row, col, value


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.chunk = options["path"], int(options.get("rows", ROWS)), int(options.get("chunk", CHUNK))
        self.broken = options.get("ignorebroken", "false").lower() == "true"
        self.wanted = Wanted.of(options)

    def _files(self) -> list[str]:
        store, path = _store(self.path)
        listed = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        return sorted(f.path for f in listed if f.type == fs.FileType.File and re.search(r"(?i)\.(xlsx|xlsm)$", f.path) and not f.base_name.startswith("~$"))

    def _ranges(self, file: str) -> list[Ranges]:
        """The ranges asked for, each a partition; the directory's slices of small sheets, of up to ``PACK`` bytes; those of
        large sheets' rests share a partition of up to ``rows`` rows."""
        want, out, free = self.wanted, [], 0
        try:
            with _store(self.path)[0].open_input_file(file) as stream:
                first, last, off = directory(stream)
                parts, large, starts, held = [], {}, [], PACK + 1
                for place, member in members(stream, first, last, off):
                    if member.filename in PARTS:
                        parts.append(place)
                    elif member.file_size > self.size * ROW_BYTES:
                        large[member.filename] = place
                    elif not member.filename.endswith((".rels", "[Content_Types].xml")):
                        if held > PACK:
                            starts.append(place)
                            held = 0
                        held += member.file_size
                out = [Ranges(file, parts, [], ends) for ends in zip(starts, [*starts[1:], last])]
                book = Workbook(stream, parts + list(large.values()))
                for sheet, member in book.named(set(large)) if large else ():
                    if want.sheets is not None and sheet not in want.sheets:
                        continue
                    rows = book.extent(member)
                    step = self.size if rows < SHEET_ROWS else SHEET_ROWS  # a sheet that doesn't tell its extent is read as a whole
                    to = min(rows, want.last)
                    for start in range(want.first, to + 1, step):
                        n = min(to, start + step - 1) - start + 1
                        if n > free:
                            out.append(Ranges(file, list(parts), []))
                            free = self.size
                        out[-1].places = [*out[-1].places, large[member]]
                        out[-1].ranges.append((sheet, member, start, start + n - 1))
                        free -= n
        except (zipfile.BadZipFile, pa.ArrowInvalid) as e:  # the latter: too short to hold a directory
            if not self.broken:
                raise zipfile.BadZipFile(f"{file} is no zip archive") from e
        return out

    def partitions(self) -> list[Ranges]:
        with ThreadPoolExecutor(16) as pool:  # directories only; bounded by the number of workbooks, as with any listing
            return [r for found in pool.map(self._ranges, self._files()) for r in found]

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no partitions
            return
        columns = self.wanted.columns
        with _store(self.path)[0].open_input_file(partition.file) as stream:
            book, want = Workbook(stream, partition.places, partition.slice), self.wanted
            dates, strings, ranges = book.date_styles(), {}, partition.ranges
            if partition.slice:
                small = {m for m in book.small if m not in PARTS and book.zip.getinfo(m).file_size <= self.size * ROW_BYTES}
                ranges = [(sheet, member, want.first, want.last) for sheet, member in book.named(small) if want.sheets is None or sheet in want.sheets]
            if "xl/sharedStrings.xml" in book.names:
                strings = book.shared_texts({int(value) for _, member, first, last in ranges for _, cells in book.rows(member, first, last, columns) for _, value, kind, _ in cells if kind == "s"})
            cells = ((sheet, *cell) for sheet, member, first, last in ranges for cell in texts(book.rows(member, first, last, columns), strings, dates))
            for some in batched(cells, self.chunk):
                sheet, row, col, value = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(some)), pa.array(sheet), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(value)], schema=SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (part under the attempt's name, final name)."""

    files: list


class WorkbookWriter(DataSourceArrowWriter):
    """Packed sheets in order of file and part, as ``packed_sheets`` gives them; a workbook goes out as its sheets are copied."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.parts = options["path"], options["parts"]
        if overwrite:
            store, path = _store(self.path)
            store.create_dir(path, recursive=True)
            store.delete_dir_contents(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        attempt, out = TaskContext.get().taskAttemptId(), []
        sheets = (tuple(c.values()) for batch in batches for c in batch.select(["file", "sheet", "part", "at", "crc", "packed", "plain"]).to_pylist())
        for file, of_file in groupby(sheets, lambda c: c[0]):
            name = re.sub(r"[/\\]", "_", file or "")
            name = name if name.lower().endswith((".xlsx", ".xlsm")) else f"{name}.xlsx"
            part = f"{folder}/.{name}.{attempt}.part"
            with store.open_output_stream(part) as stream:
                write_workbook(stream, (c[1:] for c in of_file), store)
            out.append((part, f"{folder}/{name}"))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for part, name in m.files if m else ():
                store.move(part, name)
        self._forget_parts()

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                if store.get_file_info(part).type == fs.FileType.File:
                    store.delete_file(part)
        self._forget_parts()

    def _forget_parts(self) -> None:
        store, parts = _store(self.parts)
        if store.get_file_info(parts).type == fs.FileType.Directory:
            store.delete_dir(parts)


NUMBER = re.compile(r"-?(0|[1-9]\d{0,14})(\.\d{1,6})?$")


class _Forward(io.RawIOBase):
    """A stream that an archive can be written to without going back."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def sheet_xml(last_row: int, last_col: int, cells: Iterable[tuple[int, int, str]]) -> Iterator[bytes]:
    """A sheet of cells (row, column, value) in order; plain decimal numbers become numbers, others text. It tells its extent
    first, so that readers can deal out its rows."""
    yield b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    yield f'<dimension ref="A1:{column_letters(last_col)}{last_row}"/><sheetData>'.encode()
    for row, of_row in groupby(cells, lambda c: c[0]):
        line = [f'<row r="{row}">']
        for _, col, value in of_row:
            place = f"{column_letters(col)}{row}"
            line.append(f'<c r="{place}"><v>{value}</v></c>' if NUMBER.match(value or "") else f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(value or "")}</t></is></c>')
        yield "".join([*line, "</row>"]).encode()
    yield b"</sheetData></worksheet>"


def packed_sheets(batches: Iterator[pa.RecordBatch], parts: str) -> Iterator[pa.RecordBatch]:
    """Pack the sheets of a task's cells, in order of file, sheet, row and column, into a file of each workbook's below ``parts``;
    tells of every sheet the part and its place in it, its CRC and its bytes, packed and plain."""
    from pyspark import TaskContext

    store, folder = _store(parts)
    store.create_dir(folder, recursive=True)
    attempt, schema = TaskContext.get().taskAttemptId(), pa.schema([("file", pa.string()), ("sheet", pa.string()), ("part", pa.string()), *[(c, pa.int64()) for c in ("at", "crc", "packed", "plain")]])
    cells = (tuple(c.values()) for batch in batches for c in batch.select(["file", "sheet", "row", "col", "value", "last_row", "last_col"]).to_pylist())
    for n, (file, of_file) in enumerate(groupby(cells, lambda c: c[0])):
        part, out = f"{folder}/{attempt}-{n}.part", []
        with store.open_output_stream(part) as stream:
            at = 0
            for (sheet, *extent), of_sheet in groupby(of_file, lambda c: (c[1], *c[5:])):
                packer, crc, packed, plain = zlib.compressobj(wbits=-15), 0, 0, 0
                for xml in sheet_xml(*extent, (c[2:5] for c in of_sheet)):
                    crc, plain = zlib.crc32(xml, crc), plain + len(xml)
                    packed += stream.write(packer.compress(xml))
                packed += stream.write(packer.flush())
                out.append((file, sheet, part, at, crc, packed, plain))
                at += packed
        for some in batched(out, 10_000):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in some], schema=schema)


def write_workbook(stream, sheets: Iterable[tuple[str, str, int, int, int, int]], store: fs.FileSystem) -> None:
    """A workbook of packed sheets (name, part, place, CRC, packed and plain bytes), which are copied as they are; it lists them by name."""
    names = []
    with zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_DEFLATED) as z:
        for part, of_part in groupby(sheets, lambda c: c[1]):
            with store.open_input_file(part) as source:
                for sheet, _, at, crc, packed, plain in of_part:
                    names.append(sheet)
                    member = zipfile.ZipInfo(f"xl/worksheets/sheet{len(names)}.xml")
                    member.compress_type, member.CRC, member.compress_size, member.file_size, member.header_offset = zipfile.ZIP_DEFLATED, crc, packed, plain, z.fp.tell()
                    z.fp.write(member.FileHeader())
                    for first in range(at, at + packed, 1 << 20):
                        z.fp.write(source.read_at(min(1 << 20, at + packed - first), first))
                    z.filelist.append(member)
                    z.NameToInfo[member.filename] = member
                    z.start_dir = z.fp.tell()
        part = '<Override PartName="/xl/{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{}+xml"/>'
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + part.format("workbook", "sheet.main") + "".join(part.format(f"worksheets/sheet{n}", "worksheet") for n in range(1, len(names) + 1)) + "</Types>")
        relation = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
        wrap = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
        z.writestr("_rels/.rels", wrap.format(relation.format(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", wrap.format("".join(relation.format(n, "worksheet", f"worksheets/sheet{n}.xml") for n in range(1, len(names) + 1))))
        entries = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>' for name, n in sorted((name or "", n) for n, name in enumerate(names, 1)))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{entries}</sheets></workbook>')


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(WorkbookSource)


def read_workbooks(spark: SparkSession, path: str, rows: int = ROWS, first_row: int = 1, last_row: int = SHEET_ROWS, columns: list[int] | None = None, sheets: list[str] | None = None, ignore_broken: bool = False) -> DataFrame:
    """Cells of all workbooks below ``path``: rows ``first_row`` to ``last_row`` of these columns and sheets (None: all)."""
    register(spark)
    asked = {"columns": columns, "sheets": sheets}
    reader = spark.read.format("workbook").options(rows=rows, firstRow=first_row, lastRow=last_row, ignoreBroken=ignore_broken)
    return reader.options(**{k: json.dumps(v) for k, v in asked.items() if v is not None}).load(path)


def write_cells(cells: DataFrame, folder: str, mode: str = "append") -> None:
    """A workbook for each value of ``file`` below ``folder``, with a sheet for each of its sheets; one shuffle of the cells, by
    sheet, and one of a row per sheet, by file."""
    register(cells.sparkSession)
    sheet, parts = Window.partitionBy("file", "sheet"), f"{folder}/.parts-{uuid.uuid4().hex}"
    dealt = cells.select("file", "sheet", "row", "col", "value").repartition("file", "sheet").withColumns({"last_row": F.max("row").over(sheet), "last_col": F.max("col").over(sheet)})
    packed = dealt.sortWithinPartitions("file", "sheet", "row", "col").mapInArrow(lambda batches: packed_sheets(batches, parts), "file string, sheet string, part string, at long, crc long, packed long, plain long")
    packed.repartition("file").sortWithinPartitions("file", "part", "at").write.format("workbook").option("parts", parts).mode(mode).save(folder)


def sheet_cells(df: DataFrame, file: str, sheet: str, order: list[Column]) -> DataFrame:
    """A table as the cells of a sheet: its column names in row 1, then its rows in ``order``."""
    place = {"file": F.lit(file), "sheet": F.lit(sheet)}
    rows = numbered(df, order, "_row").select((F.col("_row") + 1).cast("int").alias("row"), F.inline(F.array(*[F.struct(F.lit(n).alias("col"), F.col(c).cast("string").alias("value")) for n, c in enumerate(df.columns, 1)])))
    head = df.sparkSession.range(1).select(F.lit(1).alias("row"), F.inline(F.array(*[F.struct(F.lit(n).alias("col"), F.lit(c).alias("value")) for n, c in enumerate(df.columns, 1)])))
    return rows.unionByName(head).where("value is not null").withColumns(place).select("file", "sheet", "row", "col", "value")


def write_report(tables: dict[str, tuple[DataFrame, list[Column]]], folder: str, file: str) -> None:
    """One workbook with a sheet for each table (K10); tables are reports, each of them fits a sheet."""
    cells = [sheet_cells(df, file, sheet, order) for sheet, (df, order) in tables.items()]
    write_cells(reduce(DataFrame.unionByName, cells), folder)

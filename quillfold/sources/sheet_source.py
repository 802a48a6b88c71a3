"""Sheets as a data source: `spark.read.format("sheet")` over CSV and XLSX files.

A big CSV file is read by many tasks. Whether a line break ends a row depends
on all quotes before it, so a first job, `format("sheet_ranges")`, reads each
range of bytes once and says, for every state in which a range may begin, in
which state it ends and how many rows end inside. Chaining these small answers
gives each range its true state and its first row number; `read` does both
steps. A row belongs to the range in which it begins. Without the first step
each file is one range.

A sheet of a workbook is one task: its XML is compressed as one stream. It is
parsed as it is read, and the format ends at 1,048,576 rows.

Columns of the schema: path, sheet, row, cells (array of text), column letters
(the text of that column; null where a row is too short), or, with the option
`mapping`, the mapped fields by name. Only columns of the schema are made.
Files are opened through Arrow's file systems. An unknown suffix is an error.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.mapping import fields_of
from .sheets import LINKS, MAIN, PACKAGE, SCHEMA, column_index

RANGES = "path string, start long, end long, states array<int>, ended array<long>"
RANGE_BYTES = 64 << 20
BLOCK = 1 << 20
BOM = b"\xef\xbb\xbf"

# States between two bytes: a row begins, the same after a carriage return, a field begins, inside a plain field, inside quotes, after a quote inside quotes.
ROW, RETURN, FIELD, PLAIN, QUOTED, CLOSED = range(6)
AFTER = {b",": FIELD, b"\n": ROW, b"\r": RETURN}
OPENING = re.compile(rb'[,\r\n]"')
ROW_END = re.compile(rb"[\r\n]")


def passed(data: bytes, state: int, first: bool = False) -> tuple[int, int, int]:
    """(state, rows ended, bytes read) after reading data from a state on; with first, only up to the first end of a row."""
    at, ended = 0, 0
    while at < len(data):
        if state == QUOTED:
            quote = data.find(b'"', at)
            if quote < 0:
                return QUOTED, ended, len(data)
            at, state = quote + 1, CLOSED
            continue
        ch = data[at : at + 1]
        if ch == b'"' and state != PLAIN:
            at, state = at + 1, QUOTED
            continue
        if ch == b"\n" and state == RETURN:
            at, state = at + 1, ROW
            continue
        opening = OPENING.search(data, at)
        stop = opening.start() + 1 if opening else len(data)
        if first and (end := ROW_END.search(data, at, stop)):
            return AFTER[end[0]], 1, end.end()
        piece = data[at:stop]
        ended += piece.count(b"\n") + piece.count(b"\r") - piece.count(b"\r\n")
        at, state = stop, AFTER.get(piece[-1:], PLAIN)
    return state, ended, at


def outcomes(blocks: Iterable[bytes]) -> tuple[list[int], list[int]]:
    """For each state at the beginning: the state at the end, and the rows ended."""
    states, ended = list(range(6)), [0] * 6
    for block in blocks:
        head = {s: passed(block[:1], s) for s in set(states)}
        tail = {s: passed(block[1:], s) for s in {h[0] for h in head.values()}}
        ended = [n + head[s][1] + tail[head[s][0]][1] for s, n in zip(states, ended, strict=True)]
        states = [tail[head[s][0]][0] for s in states]
    return states, ended


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder but for hidden ones."""
    from pyarrow import fs

    where, inner = opened(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    shown = [(f"{prefix}{i.path}", i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    for p, _ in shown:
        if not p.lower().endswith((".csv", ".xlsx", ".xlsm")):
            raise ValueError(f"not a sheet: {p}")
    return sorted(shown)


def blocks_of(path: str, start: int, end: int) -> Iterator[bytes]:
    where, inner = opened(path)
    with where.open_input_file(inner) as f:
        f.seek(start)
        while start < end and (block := f.read(min(BLOCK, end - start))):
            start += len(block)
            yield block


def after_mark(path: str) -> int:
    """Where the text of a file begins: after its byte order mark, if it has one."""
    return len(BOM) if b"".join(blocks_of(path, 0, len(BOM))) == BOM else 0


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    end: int = -1
    state: int = ROW
    ended: int = 0


def csv_rows(part: Part) -> Iterator[tuple[None, int, list[str]]]:
    """(no sheet, number, cells) of the rows that begin in a range of bytes; the last may end beyond it."""
    csv.field_size_limit(2**31 - 1)
    at, row, state = part.start, part.ended + 1, part.state
    if state not in (ROW, RETURN):
        for block in blocks_of(part.path, part.start, part.end):
            state, ended, read = passed(block, state, True)
            at += read
            if ended:
                row += 1
                break
        else:
            return
    where, inner = opened(part.path)
    with where.open_input_file(inner) as f:
        f.seek(at)
        if state == RETURN and f.read(1) == b"\n":
            at += 1
        f.seek(at)

        def lines() -> Iterator[str]:
            nonlocal at
            for line in io.TextIOWrapper(io.BufferedReader(f, BLOCK), "utf-8", newline=""):
                at += len(line.encode())
                yield line

        rows = csv.reader(lines())
        while at < part.end and (cells := next(rows, None)) is not None:
            yield None, row, cells
            row += 1


def text_in(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def ended_elements(f, tag: str) -> Iterator[ElementTree.Element]:
    """Elements as they end, each forgotten with all before it when the next is asked for."""
    parents: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(f, ("start", "end")):
        if event == "start":
            parents.append(node)
            continue
        parents.pop()
        if node.tag == tag:
            yield node
            node.clear()
            if parents:
                parents[-1].remove(node)


def xlsx_rows(path: str, sheet: str | None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, number, cells) of the rows of one sheet, the first if none is named, or of all for *."""
    where, inner = opened(path)
    with where.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        named = [(s.get("name"), links[s.get(f"{LINKS}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        chosen = named if sheet == "*" else [s for s in named if s[0] == sheet] if sheet else named[:1]
        if not chosen:
            raise ValueError(f"no sheet {sheet!r}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as s:
                shared = [text_in(e) for e in ended_elements(s, f"{MAIN}si")]
        for name, target in chosen:
            with z.open(target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))) as s:
                for n, row in enumerate(ended_elements(s, f"{MAIN}row"), 1):
                    yield name, n, cells_in(row, shared)


def cells_in(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    cells: dict[int, str | None] = {}
    for c in row.findall(f"{MAIN}c"):
        letters = re.match("[A-Za-z]+", c.get("r") or "")
        at = column_index(letters[0]) if letters else max(cells, default=-1) + 1
        kind, value = c.get("t"), c.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            cells[at] = text_in(c)
        elif value is None or value == "":
            cells[at] = None
        else:
            cells[at] = shared[int(value)] if kind == "s" else ("TRUE" if value == "1" else "FALSE") if kind == "b" else value
    return [cells.get(i) for i in range(max(cells, default=-1) + 1)]


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.sheet, self.ranges = options["path"], options.get("sheet"), options.get("ranges")
        mapped = mapped_columns(options)
        own = {"path", "sheet", "row", "cells"}
        bad = [f.name for f in schema if f.name not in own and f.name not in mapped and not re.fullmatch("[A-Z]{1,3}", f.name)]
        if bad:
            raise ValueError(f"not a column of a sheet: {bad[0]}")
        self.columns = [f.name if f.name in own else column_index(mapped.get(f.name, f.name)) for f in schema]

    def partitions(self) -> list[Part]:
        """One a range where ranges are given, else one a file."""
        if self.ranges:
            return [Part(*r) for r in json.loads(self.ranges)]
        return [Part(p, after_mark(p), size) if p.lower().endswith(".csv") else Part(p) for p, size in files(self.path)]

    def read(self, part: Part) -> Iterator[tuple]:
        rows = csv_rows(part) if part.path.lower().endswith(".csv") else xlsx_rows(part.path, self.sheet)
        for sheet, n, cells in rows:
            own = {"path": part.path, "sheet": sheet, "row": n, "cells": cells}
            yield tuple(own[c] if isinstance(c, str) else cells[c] if c < len(cells) else None for c in self.columns)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Part]:
        found = [(p, after_mark(p), size) for p, size in files(self.path) if p.lower().endswith(".csv")]
        return [Part(p, at, min(at + self.size, size)) for p, begin, size in found for at in range(begin, size, self.size)] or [Part("")]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.path:
            yield (part.path, part.start, part.end, *outcomes(blocks_of(part.path, part.start, part.end)))


def mapped_columns(options: dict[str, str]) -> dict[str, str]:
    """Column letters by field name, of the mapping that the options name."""
    if "mapping" not in options:
        return {}
    where, inner = opened(options["mapping"])
    with where.open_input_file(inner) as f:
        rows = fields_of(json.loads(f.read()))
    return {re.sub(r"\W+", "_", f"{section.removesuffix('.columns')}.{field}").strip("_"): column for column, section, field, _ in reversed(rows)}


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        mapped = mapped_columns(self.options)
        return ", ".join(["path string, sheet string, row int", *[f"`{name}` string" for name in mapped]]) if mapped else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options, schema)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(self.options)


def chained(ranges: Iterable[tuple]) -> list[Part]:
    """Ranges with the state in which each begins and the rows ended before it; ranges: rows of RANGES."""
    out: list[Part] = []
    state, ended = ROW, 0
    for path, start, end, states, counts in sorted(ranges):
        if not out or out[-1].path != path:
            state, ended = ROW, 0
        out.append(Part(path, start, end, state, ended))
        state, ended = states[state], ended + counts[state]
    return out


def read(spark: SparkSession, path: str, schema: str | None = None, sheet: str | None = None, mapping: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Sheets under a path, big CSV files in ranges.

    The driver holds one short row a range, as it holds one for every part of any file source.
    An empty file has no rows; an empty folder is an empty table.
    """
    workbooks = [Part(p) for p, _ in files(path) if not p.lower().endswith(".csv")]
    for source in (SheetSource, RangeSource):
        spark.dataSource.register(source)
    found = spark.read.format("sheet_ranges").option("range_bytes", range_bytes).load(path).collect()
    parts = chained(tuple(r) for r in found) + workbooks
    reader = spark.read.format("sheet").option("ranges", json.dumps([[p.path, p.start, p.end, p.state, p.ended] for p in parts]))
    for name, value in (("sheet", sheet), ("mapping", mapping)):
        reader = reader.option(name, value) if value else reader
    return (reader.schema(schema) if schema else reader).load(path)

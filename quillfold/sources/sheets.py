"""Spreadsheet-shaped sources: CSV and XLSX files as rows of text cells.

Files are read through Spark's binary file source, so any file system that
Spark reaches will do; each file is parsed by one task. Row numbers are
positions in the sheet, the header being row 1, and empty rows count.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SCHEMA = "path string, sheet string, row int, cells array<string>"


def column_index(letters: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def csv_rows(data: bytes) -> list[list[str]]:
    """Rows of a CSV file in UTF-8, with or without a byte order mark; quoted line breaks and ragged rows are kept."""
    return list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def xlsx_rows(data: bytes, sheet: str | None = None) -> tuple[str, list[list[str | None]]]:
    """(name, rows) of a sheet, the first if none is named; gaps are null, booleans TRUE or FALSE, declared sizes are ignored."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        sheets = [(s.get("name"), s.get(f"{LINKS}id")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        chosen = [s for s in sheets if sheet is None or s[0] == sheet]
        if not chosen:
            raise ValueError(f"no sheet {sheet!r}")
        name, link = chosen[0]
        target = links[link]
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(part)).iter(f"{MAIN}row"):
            cells: list[str | None] = []
            for c in row.findall(f"{MAIN}c"):
                m = re.match("[A-Za-z]+", c.get("r") or "")
                at = column_index(m[0]) if m else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    cells[at] = _text(c)
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else ("TRUE" if v.text == "1" else "FALSE") if kind == "b" else v.text
            rows.append(cells)
        return name, rows


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, sheet, row and cells of all rows of the files under path; only .csv, .xlsx and .xlsm files are known."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, data in zip(frame["path"], frame["content"], strict=True):
                suffix = posixpath.splitext(p)[1].lower()
                if suffix == ".csv":
                    name, rows = None, csv_rows(bytes(data))
                elif suffix in (".xlsx", ".xlsm"):
                    name, rows = xlsx_rows(bytes(data), sheet)
                else:
                    raise ValueError(f"not a sheet: {p}")
                if rows:
                    yield pd.DataFrame({"path": [p] * len(rows), "sheet": [name] * len(rows), "row": range(1, len(rows) + 1), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def cell(letters: str, cells: str = "cells") -> Column:
    """The text of a column by its letters; null where a row is too short."""
    return F.get(F.col(cells), F.lit(column_index(letters)))

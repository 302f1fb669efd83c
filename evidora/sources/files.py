"""Files as DataFrames of literal values: directory scans, delimited text, spreadsheets, plain text, page texts.

Nothing is typed while reading: leading zeros, decimal commas and signs for missing values stay as they are.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "csv", "xlsx", "xls", "txt")
_ROWS = "source_file string, sheet string, row int, columns array<string>, cells array<string>, problem string"


def scan(spark: SparkSession, directory: str, extensions: tuple[str, ...] = EXTENSIONS, only: list[str] | None = None) -> DataFrame:
    """(source_file, suffix, modified, size, content) of the files below a directory with one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(directory.rstrip("/")) + "/", "")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    out = files.select(path.alias("source_file"), suffix.alias("suffix"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content").where(F.col("suffix").isin(*extensions))
    return out.where(F.col("source_file").isin(only)) if only is not None else out


def decoded(content: bytes) -> str:
    """UTF-16 with its mark, UTF-8 with or without one, else Windows-1252."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def unique_names(header: list[str]) -> list[str]:
    """Column names made unique by their place."""
    return [f"{(h or '').strip()} [coluna {i}]" for i, h in enumerate(header, 1)]


def _delimiter(text: str) -> str:
    first = text.split("\n", 1)[0]
    return max(";,\t|", key=first.count)


def csv_rows(files: DataFrame) -> DataFrame:
    """(source_file, sheet, row, columns, cells, problem) of delimited files; blank rows are left out, ragged rows are told."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f.source_file, f.content, strict=True):
                text = decoded(bytes(content))
                rows = [r for r in csv.reader(io.StringIO(text), delimiter=_delimiter(text)) if any(c.strip() for c in r)]
                if not rows:
                    continue
                names = unique_names(rows[0])
                yield pd.DataFrame({"source_file": name, "sheet": None, "row": range(2, len(rows) + 1), "columns": [names] * (len(rows) - 1), "cells": rows[1:], "problem": [None if len(r) == len(names) else "column_count" for r in rows[1:]]})

    return files.where("suffix = 'csv'").select("source_file", "content").mapInPandas(run, _ROWS)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def workbook_cells(content: bytes) -> dict[str, dict[tuple[int, int], str]]:
    """Sheet name to (row, column) to literal value; merged areas repeat the value of their first cell."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_NS}si")]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out: dict[str, dict[tuple[int, int], str]] = {}
    for sheet in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        root = ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        cells: dict[tuple[int, int], str] = {}
        for c in root.iter(f"{_NS}c"):
            v, kind = c.find(f"{_NS}v"), c.get("t")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif v is None or v.text is None:
                continue
            else:
                value = shared[int(v.text)] if kind == "s" else v.text
            cells[_place(c.get("r"))] = value
        for area in root.iter(f"{_NS}mergeCell"):
            a, _, b = area.get("ref").partition(":")
            (r1, c1), (r2, c2) = _place(a), _place(b or a)
            if (r1, c1) in cells:
                for r in range(r1, r2 + 1):
                    for k in range(c1, c2 + 1):
                        cells.setdefault((r, k), cells[r1, c1])
        out[sheet.get("name")] = cells
    return out


def _numeric(x: str) -> bool:
    return bool(re.fullmatch(r"\s*[-−]?[0-9][0-9.,]*\s*%?\s*", x))


def header_rows(grid: list[list[str]]) -> int:
    """How many rows head a sheet: up to the first later row where at least half of the filled cells are numbers that are not
    all years."""
    for i, row in enumerate(grid[1:], 1):
        filled = [c for c in row if c.strip()]
        if filled and sum(map(_numeric, filled)) * 2 >= len(filled) and not all(re.fullmatch(r"(19|20)[0-9]{2}", c.strip()) for c in filled):
            return i
    return min(1, len(grid))


def spreadsheet_rows(files: DataFrame) -> DataFrame:
    """(source_file, sheet, row, columns, cells, problem) of workbooks; the parts of a header of several rows are joined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f.source_file, f.content, strict=True):
                for sheet, cells in workbook_cells(bytes(content)).items():
                    if not cells:
                        continue
                    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
                    grid = [[cells.get((r, c), "") for c in cols] for r in rows]
                    n = header_rows(grid)
                    names = unique_names([" / ".join(dict.fromkeys(x for x in (g[i].strip() for g in grid[:n]) if x)) for i in range(len(cols))])
                    if grid[n:]:
                        yield pd.DataFrame({"source_file": name, "sheet": sheet, "row": rows[n:], "columns": [names] * len(grid[n:]), "cells": grid[n:], "problem": None})

    return files.where("suffix = 'xlsx'").select("source_file", "content").mapInPandas(run, _ROWS)


def text_pages(files: DataFrame) -> DataFrame:
    """(source_file, page, text): a plain text file is one page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"source_file": f.source_file, "page": 1, "text": [decoded(bytes(c)) for c in f.content]})

    return files.where("suffix = 'txt'").select("source_file", "content").mapInPandas(run, "source_file string, page int, text string")


def snapshot(files: DataFrame, first_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """(path, modified, size, sha256 of the first bytes, 16 characters): what change detection compares."""
    return files.select(F.col("source_file").alias("path"), "modified", "size", F.substring(F.sha2(F.substring("content", 1, first_bytes), 256), 1, 16).alias("sha256"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes as JSON lines without vectors; readers see the old or the new files, never a part."""
    nodes.drop("vector", "embedding").write.mode("overwrite").json(path)


def read_nodes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nodes written by write_nodes; lines that do not parse are left out."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")


def turtle(registry: DataFrame, scheme: str = "https://example.org/units") -> DataFrame:
    """(line): concepts of a registry (id, label, broader) as SKOS in Turtle."""
    quoted = F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    broader = F.when(F.col("broader").isNotNull(), F.concat(F.lit(" ;\n  skos:broader <"), F.lit(f"{scheme}/"), "broader", F.lit(">"))).otherwise("")
    return registry.select(F.concat(F.lit(f"<{scheme}/"), "id", F.lit('> a skos:Concept ;\n  skos:prefLabel "'), quoted, F.lit('"@pt'), broader, F.lit(" .")).alias("line"))

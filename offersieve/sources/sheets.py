"""Files of offer lists as raw rows.

Raw rows: (file, sheet, source_row, cells array<string>, numbers array<double>, empty, hidden, notes).
source_row is the physical line or spreadsheet row, blank rows included; numbers holds the
value of numeric spreadsheet cells.  Delimited files are split among tasks; a workbook is one
task, since its sheets are zipped.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.functions.text import is_blank
from offersieve.schema import STANDARD_HEADERS, TEMPLATE_SAMPLE
from offersieve.session import ship
from offersieve.sources import delimited, sniff

RAW = delimited.RAW
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass(frozen=True)
class Sheet:
    """rows after the header row, padded to its width, and the headers."""

    rows: DataFrame
    headers: tuple[str, ...]
    header_row: int
    date1904: bool | None = None
    #: Of a workbook: (file, sheet, hidden columns), and (file, code, sheet, message) of its sheets.
    hidden_columns: DataFrame | None = None
    issues: DataFrame | None = None


def parse_delimited(text: str, delimiter: str) -> Iterator[tuple[int, list[str | None], list[str]]]:
    """(physical line of a record's start, cells, notes)."""
    for line, cells, kinds in delimited.records(text, delimiter):
        yield line, cells, delimited.note(kinds)


read_delimited = delimited.read_delimited


def read_pasted(spark: SparkSession, text: str, delimiter: str | None = None) -> DataFrame:
    """Raw rows of pasted text (bounded by the paste limit)."""
    sniff.guard("paste", sniff.MAX_PASTE, len(text))
    sep = delimiter or sniff.detect_delimiter(text) or "\t"
    rows = [("", "", n, cells, [None] * len(cells), False, notes) for n, cells, notes in parse_delimited(text.removeprefix("﻿"), sep)]
    return spark.createDataFrame(rows, RAW)


# ---------------------------------------------------------------- spreadsheets
def _pulled(z: zipfile.ZipFile, part: str, *wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of some names, one after another as they end; each is gone when the next one comes."""
    above = []
    with z.open(part) as stream:
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag.removeprefix(_NS) in wanted:
                yield e
                e.clear()
                if above:
                    above[-1].remove(e)


def workbook(z: zipfile.ZipFile) -> tuple[list[tuple[str, str, bool]], bool]:
    """(name, part, hidden) of each sheet, and the 1904 flag."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    props = book.find(f"{_NS}workbookPr")
    sheets = []
    for s in book.iter(f"{_NS}sheet"):
        target = links[s.get(_REL)].lstrip("/")
        sheets.append((s.get("name"), target if target.startswith("xl/") else f"xl/{target}", s.get("state", "visible") != "visible"))
    return sheets, props is not None and props.get("date1904") in ("1", "true")


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    """Cells speak of these by number, so all are kept; they are the one part of a workbook that is."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in _pulled(z, "xl/sharedStrings.xml", "si")]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


@dataclass
class Extent:
    """The rectangle of a sheet's cells (rows from 1, columns from 0), its hidden columns as intervals, and counts."""

    first_row: int = 0
    last_row: int = 0
    first_column: int = 0
    last_column: int = -1
    hidden_intervals: tuple[tuple[int, int], ...] = ()
    n_hidden_rows: int = 0
    empty: bool = True

    @property
    def n_rows(self) -> int:
        return self.last_row - self.first_row + 1 if self.first_row else 0

    @property
    def n_columns(self) -> int:
        return self.last_column - self.first_column + 1

    def hidden_columns(self) -> list[int]:
        """Numbers of hidden columns among the sheet's own, from 0."""
        inside = [(max(a, self.first_column), min(b, self.last_column)) for a, b in self.hidden_intervals]
        return [c - self.first_column for a, b in inside for c in range(a, b + 1)]


def merged(intervals: list[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """Closed intervals as the fewest disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return tuple(out)


def _cells(row: ElementTree.Element) -> Iterator[tuple[int, ElementTree.Element]]:
    at = -1
    for c in row.iter(f"{_NS}c"):
        at = _column(c.get("r")) if c.get("r") else at + 1
        yield at, c


def extent(z: zipfile.ZipFile, part: str) -> Extent:
    """One pass over a sheet, a row at a time. Cells without a value or formula (styles alone) don't count."""
    out, hidden, last = Extent(), [], 0
    for e in _pulled(z, part, "col", "row"):
        if e.tag == f"{_NS}col":
            if e.get("hidden") in ("1", "true"):
                hidden.append((int(e.get("min")) - 1, int(e.get("max")) - 1))
            continue
        last = int(e.get("r", last + 1))
        columns = [i for i, c in _cells(e) if len(c)]
        if not columns:
            continue
        if not out.first_row:
            out.first_row, out.first_column = last, columns[0]
        out.last_row = last
        out.first_column, out.last_column = min(out.first_column, *columns), max(out.last_column, *columns)
        out.n_hidden_rows += e.get("hidden") in ("1", "true")
        out.empty = out.empty and not any((c.findtext(f"{_NS}v") or "") != "" or c.get("t") == "inlineStr" and "".join(t.text or "" for t in c.iter(f"{_NS}t")) for _, c in _cells(e))
    out.hidden_intervals = merged(hidden)
    return out


def sheet_rows(z: zipfile.ZipFile, part: str, strings: list[str], within: Extent) -> Iterator[tuple[int, list, list, bool, list[str]]]:
    """(row, cells, numbers, hidden, notes) of a sheet's rectangle, a row at a time; gaps between rows are blank rows."""
    last = 0
    for row in _pulled(z, part, "row"):
        at, last = int(row.get("r", last + 1)), int(row.get("r", last + 1))
        if not within.first_row <= at <= within.last_row:
            continue
        if at == within.first_row:
            due = at
        for gap in range(due, at):
            yield gap, [None], [None], False, []
        due = at + 1
        cells, numbers, notes = [], [], []
        for column, c in _cells(row):
            i = column - within.first_column
            if i < 0 or column > within.last_column:
                continue
            while len(cells) <= i:
                cells.append(None)
                numbers.append(None)
            kind, text = c.get("t", "n"), c.findtext(f"{_NS}v")
            if kind == "inlineStr":
                cells[i] = "".join(t.text or "" for t in c.iter(f"{_NS}t")) or None
            elif text is None:
                notes += ["FORMULA_WITHOUT_CACHE"] if c.find(f"{_NS}f") is not None and not notes else []
            elif kind == "s":
                cells[i] = strings[int(text)] or None
            elif kind == "b":
                cells[i] = "TRUE" if text == "1" else "FALSE"
            elif kind == "n":
                numbers[i] = float(text)
                cells[i] = text[:-2] if text.endswith(".0") else text
            else:  # text of formulas, errors
                cells[i] = text
        yield at, cells or [None], numbers or [None], row.get("hidden") in ("1", "true"), notes


def _workbooks(spark: SparkSession, path: str, each, schema: str) -> DataFrame:
    """What `each` gives for (path, opened zip), row by row, in batches of a thousand; a workbook is one task."""
    ship(spark)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path_, data in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows = each(path_, z)
                    while part := list(itertools.islice(rows, 1000)):
                        yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Raw rows of one sheet of each workbook: the named one, else the first that is not empty."""

    def each(path_: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        strings = None
        for name, part, _ in workbook(z)[0]:
            if sheet is not None and name != sheet:
                continue
            within = extent(z, part)
            if within.empty and sheet is None:
                continue
            strings = shared_strings(z)
            for r in sheet_rows(z, part, strings, within):
                yield (path_, name, *r)
            return

    return _workbooks(spark, path, each, RAW)


_CATALOGUE = "file string, position int, sheet string, hidden boolean, n_rows int, n_columns int, n_hidden_rows int, hidden_columns array<int>, first_row int, empty boolean, date1904 boolean"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sheet: where it stands, its size, hidden rows and columns (numbers among its own), and whether it is empty."""

    def each(path_: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        sheets, d1904 = workbook(z)
        for i, (name, part, hidden) in enumerate(sheets):
            e = extent(z, part)
            yield path_, i, name, hidden, e.n_rows, e.n_columns, e.n_hidden_rows, e.hidden_columns(), e.first_row, e.empty, d1904

    return _workbooks(spark, path, each, _CATALOGUE)


def sheet_issues(sheets: DataFrame, sheet: str | None = None) -> DataFrame:
    """(file, code, sheet, message) of empty sheets in a catalogue, the chosen one with a message of its own."""
    name = F.col("sheet")
    chosen = F.coalesce(name == F.lit(sheet), F.lit(False))
    message = F.when(chosen, F.concat(F.lit("选中的工作表「"), name, F.lit("」是空的"))).otherwise(F.concat(F.lit("空工作表「"), name, F.lit("」未读取")))
    return sheets.where("empty").select("file", F.lit("EMPTY_SHEET_SKIPPED").alias("code"), "sheet", message.alias("message"))


def inspect_workbooks(spark: SparkSession, path: str, preview: int = 8) -> DataFrame:
    """A dry run over workbooks, a row for each: (file, date1904, sheets, previewed, preview, issues).

    sheets are those of the catalogue; previewed is the first that is not empty, and preview its first rows.
    """
    listed = catalogue(spark, path)
    about = F.array_sort(F.collect_list(F.struct("position", "sheet", "hidden", "n_rows", "n_columns", "n_hidden_rows", "hidden_columns", "empty")))
    books = listed.groupBy("file").agg(F.max("date1904").alias("date1904"), about.alias("sheets"))
    issues = sheet_issues(listed).groupBy("file").agg(F.sort_array(F.collect_list("message")).alias("issues"))

    def each(path_: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for name, part, _ in workbook(z)[0]:
            within = extent(z, part)
            if not within.empty:
                first = itertools.islice(sheet_rows(z, part, shared_strings(z), within), preview)
                yield path_, name, [["" if c is None else c for c in cells] for _, cells, *_ in first]
                return

    shown = _workbooks(spark, path, each, "file string, previewed string, preview array<array<string>>")
    return books.join(shown, "file", "left").join(issues, "file", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))


# ---------------------------------------------------------------- shaping
def shape(raw: DataFrame, header_row: int | None = None, date1904: bool | None = None, limits: bool = False) -> Sheet:
    """Header row and padded data rows with empty and notes (a cell that repeats its own header is noted)."""
    spans = raw.groupBy("file").agg(F.min("source_row").alias("first"), F.count("*").alias("rows"), F.max(F.size("cells")).alias("width"))
    first, width, most = spans.agg(F.min("first"), F.max("width"), F.max("rows")).first()
    if first is None:
        raise ValueError("EMPTY_DATASET")
    if limits:  # those of an import hold for each file
        sniff.guard_grid(most, width)
    at = header_row if header_row is not None else first
    # Every file must begin with the same header; then one mapping holds for all.
    found = raw.where(F.col("source_row") == at).groupBy("cells").agg(F.count_distinct("file").alias("files")).limit(2).collect()
    if not found:
        raise ValueError(f"no row {at}")
    if len(found) > 1 or found[0]["files"] < spans.count():
        raise ValueError("HEADERS_DIFFER: files with other headers are read one by one")
    found = found[0]
    headers = tuple([*(c or "" for c in found[0]), *[""] * (width - len(found[0]))])
    pad = lambda c, kind: F.concat(F.col(c), F.array_repeat(F.lit(None).cast(kind), F.lit(width) - F.size(c)))
    rows = raw.where(F.col("source_row") > at).withColumns({"cells": pad("cells", "string"), "numbers": pad("numbers", "double")})
    empty = F.forall("cells", lambda c: is_blank(c))
    own = F.array(*[F.lit(h.strip()) for h in headers])
    echo = F.exists(F.arrays_zip(F.col("cells").alias("c"), own.alias("h")), lambda z: (z["h"] != "") & F.coalesce(F.trim(z["c"]) == z["h"], F.lit(False)))
    notes = F.when(~empty & echo, F.array_append("notes", F.lit("HEADER_ECHO_CELL"))).otherwise(F.col("notes"))
    return Sheet(rows.withColumns({"empty": empty, "notes": F.array_distinct(notes)}), headers, at, date1904)


def note_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("notes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def facts(sheet: Sheet) -> DataFrame:
    """One row: n_rows, n_empty, n_hidden, n_formula_without_cache."""
    return sheet.rows.agg(
        F.count("*").alias("n_rows"), F.count_if("empty").alias("n_empty"), F.count_if("hidden").alias("n_hidden"),
        F.count_if(F.array_contains("notes", "FORMULA_WITHOUT_CACHE")).alias("n_formula_without_cache"),
    )


def read_offers(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, sheet: str | None = None, header_row: int | None = None) -> Sheet:
    """A file, or files of one kind and header, as a Sheet. Files over the import limits raise; nothing is cut."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 4096).alias("head"))
    size, n = files.agg(F.max("length"), F.count("*")).first()
    if not n:
        raise ValueError("EMPTY_DATASET")
    sniff.guard("bytes", sniff.MAX_BYTES, size)
    ship(spark)
    kind_of = F.udf(lambda p, head: sniff.detect_kind(p, bytes(head)).kind, "string")  # once for each file
    kinds = [r[0] for r in files.select(kind_of("path", "head")).distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError("MIXED_FILE_TYPES: " + ", ".join(sorted(kinds)))
    if kinds[0] == "xlsx":
        sheets = catalogue(spark, path)
        if sheet is not None and not sheets.where(F.col("sheet") == sheet).limit(1).count():
            raise ValueError(f"no sheet {sheet}")
        shaped = shape(read_workbook(spark, path, sheet), header_row, sheets.first()["date1904"], limits=True)
        # The sheet that was read: the named one, else each workbook's first that is not empty.
        own = sheets.where(F.col("sheet") == sheet if sheet is not None else ~F.col("empty"))
        first = own.groupBy("file").agg(F.min_by(F.struct("sheet", "hidden_columns"), "position").alias("s")).select("file", "s.*")
        return replace(shaped, hidden_columns=first, issues=sheet_issues(sheets, sheet))
    if kinds[0] != "delimited":
        raise ValueError(f"UNSUPPORTED_FILE_TYPE: {kinds[0]}")
    return shape(read_delimited(spark, path, encoding, delimiter), header_row, limits=True)


def template(with_sample: bool = False) -> str:
    """The header template: tab-separated, CRLF."""
    lines = [STANDARD_HEADERS, *([TEMPLATE_SAMPLE] if with_sample else [])]
    return "\r\n".join("\t".join(x) for x in lines) + "\r\n"

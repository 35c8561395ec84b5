"""Delimited files as raw rows: one file in many tasks, rows and lines as one reader of the whole file has them.

Quoted line breaks make it matter where a task begins.  At a line feed a reader is either between records or inside
quotes, so what a task's piece of a file does is a pair: where it ends if it begins between records, and if it begins
inside quotes.  A first pass finds these pairs, with counts of physical lines and whether the bytes are UTF-8; composing
them in the order of the pieces says how each piece really begins.  A second pass parses.  A record over a seam is put
together from its fragments by the line where it begins.  The driver sees one row for each piece, as Spark's planner does.

Encoding and delimiter are found out for each file, from all of its bytes and from its first line.  UTF-16 has no single
byte for a line feed; such files (by their mark, or as asked for) are one task each.  A file whose first bytes have
carriage returns alone is one piece.

Quotes follow RFC 4180.  A record's `kinds` name what is wrong: `unterminated`, the file ended inside quotes; `trailing`,
text follows a closing quote.  A quote inside a cell that does not begin with one is text.  Records of either kind get
the note QUOTE_MISMATCH.  An empty file has no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.functions.text import is_blank
from offersieve.session import ship
from offersieve.sources import sniff

RAW = "file string, sheet string, source_row int, cells array<string>, numbers array<double>, hidden boolean, notes array<string>"
HEAD = 1 << 14
_FULL = f"{RAW}, kinds array<string>"


# ---------------------------------------------------------------- one record, one line
def quotes(text: str, delimiter: str, inside: bool = False) -> tuple[bool, list[str]]:
    """Whether text ends inside quotes if it begins so, and which kinds of errors its quotes have."""
    if '"' not in text:
        return inside, []
    kinds, at, n = [], 0, len(text)

    def unquoted(at: int) -> int:
        """Behind the next delimiter or line break."""
        found = [p for p in (text.find(c, at) for c in (delimiter, "\n", "\r")) if p >= 0]
        return min(found) + 1 if found else n + 1

    while at <= n:
        if not inside:
            if not text.startswith('"', at):
                at = unquoted(at)
                continue
            inside, at = True, at + 1
        end = text.find('"', at)
        if end < 0:
            return True, kinds
        if text.startswith('"', end + 1):
            at = end + 2
            continue
        inside, at = False, end + 1
        if at < n and text[at] not in (delimiter, "\n", "\r"):
            kinds.append("trailing")
        at = unquoted(at)
    return inside, kinds


def records(text: str, delimiter: str, ends: bool = True) -> Iterator[tuple[int, list[str | None], list[str]]]:
    """(line of its start from 1, cells, kinds of quote errors) of every record of a text that begins with one."""
    csv.field_size_limit(sniff.MAX_CELL)
    lines = io.StringIO(text, newline="").readlines()
    reader = csv.reader(iter(lines), delimiter=delimiter)
    start = 0
    for record in reader:
        raw, at, start = lines[start : reader.line_num], start + 1, reader.line_num
        kinds = []
        if any('"' in x for x in raw):
            open_, kinds = quotes("".join(raw), delimiter)
            kinds = sorted({*kinds, *(["unterminated"] if open_ and ends else [])})
        yield at, [c or None for c in record] or [None], kinds


def note(kinds: Iterable[str]) -> list[str]:
    return ["QUOTE_MISMATCH"] if kinds else []


def _physical(line: bytes) -> int:
    """How many lines a reader counts in what stands between two line feeds."""
    return 1 + line.count(b"\r") - line.endswith(b"\r")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, line, cells, kinds = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(file, pa.string()), pa.array([""] * len(rows)), pa.array(line, pa.int32()), pa.array(cells, pa.list_(pa.string())),
            pa.array([[None] * len(c) for c in cells], pa.list_(pa.float64())), pa.array([False] * len(rows)), pa.array([note(k) for k in kinds], pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.string())),
        ],
        [c.split()[0] for c in _FULL.split(", ")],
    )


# ---------------------------------------------------------------- whole files
def _whole(spark: SparkSession, paths: list[str] | str, encoding: str | None, delimiter: str | None) -> DataFrame:
    """Files that can't be split, one task for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, data in zip(frame["path"].to_pylist(), frame["content"].to_pylist(), strict=True):
                text, _ = sniff.decode(data, encoding or sniff.detect_encoding(data).encoding)
                sep = delimiter or sniff.detect_delimiter(text) or sniff.default_delimiter(path[path.rfind(".") :].lower())
                rows = [(path, *r) for r in records(text, sep)]
                for at in range(0, len(rows), 5000):
                    yield _batch(rows[at : at + 5000])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, _FULL)


# ---------------------------------------------------------------- pieces of files
#: What a piece does depends on the delimiter, and for the bar, a second byte in GB 18030, on the encoding.
_WAYS = tuple((e, d) for d in sniff.DELIMITERS for e in (("utf-8", "gb18030") if d == "|" else ("utf-8",)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, size, line): what stands between line feeds, in order within a piece; start is where a piece begins, size that of the file."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], list[bytes]]]:
    """Lines of one piece that follow each other; a piece comes in several runs."""
    for batch in batches:
        files, starts, sizes, lines = (batch[c].to_pylist() for c in ("file", "start", "size", "line"))
        at = 0
        while at < len(lines):
            to = at
            while to < len(lines) and starts[to] == starts[at] and files[to] == files[at]:
                to += 1
            yield (files[at], starts[at], sizes[at]), lines[at:to]
            at = to


_PIECE = "file string, start long, size long, bytes long, n long, utf8 boolean, head binary, ends array<boolean>, opened array<long>"


def _pieces(batches: Iterable[pa.RecordBatch], ways: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: physical lines, whether it is UTF-8, those of the file's first bytes that it has, and for each way and each beginning whether it ends inside quotes and where the record began that is open there (-1: before the piece)."""
    state = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([state], pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("start", "size", "bytes", "n")), ("utf8", pa.bool_()), ("head", pa.binary()), ("ends", pa.list_(pa.bool_())), ("opened", pa.list_(pa.int64()))]))

    for (file, start, size), part in _runs(batches):
        if state is None or (state["file"], state["start"]) != (file, start):
            if state is not None:
                yield out()
            state = {"file": file, "start": start, "size": size, "bytes": 0, "n": 0, "utf8": True, "head": b"", "ends": [False, True] * len(ways), "opened": [-1, -1] * len(ways)}
        ends, opened = state["ends"], state["opened"]
        for line in part:
            if start + state["bytes"] < HEAD:
                state["head"] += line[:HEAD] + b"\n"
            if state["utf8"] and not line.isascii():
                try:
                    line.decode("utf-8")
                except UnicodeDecodeError:
                    state["utf8"] = False
            if b'"' in line:
                marked = state["n"] == 0 and start == 0 and line.startswith(b"\xef\xbb\xbf")
                for w, (encoding, delimiter) in enumerate(ways):
                    text = (line[3:] if marked else line).decode("latin-1" if encoding == "utf-8" else encoding, "replace")
                    for inside in (0, 1):
                        i = 2 * w + inside
                        was, (ends[i], _) = ends[i], quotes(text, delimiter, ends[i])
                        if ends[i]:
                            began = _began(text, delimiter, was)
                            opened[i] = opened[i] if began is None else state["n"] + began
            state["n"] += _physical(line)
            state["bytes"] += len(line) + 1
    if state is not None:
        yield out()


def _began(text: str, delimiter: str, inside: bool) -> int | None:
    """In which line of text the record begins that is open at its end; None if it was open before."""
    lines, at = io.StringIO(text, newline="").readlines(), 0
    began = None if inside else 0
    for i, line in enumerate(lines):
        inside, _ = quotes(line, delimiter, inside)
        if not inside:
            began = i + 1
        at += len(line)
    return began


def _plan(rows: list, ways: tuple[tuple[str, str], ...], encoding: str | None, delimiter: str | None) -> tuple[dict, dict, list[str]]:
    """For each file its encoding, its delimiter, whether it ends with a line feed, and whether it begins with a mark; for each piece whether it begins inside quotes, its first line and that of the record open there; and the files of two bytes a letter."""
    files: dict[str, list] = {}
    for r in rows:
        files.setdefault(r.file, []).append(r)
    wide, how, begins = [], {}, {}
    for file, pieces in files.items():
        pieces.sort(key=lambda r: r.start)
        head = b"".join(bytes(r.head) for r in pieces)
        found = sniff.detect_encoding(head)
        if encoding is None and found.encoding.startswith("utf-16"):
            wide.append(file)
            continue
        # Lines come without line feeds, and the first one may come without the file's mark.
        over = sum(r.bytes for r in pieces) - pieces[0].size
        marked, fed = found.source == "bom" or over in (-3, -2), over in (0, -3)
        code = encoding or ("utf-8" if marked or all(r.utf8 for r in pieces) else "gb18030")
        sep = delimiter or sniff.detect_delimiter(sniff.decode(head, code)[0]) or sniff.default_delimiter(file[file.rfind(".") :].lower())
        # The last line feed is part of a cell that never ends.
        how[file] = (code, sep, fed, marked)
        way = next((i for i, (e, d) in enumerate(ways) if d == sep and (e == "gb18030") == (code != "utf-8")), next(i for i, (_, d) in enumerate(ways) if d == sep))
        inside, line, opened = False, 0, None
        for r in pieces:
            begins[file, r.start] = (inside, line, opened)
            i = 2 * way + inside
            opened = (line + r.opened[i] if r.opened[i] >= 0 else opened) if r.ends[i] else None
            inside, line = r.ends[i], line + r.n
        begins[file, -1] = (inside, line, opened)
    return how, begins, wide


def _examined(spark: SparkSession, path: str, encoding: str | None, delimiter: str | None) -> tuple[DataFrame, dict, dict, list[str], dict[str, bytes]]:
    """The lines of all files, `_plan` of them, and the first bytes of each file."""
    ways = _WAYS if delimiter is None else (("utf-8", delimiter), ("gb18030", delimiter))
    lines = _lines(spark, path)
    # A row for each piece, as in Spark's own plan.
    pieces = lines.mapInArrow(lambda b: _pieces(b, ways), _PIECE).collect()
    heads: dict[str, bytes] = {}
    for r in sorted(pieces, key=lambda r: r.start):
        heads[r.file] = heads.get(r.file, b"") + bytes(r.head)
    return lines, *_plan(pieces, ways, encoding, delimiter), heads


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, kinds: bool = False) -> DataFrame:
    """Raw rows of delimited files; encoding and delimiter are found out where not given. With kinds, the kinds of quote errors too."""
    ship(spark)
    names = [c.split()[0] for c in (_FULL if kinds else RAW).split(", ")]
    if encoding is not None and encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32")):
        return _whole(spark, path, encoding, delimiter).select(*names)
    return _rows(spark, *_examined(spark, path, encoding, delimiter)[:4], delimiter).select(*names)


def _rows(spark: SparkSession, lines: DataFrame, how: dict, begins: dict, wide: list[str], delimiter: str | None) -> DataFrame:
    plan = spark.sparkContext.broadcast((how, begins))
    rows = lines.mapInArrow(lambda b: _parsed(b, *plan.value), _FULL)
    if any(inside for inside, _, _ in begins.values()):
        parts = lines.mapInArrow(lambda b: _fragments(b, *plan.value), "file string, source_row int, at long, text string")
        joined = parts.groupBy("file", "source_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("parts"))
        rows = rows.union(joined.mapInArrow(lambda b: _joined(b, *plan.value), _FULL))
    if wide:
        rows = rows.union(_whole(spark, [unquote(f) for f in wide], None, delimiter))
    return rows


_INSPECTED = "file string, encoding string, encoding_source string, hint string, delimiter string, delimiter_source string, preview array<string>, preview_cut boolean"


def inspect_delimited(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A dry run over delimited files, a row for each: how they would be read, first lines, counts and issues.

    (file, encoding, encoding_source, hint, delimiter, delimiter_source, preview, preview_cut, n_rows, n_columns,
    n_empty, n_replaced, issues).  n_replaced counts characters that could not be decoded; issues are
    `code:rows`.  Files of UTF-16 are not counted among these.
    """
    ship(spark)
    lines, how, begins, wide, heads = _examined(spark, path, encoding, delimiter)
    facts = []
    for file, (code, sep, _, marked) in how.items():  # as many as files
        text = sniff.decode(heads[file], code)[0]
        shown, more, cut = sniff.preview(text)
        source = "given" if encoding else "bom" if marked else "utf8-valid" if code == "utf-8" else "fallback"
        hint = None if encoding or code == "utf-8" else sniff.detect_encoding(b"\xff").hint
        facts.append((file, code, source, hint, sep, "given" if delimiter else "text" if sniff.detect_delimiter(text) else "name", shown, more or cut))
    rows = _rows(spark, lines, how, begins, [], delimiter)
    blank = F.forall("cells", lambda c: is_blank(c))
    replaced = F.aggregate("cells", F.lit(0), lambda n, c: n + F.coalesce(F.length(F.regexp_replace(c, "[^�]", "")), F.lit(0)))
    kinds = {k: F.count_if(F.array_contains("kinds", k)) for k in ("trailing", "unterminated")}
    issues = F.array_compact(F.array(*[F.when(n > 0, F.concat(F.lit(f"QUOTE_MISMATCH.{k}:"), n.cast("string"))) for k, n in kinds.items()]))
    counted = rows.groupBy("file").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns"), F.count_if(blank).alias("n_empty"), F.sum(replaced).alias("n_replaced"), issues.alias("issues"))
    out = spark.createDataFrame(facts, _INSPECTED).join(counted, "file", "left")
    none = F.col("n_rows").isNull()
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_columns", "n_empty", "n_replaced")}
    return out.select(*[c.split()[0] for c in _INSPECTED.split(", ")], *zero.values(), F.when(none, F.array(F.lit("EMPTY_DATASET:0"))).otherwise(F.col("issues")).alias("issues"))


def _walk(batches: Iterable[pa.RecordBatch], how: dict, begins: dict) -> Iterator[tuple[str, str, int, int | None, list[str], bool]]:
    """(file, delimiter, first line, line of the record it belongs to, lines, closed): stretches between the places where a record ends.

    Whole records have no line of a record they belong to; fragments do.  A piece's last stretch is a fragment if it is not closed.
    """
    key, left, first, inside, owner, line = None, [], 0, False, None, 0

    def cut(sep: str, closed: bool) -> Iterator[tuple]:
        if left:
            yield key[0], sep, first, owner, left, closed

    for (*now, size), part in _runs(batches):
        now = tuple(now)
        if now[0] not in how or part in ([b"\xef\xbb\xbf"], [b""]) and size == 3:  # a file that is read whole, or holds a mark alone
            continue
        code, sep, *_ = how[now[0]]
        if now != key:
            if key is not None:
                yield from cut(how[key[0]][1], not inside)
            if now not in begins:
                raise RuntimeError("files were split another way than in the first pass; read them again")
            key, left = now, []
            inside, line, owner = begins[now]
            first = line
        for raw in part:
            text = raw.decode(code, "replace")
            if now[1] == 0 and line == 0:
                text = text.removeprefix("﻿")
            was = inside
            if '"' in text:
                inside, _ = quotes(text, sep, inside)
            if inside and not was and left:  # records before this line are whole
                yield from cut(sep, True)
                left, first = [], line
            left.append(text)
            line += _physical(raw)
            if was and not inside:
                yield from cut(sep, True)
                left, first, owner = [], line, None
        if not inside and left:
            yield from cut(sep, True)
            left, first = [], line
    if key is not None:
        yield from cut(how[key[0]][1], not inside)


def _parsed(batches: Iterator[pa.RecordBatch], how: dict, begins: dict) -> Iterator[pa.RecordBatch]:
    """Records that begin and end within a piece."""
    for file, sep, first, owner, lines, closed in _walk(batches, how, begins):
        if owner is None:
            rows = [(file, first + at, cells, kinds) for at, cells, kinds in records("\n".join(lines) + "\n", sep, False)]
            if not closed:  # the last record goes on in the next piece
                rows.pop()
            if rows:
                yield _batch(rows)


def _fragments(batches: Iterator[pa.RecordBatch], how: dict, begins: dict) -> Iterator[pa.RecordBatch]:
    """Parts of the records that go on over the end of a piece, with the line where the record begins."""
    for file, sep, first, owner, lines, closed in _walk(batches, how, begins):
        text = "\n".join(lines)
        if owner is None and closed:
            continue
        found = [(owner, first, text)]
        began = None if closed else _began(text, sep, owner is not None)
        if began is not None:  # the open record is not the one that was open before
            split = io.StringIO(text, newline="").readlines()
            found = [(owner, first, "".join(split[:began])), (first + began, first + began, "".join(split[began:]))][owner is None :]
        for of, at, part in found:
            yield pa.RecordBatch.from_pylist([{"file": file, "source_row": of, "at": at, "text": part}], pa.schema([("file", pa.string()), ("source_row", pa.int32()), ("at", pa.int64()), ("text", pa.string())]))


def _joined(batches: Iterator[pa.RecordBatch], how: dict, begins: dict) -> Iterator[pa.RecordBatch]:
    """Records over seams. After the line where such a record ends others may begin in the same stretch."""
    for batch in batches:
        for file, row, parts in zip(batch["file"].to_pylist(), batch["source_row"].to_pylist(), batch["parts"].to_pylist(), strict=True):
            _, sep, fed, _ = how[file]
            text = "\n".join(parts)
            if fed and quotes(text, sep)[0]:
                text += "\n"
            yield _batch([(file, row + at, cells, kinds) for at, cells, kinds in records(text, sep)])

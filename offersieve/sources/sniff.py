"""What a file is: kind, encoding, delimiter, preview, limits. Looks at a head of bytes on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Fixed values.
EXTENSIONS = {".xlsx": "xlsx", ".xlsm": "xlsx", ".xls": "xls", ".xlsb": "xls", ".csv": "delimited", ".tsv": "delimited", ".txt": "delimited"}
MIMES = {
    "text/csv": "delimited", "text/plain": "delimited", "text/tab-separated-values": "delimited",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel": "xls",
}
DELIMITERS = ("\t", ",", ";", "|")
MAX_BYTES, MAX_PASTE, MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 20 << 20, 2_000_000, 50_000, 512, 2_000_000


@dataclass(frozen=True)
class Kind:
    kind: str  # delimited, xlsx, xls or unsupported
    delimiter: str | None = None


def detect_kind(name: str = "", head: bytes = b"", mime: str | None = None) -> Kind:
    """First bytes before extension before MIME type."""
    extension = (re.search(r"\.[^.]+$", name.lower()) or [""])[0]
    if head.startswith(b"PK\x03\x04"):
        return Kind("xlsx")
    if head.startswith(b"\xd0\xcf\x11\xe0"):
        return Kind("xls")
    kind = EXTENSIONS.get(extension) or MIMES.get((mime or "").split(";")[0].strip().lower(), "unsupported")
    return Kind(kind, default_delimiter(extension) if kind == "delimited" else None)


def default_delimiter(extension: str) -> str:
    return "," if extension == ".csv" else "\t"


@dataclass(frozen=True)
class Encoding:
    encoding: str
    source: str  # bom, utf8-valid or fallback
    hint: str | None = None


def detect_encoding(data: bytes) -> Encoding:
    if data.startswith(b"\xef\xbb\xbf"):
        return Encoding("utf-8", "bom")
    if data.startswith(b"\xff\xfe"):
        return Encoding("utf-16le", "bom")
    if data.startswith(b"\xfe\xff"):
        return Encoding("utf-16le", "bom", "UTF-16 BE 的 BOM：按 UTF-16 LE 解码，若有乱码请更换编码")
    try:
        data.decode("utf-8")
        return Encoding("utf-8", "utf8-valid")
    except UnicodeDecodeError as e:
        # A head can end inside a character.
        if e.start >= len(data) - 3 and e.reason == "unexpected end of data":
            return Encoding("utf-8", "utf8-valid")
        return Encoding("gb18030", "fallback", "不是合法 UTF-8：已按 GB18030 预览")


def decode(data: bytes, encoding: str) -> tuple[str, int]:
    """Text without a byte-order mark, and how many characters could not be decoded."""
    text = data.decode(encoding, "replace").removeprefix("﻿")
    return text, text.count("�")


def detect_delimiter(text: str, sample: int = 4096) -> str | None:
    """The most frequent delimiter outside quotes on the first line that is not empty."""
    counts, quoted, seen = dict.fromkeys(DELIMITERS, 0), False, False
    for c in text[:sample]:
        if c in "\r\n" and not quoted:
            if seen:
                break
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
        seen = True
    best = max(DELIMITERS, key=lambda d: counts[d])  # ties: the earlier one
    return best if counts[best] else None


def preview(text: str, lines: int = 8, chars: int = 160) -> tuple[list[str], bool, bool]:
    """First lines, and whether lines or characters were cut."""
    every = re.split(r"\r\n|\n|\r", text)
    head = every[:lines]
    return [x if len(x) <= chars else x[:chars] + "…" for x in head], len(every) > lines, any(len(x) > chars for x in head)


def line_breaks(text: str) -> int:
    return len(re.findall(r"\r\n|\r|\n", text))


#: Characters of a cell that the reader of delimited text takes; files are bounded by MAX_BYTES long before.
MAX_CELL = 2**31 - 1


class LimitExceeded(ValueError):
    """Raised by guards; rows are never cut instead."""


def guard(kind: str, limit: int, actual: int) -> None:
    if actual > limit:
        raise LimitExceeded(f"{kind}: {actual} is over {limit}")


def guard_grid(rows: int, columns: int) -> None:
    guard("rows", MAX_ROWS, rows)
    guard("columns", MAX_COLUMNS, columns)
    guard("cells", MAX_CELLS, rows * columns)

"""Text of cells: normalisation, null tokens, look-up keys, labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offersieve.schema import NULL_TOKENS, OTHER, UNKNOWN

#: White space as the domain sees it, for character classes of Java patterns.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_ZERO_WIDTH = r"[\u200B-\u200D\uFEFF]"
#: Found in every text that plain_text would change (and in few others: ranges are searched faster than single signs).
_NOT_PLAIN = r"[\t-\r\u00A0\u1680\u2000-\u200D\u2028-\u202F\u205F\u3000\uFEFF]| (?: |$)|^ "


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility form; ASCII text, the common case, never leaves the JVM's plain branch."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_nfkc(c))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


@F.arrow_udf(T.ArrayType(T.StringType()))
def nfkc_cells(rows: pa.Array) -> pa.Array:
    """Compatibility form of a row's cells at once: Python functions can't stand inside lambdas. Equal cells of a batch are changed once."""
    cells = rows.flatten().dictionary_encode()
    forms = pa.array([unicodedata.normalize("NFKC", x) for x in cells.dictionary.to_pylist()], cells.dictionary.type)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(rows), 0)).cast("int32")
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], "int32"), ends]), forms.take(cells.indices), mask=rows.is_null())


def plain_text(c: Column) -> Column:
    """cell_text of a text in compatibility form."""
    return trim_space(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _ZERO_WIDTH, ""), f"[{SPACE}]+", " "))


def plain_cells(cells: Column) -> Column:
    """plain_text of each cell, null for null: most cells stand as they are, which one search tells."""
    return F.transform(cells, lambda c: F.when(c.rlike(_NOT_PLAIN), plain_text(c)).otherwise(c))


def plain_key(c: Column) -> Column:
    """header_key of a text in compatibility form; of a plain_text that is its lower case."""
    return F.lower(trim_space(F.regexp_replace(F.coalesce(c, F.lit("")), _ZERO_WIDTH, "")))


def cell_text(c: Column) -> Column:
    """'' for null; zero-width signs out, compatibility form, runs of white space to one space, trimmed."""
    return plain_text(nfkc(F.regexp_replace(F.coalesce(c, F.lit("")), _ZERO_WIDTH, "")))


def header_key(c: Column) -> Column:
    """Key of headers and dictionary words: like cell_text, lower-cased, inner white space kept."""
    return plain_key(nfkc(F.regexp_replace(F.coalesce(c, F.lit("")), _ZERO_WIDTH, "")))


def header_key_of(text: str) -> str:
    """header_key for a driver-side string."""
    kept = "".join(ch for ch in text if ch not in "\u200b\u200c\u200d\ufeff")
    return unicodedata.normalize("NFKC", kept).strip().lower()


def lookup_key(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, f"[{SPACE}]+", ""))


def is_null_token(text: Column) -> Column:
    return F.lower(text).isin([t.lower() for t in NULL_TOKENS])


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{SPACE}]")


def value_or_null(c: Column) -> Column:
    """Normalised text, null if it stands for missing."""
    text = cell_text(c)
    return F.when(~is_null_token(text), text)


def text_or_unknown(c: Column) -> Column:
    """Group label: the value as it is, or 未知 if blank."""
    return F.when(is_blank(c), F.lit(UNKNOWN)).otherwise(c)


def tri_label(c: Column, yes: str = "是", no: str = "否", unknown: str = UNKNOWN) -> Column:
    return F.when(c, F.lit(yes)).when(~c, F.lit(no)).otherwise(F.lit(unknown))


def tri_state_of(label: Column, yes: str = "是", no: str = "否") -> Column:
    """A label of tri_label as a boolean again; null for any other."""
    return F.when(label == yes, True).when(label == no, False)


def key_text(c: Column) -> Column:
    """Benchmark key part: control signs out, trimmed."""
    return trim_space(F.regexp_replace(c, r"[\x00-\x1F\x7F]", ""))


def says_something(part: Column) -> Column:
    return part.isNotNull() & ~part.isin("", UNKNOWN, OTHER)


def looks_like_identifier(c: Column) -> Column:
    """Starts with an ASCII letter or digit, and has - or _ or twelve signs or more."""
    return c.rlike("^[A-Za-z0-9]") & (c.rlike("[-_]") | (F.length(c) >= 12))


def shortened(c: Column, most: int = 12) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def display_id(c: Column) -> Column:
    """C- and six hex digits of a 24-bit polynomial (times 31) over the id's code units."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    value = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: (acc * 31 + x) % (1 << 24))
    return F.concat(F.lit("C-"), F.lpad(F.upper(F.hex(value)), 6, "0"))


def stable_digest(text: str) -> str:
    """32-bit FNV-1a over code points, eight upper-case hex digits."""
    h = 0x811C9DC5
    for ch in text:
        h = ((h ^ ord(ch)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08X}"


def duplicate_key(cells: Column) -> Column:
    """Exact-duplicate key of a row's cells."""
    return F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), "\u001f")


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", " ")


def safe_cell(c: Column) -> Column:
    """A leading apostrophe before what a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c

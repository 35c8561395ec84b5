"""Digests that are the same for the same content, in whatever order or partitions it comes.

`canonical` writes a value as text in one way only.  `table_digest` is that of a table as a multiset of rows: each row's
SHA-256 is taken as four numbers of 64 bits, tasks add them up apart, sums are added in a tree like any aggregate, and
the digest is that of the sums and the count.  A row that is added, removed, changed or repeated changes it; order and
partitions don't.  It tells changes, not forgeries: sums can be matched by someone who chooses rows for it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions.text import stable_digest
from offersieve.schema import REASON_CATEGORIES

_LANES = 4


def canonical(value: object) -> str:
    """JSON with sorted keys and nothing left out; whole numbers have no point, sets are sorted lists."""

    def plain(v: object) -> object:
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (set, frozenset)):
            return sorted((plain(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False))
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def row_text(df: DataFrame) -> Column:
    """A row as text: columns in the order of their names, each value with its length, so that no two rows read alike.

    Doubles count to nine places.
    """
    parts = []
    for name, kind in sorted(df.dtypes):
        c = F.col(f"`{name}`")
        text = (c.cast("decimal(38,9)") if kind in ("double", "float") else F.to_json(F.struct(c)) if kind.startswith(("array", "map", "struct")) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws(",", *parts)


def _lanes(row: Column) -> list[Column]:
    digest = F.sha2(row, 256)
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(_LANES)]


def table_digests(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_rows, digest) of each group of rows; the keys are part of the rows."""
    lanes = [F.sum(x).alias(f"_lane{i}") for i, x in enumerate(_lanes(row_text(df)))]
    sums = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *lanes)
    whole = [F.coalesce(F.col(f"_lane{i}") % F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(0)).cast("decimal(20,0)").cast("string") for i in range(_LANES)]
    return sums.select(*keys, "n_rows", F.sha2(F.concat_ws(",", F.col("n_rows").cast("string"), *whole), 256).alias("digest"))


def table_digest(df: DataFrame) -> str:
    """The digest of all rows; an empty table has one, too."""
    return table_digests(df).first()["digest"]


def preview_digest(payload: Mapping[str, object], instructions: str = "", model: str = "", level: str = "") -> str:
    """Of everything that would be sent: what was shown is what is sent only if it is the same."""
    return stable_digest(canonical({"payload": payload, "instructions": instructions, "model": model, "level": level}))


def rules_digest(categories: Mapping[str, str], gpt_list: Sequence[str] | None = None, gpt_list_mode: bool | None = None, aliases: Sequence[tuple[str, str]] | None = None, version: str | None = None) -> str:
    """Of the local rules that a summary depends on; a list that is not there and an empty one differ."""
    counts = {"gptList": None if gpt_list is None else len(gpt_list), "aliases": None if aliases is None else len(aliases)}
    return stable_digest(canonical({"categories": categories, "mode": gpt_list_mode, "version": version, "reasons": REASON_CATEGORIES} | counts))

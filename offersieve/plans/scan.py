"""Scans of texts for sensitive values: exact, and one pass over the texts however many values there are.

Sentinels are compared without case and without the white space around them; a text holds one if it stands anywhere in
it.  Their list is checked by its bytes: up to BLOCK_BYTES they are one automaton, built once in each Python worker.  A
longer list goes through a filter and a join: each sentinel marks the hashes of its beginning (the longest run of 1, 2, 4,
8... bytes that it has) and of all its bytes in a bit array of FILTER_BITS at most, which every task gets.  Places of a
text whose beginning is marked are tried with the lengths that occur; spans whose bytes are marked, too, are joined with
the sentinels byte by byte, so wrong marks cost rows and change nothing.  No number of sentinels is too large, none is left
out, and no join compares texts with words.  With more than FILTER_BITS / 64 sentinels the array is fuller, and more
spans go to the join.

Null and empty sentinels are none; null and empty texts hold none.  Repeated sentinels count once, repeated rows each.
Columns of any name may stand beside the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.session import ship
from offersieve.tables import stored

BLOCK_BYTES = 1 << 19
#: 64 MB at most; 64 bits for each sentinel, of which it marks four.
FILTER_BITS = 1 << 29
#: Bytes of text whose hashes stand in memory at once, and bytes of spans.
_PIECE, _TAKEN = 1 << 16, 1 << 23
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(17).integers(0, 1 << 64, 256, np.uint64)
_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)
_built: dict[str, ahocorasick.Automaton] = {}


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    """Finds words, which are in lower case already; each match gives its word's number."""
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def normalised(value: Column) -> Column:
    return F.lower(F.trim(value))


def _words(sentinels: DataFrame, value: str) -> tuple[DataFrame, int, int]:
    """Different sentinels as `w`, how many they are and how many bytes they have."""
    words = stored(sentinels.select(normalised(F.col(value)).alias("w")).where("w <> ''").distinct(), "sentinels")
    n, size = words.agg(F.count("*"), F.sum(F.octet_length("w"))).first()
    return words, n, size or 0


def _finder(texts: DataFrame, words: list[str]):
    """A function of a lower-cased text: the numbers of the different words that it holds."""
    shared = ship(texts.sparkSession).sparkContext.broadcast("\0".join(words))
    name = f"{texts.sparkSession.sparkContext.applicationId}/{shared._jbroadcast.id()}"

    def found(column: pd.Series) -> pd.Series:
        if name not in _built:
            _built.clear()
            _built[name] = automaton(shared.value.split("\0"))
        search = _built[name].iter
        return pd.Series([sorted({i for _, i in search(t)}) if t else [] for t in column])

    return F.pandas_udf(found, "array<int>")


def _joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = first * _ODD + last
    out ^= out >> np.uint64(32)
    out *= _MORE
    return out


def _levels(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all runs of 1, 2, 4... bytes, up to longest, by where they begin."""
    size, hashes = 1, _BYTE[data]
    while size <= longest and len(hashes):
        yield size, hashes
        hashes = _joined(hashes[:-size], hashes[size:])
        size *= 2


def _whole(hashes: np.ndarray, size: int, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of spans of size to 2 * size - 1 bytes, from those of their first and last size bytes."""
    return _joined(hashes[starts + length - size] + np.asarray(length).astype(np.uint64), hashes[starts])


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    shift = np.uint64(64 - bits)
    return hashes >> shift, (hashes * _MORE) >> shift


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the hashes whose two places are marked."""
    shift = np.uint64(64 - (len(marks) * 64 - 1).bit_length())
    octets = marks.view(np.uint8)  # little-endian, as everywhere here
    bit = lambda x: octets.take((x >> np.uint64(3)).view(np.int64)) & _BIT.take((x & np.uint64(7)).view(np.int64))
    at = np.flatnonzero(bit(hashes >> shift))
    return at[bit((hashes[at] * _MORE) >> shift) > 0]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where its values begin and end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), ends - ends[0]


def _filter(words: DataFrame, n: int, longest: int, most: int) -> np.ndarray:
    """The bit array that the sentinels mark."""
    bits = min(most.bit_length() - 1, max((64 * n - 1).bit_length(), 10))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, edges = _buffers(b.column(0))
            starts, lengths, found = edges[:-1], np.diff(edges), []
            for size, hashes in _levels(data, longest):
                own = (lengths >= size) & (lengths < 2 * size)
                if own.any():
                    found += [*_places(hashes[starts[own]], bits), *_places(_whole(hashes, size, starts[own], lengths[own]), bits)]
            at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "marks"])

    got = words.select(F.col("w").cast("binary")).mapInArrow(places, "at int, marks long").groupBy("at").agg(F.bit_or("marks").alias("marks")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["at"].to_numpy()] = got["marks"].to_numpy().view(np.uint64)
    return out


def _spans(rows: DataFrame, text: str, words: DataFrame, n: int, most: int) -> DataFrame:
    """(_row, w): the sentinels, as bytes, that the text of each row holds, each once; rows have numbers in _row."""
    lengths = np.sort(words.select(F.octet_length("w").alias("n")).distinct().toArrow()["n"].to_numpy())
    longest = int(lengths[-1])
    shared = ship(rows.sparkSession).sparkContext.broadcast(_filter(words, n, longest, most))

    def different(parts: list[pa.Table]) -> list[pa.Table]:
        return [pa.concat_tables(parts).group_by(["_row", "w"]).aggregate([])] if parts else []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for b in batches:
            data, edges = _buffers(b.column(1))
            number, found = b.column(0).to_numpy(), []
            for a in range(0, len(data), _PIECE):
                part, here = data[a : a + _PIECE + longest - 1], []
                for size, hashes in _levels(part, longest):
                    own = lengths[(lengths >= size) & (lengths < 2 * size)]
                    at = _marked(marks, hashes[:_PIECE]) if len(own) else []
                    if not len(at):
                        continue
                    row = np.searchsorted(edges, at + a, "right") - 1
                    room = edges[row + 1] - a - at
                    for length in own.tolist():
                        fits = np.flatnonzero(room >= length)
                        fits = fits[_marked(marks, _whole(hashes, size, at[fits], length))]
                        step = max(1, _TAKEN // length)
                        for k in range(0, len(fits), step):
                            some = fits[k : k + step]
                            taken = part[at[some][:, None] + np.arange(length)]
                            ends = np.arange(len(some) + 1, dtype=np.int32) * length
                            w = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(taken)])
                            here += different([pa.table({"_row": number[row[some]], "w": w})])
                found += different(here)
            for t in different(found):
                yield from t.select(["_row", "w"]).to_batches()

    lower = F.coalesce(F.lower(F.col(text)).cast("binary"), F.lit(b""))
    spans = rows.select("_row", lower.alias("_text")).mapInArrow(search, "_row long, w binary")
    return spans.join(words.select(F.col("w").cast("binary")), "w").select("_row", "w")


def _numbered(texts: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows get their number once, so that what is found speaks of the same ones."""
    kept = columns if text in columns else [*columns, text]
    return stored(texts.select(*kept, F.monotonically_increasing_id().alias("_row")), "texts")


def sentinel_hits(texts: DataFrame, sentinels: DataFrame, text: str = "text", value: str = "value", block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """texts' columns and `sentinel`, a row for each different sentinel (as compared) that a row's text holds."""
    rest = [c for c in texts.columns if c != "sentinel"]
    words, n, size = _words(sentinels, value)
    if not n:
        return texts.select(*rest, F.lit(None).cast("string").alias("sentinel")).where("false")
    if size > block_bytes:
        rows = _numbered(texts, rest, text)
        found = _spans(rows, text, words, n, filter_bits).select("_row", F.col("w").cast("string").alias("sentinel"))
        return rows.join(found, "_row").select(*rest, "sentinel")
    listed = sorted(r.w for r in words.collect())
    names = texts.sparkSession.createDataFrame(list(enumerate(listed)), "_number int, sentinel string")
    number = _finder(texts, listed)(F.lower(F.col(text)))
    return texts.select(*rest, F.explode(number).alias("_number")).join(names, "_number").select(*rest, "sentinel")


def sentinel_counts(texts: DataFrame, sentinels: DataFrame, text: str = "text", value: str = "value", name: str = "n_sentinels", block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """texts with how many different sentinels each row's text holds; a column of that name is replaced."""
    rest = [c for c in texts.columns if c.lower() != name.lower()]
    words, n, size = _words(sentinels, value)
    if size <= block_bytes:
        count = F.size(_finder(texts, sorted(r.w for r in words.collect()))(F.lower(F.col(text)))) if n else F.lit(0)
        return texts.select(*rest, count.cast("long").alias(name))
    rows = _numbered(texts, rest, text)
    total = _spans(rows, text, words, n, filter_bits).groupBy("_row").agg(F.count("*").alias("_n"))
    return rows.join(total, "_row", "left").select(*rest, F.coalesce("_n", F.lit(0)).cast("long").alias(name))


def rows_with_sentinels(texts: DataFrame, sentinels: DataFrame, text: str = "text", value: str = "value", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of texts, with their columns, whose text holds a sentinel."""
    name = "_n_sentinels"
    while name in {c.lower() for c in texts.columns}:
        name += "_"
    return sentinel_counts(texts, sentinels, text, value, name, block_bytes).where(F.col(name) > 0).drop(name)

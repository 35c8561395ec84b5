"""Document fingerprints: one-permutation MinHash, optimally densified, b bits a bin.

Every distinct shingle of five words is hashed once: the high bits choose its
bin, the rest is its value, and a bin keeps its least value.  An empty bin
takes the value of the first filled bin on its own fixed random walk.  The low
bits of each bin, packed and written in hex, are the fingerprint.  Likeness is
the share of equal bins, corrected for bins that agree by chance.

Null and empty texts, and texts without words, have the fingerprint ''; two
such fingerprints are alike (1.0), one such and another are not (0.0).
Repeated doc_ids follow one another in the order of their texts, null ones come
first.  For neighbours doc_id must be a number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offersieve.llm.hashing import mix, shingle_set
from offersieve.session import ship

BINS, BITS = 512, 4
#: Blocks of neighbouring doc_ids at most, as their bounds pass through the driver (1 GB a block at 100 TB).
MAX_BLOCKS = 100_000
#: Rows whose texts a worker holds as Python's at a time.
PART = 64
_WALK, _FIRST = 4096, 64
_STEPS: np.ndarray | None = None


@lru_cache(maxsize=1)
def _whole_walks() -> np.ndarray:
    return _walk(np.arange(BINS), 0, _WALK)


def _steps(empty: np.ndarray | None = None, at: int = 0, n: int = 32) -> np.ndarray:
    """The n bins from the at-th on that each empty bin visits; the first ones, which nearly always do, are kept.

    Without arguments the whole walks of all bins.
    """
    global _STEPS
    if empty is None:
        return _whole_walks()
    if _STEPS is None:
        _STEPS = _walk(np.arange(BINS), 0, _FIRST)
    return _STEPS[empty, at : at + n] if at + n <= _FIRST else _walk(empty, at, n)


def _walk(empty: np.ndarray, at: int, n: int) -> np.ndarray:
    number = (empty[:, None] * _WALK + np.arange(at + 1, at + n + 1)).astype(np.uint64)
    return (mix(number * np.uint64(0x9E3779B97F4A7C15) + np.uint64(23)) % np.uint64(BINS)).astype(np.int16)


def bins(shingles: np.ndarray) -> np.ndarray | None:
    """Low bits of each bin; None for an empty set."""
    if not len(shingles):
        return None
    h = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    where, value = (h >> np.uint64(55)).astype(np.int64), h & np.uint64((1 << 55) - 1)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, where, value)
    filled = np.zeros(BINS, bool)
    filled[where] = True
    empty = np.flatnonzero(~filled)
    at = 0
    while len(empty):
        if at >= _WALK:  # practically unreachable: go on to the next filled bin
            full = np.flatnonzero(filled)
            least[empty] = least[full[np.searchsorted(full, empty) % len(full)]]
            break
        seen = _steps(empty, at)
        hit = filled[seen]
        first = hit.argmax(1)
        found = hit[np.arange(len(empty)), first]
        least[empty[found]] = least[seen[found, first[found]]]
        empty, at = empty[~found], at + 32
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(low: np.ndarray | None) -> str:
    return "" if low is None else (low[::2] << 4 | low[1::2]).tobytes().hex()


def unpack(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    data = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([data >> 4, data & 15], 1).reshape(-1)


def fingerprint(text: str | None) -> str:
    return pack(bins(shingle_set(text)))


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity from two fingerprints' bins."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus a column fingerprint (replaced if there)."""
    ship(docs.sparkSession)
    make = F.pandas_udf(lambda s: s.map(fingerprint), T.StringType())
    return docs.withColumn("fingerprint", make(F.coalesce(text, F.lit(""))))


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most value: a binary search by halving steps, in built-in functions."""
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").try_cast("array<bigint>")  # folded to one constant
    steps = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))]) if cuts else F.array().cast("array<int>")
    ahead = lambda at, step: F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))


def _in_blocks(docs: DataFrame, rows_a_block: int) -> DataFrame:
    """Documents dealt to blocks of neighbouring doc_ids, each with the next block's first document.

    Adds block and ahead (true for the copy of the next block's first document; after the last block: the first's).
    """
    spark = ship(docs.sparkSession)
    if not isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        raise TypeError("neighbours are found by number: doc_id must be numeric")
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Blocks of 64 MB; a block is sorted and streamed, so beyond MAX_BLOCKS they may grow.
    most = min(MAX_BLOCKS, max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) >> 26))
    n = max(1, min(most, total // rows_a_block))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))
    blocked = docs.withColumn("block", F.when(F.col("doc_id").isNull(), 0).otherwise(_place(F.col("doc_id").cast("long"), cuts.tolist())))
    firsts = sorted(
        (r["block"], None if r["nulls"] else r["least"])
        for r in blocked.groupBy("block").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    )
    # As many rows as blocks.
    moves = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    moves = spark.createDataFrame(moves, T.StructType([T.StructField("first", docs.schema["doc_id"].dataType), T.StructField("to", T.IntegerType())]))
    ahead = docs.join(F.broadcast(moves), F.col("doc_id").eqNullSafe(F.col("first"))).select(*docs.columns, F.col("to").alias("block"), F.lit(True).alias("ahead"))
    return blocked.withColumn("ahead", F.lit(False)).unionByName(ahead)


def edited_fingerprints(docs: DataFrame, rows_a_block: int = 16) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter replaced by the next document's start).

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.
    """
    id_type = docs.schema["doc_id"]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = _in_blocks(docs, rows_a_block).repartition("block").sortWithinPartitions("block", "ahead", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (block, doc_id, text, fingerprint's bins)
        for batch in batches:
            for at in range(0, len(batch), PART):
                part, out = batch.slice(at, PART), []
                for block, ahead, doc_id, text in zip(*(part[c].to_pylist() for c in ("block", "ahead", "doc_id", "text")), strict=True):
                    own = bins(shingle_set(text)) if held is None or held[0] == block or not ahead else None
                    if held is not None and held[0] == block:
                        _, before, body, low = held
                        n = len(body)
                        edited = body[: n - n // 4] + text[: n // 4]
                        other = bins(shingle_set(edited))
                        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((before, n, digest, pack(low), pack(other), likeness(low, other), likeness(low, own)))
                    held = None if ahead else (block, doc_id, text, own)
                kinds = (part.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

    fields = [
        T.StructField("doc_id", id_type.dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ]
    names = [f.name for f in fields]
    return dealt.select("block", "ahead", "doc_id", "text").mapInArrow(run, T.StructType(fields))

"""Benchmark decontamination by template windows.

Words become template tokens: numbers, quantities, names (capitalised words)
and units after a number become placeholders of their type, other words their
lower-cased form without marks around it.  Windows of WINDOW template tokens
with at least LITERALS plain words are hashed and joined between benchmark and
documents.  On a run of windows that match at one offset, equal benchmark
values must always stand against equal document values; runs that break this
don't count.  An item leaks into a document if SHARE of its windows match.  So
a question whose numbers or names were exchanged throughout is found, and a
text that merely has its form is not.

Beside them stand word windows: all windows of WINDOW words as they are, but
for case and marks around them, with no bound on plain words.  SHARE of these
makes a leak too, so every item with a word is searched, and copies in other
case are found.  The result gives the kind of windows with the higher share,
template windows if both have the same.

Items of fewer than WINDOW words are one window of their length; template
windows have MIN_TOKENS words at least.  Such a short item is searched like
others, but a match may be chance: its rows are marked `short`, and `bits` says
how much a match tells, log2 of all rows of documents over those documents that
hold the item.  Documents are taken out for a short item only if it has
LEAST_BITS (it stands in less than one of a thousand).

Most words of a corpus stand in no item.  A window that holds such a word, other
than in a placeholder, matches nothing, so with the items' words at hand these
are not hashed, nor are the windows around them.  Null and empty texts hold nothing.  Repeated rows of a
document or an item give one result.  Rows with a null doc_id or item_id are
compared like others.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offersieve.llm.common import fresh_names, stored
from offersieve.llm.hashing import mix, series
from offersieve.session import ship

WINDOW, LITERALS, MIN_TOKENS, SHARE, LEAST_BITS = 8, 5, 3, 0.4, 10.0
#: Window hashes that are sent to every task at most (32 MB); beyond, all windows go through the join.
MAX_SENT = 4_000_000
#: Different words of items that are sent to every task at most; beyond, all words of documents are hashed.
MAX_VOCABULARY = 200_000
#: Characters of the texts whose windows are computed at once.
TOGETHER = 100_000
#: Words that a worker remembers while a task runs.
_REMEMBERED = 200_000
NUMBER, QUANTITY, NAME, UNIT = range(1, 5)
_SLOT = series(5, 71)
_PLACES = series(64, 73) | np.uint64(1)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/\-]*%?")
_QUANTITY = re.compile(r"[+-]?\d[\d.,]*[A-Za-zµ°]{1,4}")
#: Fixed words: units that are placeholders after a number.
UNITS = frozenset(
    "mm cm dm m km mg g kg t ml cl dl l s min h d days day hours hour minutes minute seconds second weeks week months month years year "
    "meters meter metres metre kilometers kilometres miles mile feet foot inches inch yards pounds pound ounces grams gram litres liters "
    "dollars dollar euros euro cents cent percent degrees degree mph kmh".split()
)
#: Kinds of windows.
TEMPLATE, WORDS = 0, 1


_MARKS = "\"'“”‘’«»()[]{}<>.,;:!?…*#$&%=_|~`^-–—¿¡"


def _hashes(word: str) -> tuple[int, int]:
    """A hash for templates and another one for words as they are."""
    digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


def _forms(word: str) -> tuple[str, str, str]:
    """A word without marks around it, its form in templates, and its form in word windows."""
    body = word.strip(_MARKS) or word
    low = body.lower()
    return body, low, low if body.isascii() else body.casefold()


def _kind(body: str, low: str) -> int:
    """0 for a plain word, UNIT for a unit if a number stands before it."""
    first = body[0]
    if first.isdecimal() or first in "+-":
        if _NUMBER.fullmatch(body):
            return NUMBER
        if _QUANTITY.fullmatch(body):
            return QUANTITY
    if first.isupper() and (len(body) == 1 or body[1:].islower()):
        return NAME
    return UNIT if low in UNITS else 0


class _Words(dict):
    """Numbers of words in three arrays: their kinds, their hashes in templates, and those of the words.

    A word that is not in the vocabulary (None: all are) has its kind as number, and 0 as hash outside placeholders.
    """

    def __init__(self, vocabulary: frozenset[str] | None = None) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.kinds, self.codes, self.plain = array("b", range(5)), array("Q", [0, *_SLOT[1:UNIT].tolist(), 0]), array("Q", [0] * 5)

    def __missing__(self, word: str) -> int:
        if not word:  # what stands between texts
            return 0
        if word.isascii() and word.isalpha() and word.islower():
            low, folded, at = word, word, UNIT if word in UNITS else 0
        else:
            body, low, folded = _forms(word)
            at = _kind(body, low)
        if self.vocabulary is None or low in self.vocabulary or folded in self.vocabulary:
            kind, at, (code, plain) = at, len(self.kinds), _hashes(low)
            if folded != low:
                _, plain = _hashes(folded)
            self.kinds.append(kind)
            self.codes.append(int(_SLOT[kind]) if 0 < kind < UNIT else code)
            self.plain.append(plain)
        if len(word) <= 40:
            self[word] = at
        return at


_words = _Words()


def _read(texts: list[str | None], memory: _Words) -> tuple[list[str], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts and an empty one after each text, where each text begins, template hashes, which of them are placeholders, and word hashes."""
    if max(len(memory), len(memory.kinds)) >= _REMEMBERED:
        memory.forget()
    words, starts = [], []
    for text in texts:
        starts.append(len(words))
        words += (text or "").split()
        words.append("")
    at = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
    kinds, codes, plain = (np.frombuffer(x, t)[at] for x, t in ((memory.kinds, np.int8), (memory.codes, np.uint64), (memory.plain, np.uint64)))
    unit = np.zeros(len(words), bool)
    unit[1:] = (kinds[1:] == UNIT) & (kinds[:-1] == NUMBER)
    codes[unit] = _SLOT[UNIT]
    return words, starts, codes, (unit | ((kinds > 0) & (kinds != UNIT))), plain


def template(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, template hashes, and which of them are placeholders."""
    words, _, codes, slots, _ = _read([text], _words)
    return words[:-1], codes[:-1], slots[:-1]


def windows(codes: np.ndarray, slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of n tokens that have enough plain words and no unknown one."""
    edges = np.concatenate([[-1], np.flatnonzero(codes == 0), [len(codes)]])
    room = np.maximum(np.diff(edges) - n, 0)
    ends = np.cumsum(room)
    at = np.repeat(edges[:-1] + 1 - ends + room, room) + np.arange(ends[-1])
    filled = np.concatenate([[0], np.cumsum(~slots)])
    at = at[filled[at + n] - filled[at] >= min(LITERALS, n)]
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h += codes[at + i] * _PLACES[i]
    return at, mix(h + np.uint64(n))


def _windows(texts: list[str | None], lengths: list[tuple[int, int]], memory: _Words, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int, int, list[str]]]:
    """(text, start, kind, n, hash, words in the placeholders) of the windows of each (kind, n) whose hash is wanted (None: all)."""
    words, starts, codes, slots, plain = _read(texts, memory)
    none = np.zeros(len(words), bool)
    for kind, n in lengths:
        own, held = (codes, slots) if kind == TEMPLATE else (plain, none)
        at, h = windows(own, held, n)
        if wanted is not None and len(at):
            hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            at, h = at[hit], h[hit]
        text = np.searchsorted(starts, at, "right") - 1
        for i, a, x in zip(text.tolist(), at.tolist(), h.view(np.int64).tolist(), strict=True):
            yield i, a - starts[i], kind, n, x, [words[j] for j in range(a, a + n) if held[j]]


def _together(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in groups of about TOGETHER characters, each with its place."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= TOGETHER or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _vocabulary(texts: DataFrame) -> frozenset[str] | None:
    """The forms of the words of texts; None if there are more than MAX_VOCABULARY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {form for text in b.column(0).to_pylist() for word in (text or "").split() for form in _forms(word)[1:]}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["word"])

    found = texts.select("text").mapInArrow(run, "word string").distinct().limit(MAX_VOCABULARY + 1).collect()
    return frozenset(r[0] for r in found) if len(found) <= MAX_VOCABULARY else None


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, at, kind, n, window, values): values are the words in a template window's placeholders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words()
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1).to_pylist()):
                n = min(WINDOW, len((text or "").split()))
                lengths = [(TEMPLATE, n)] * (n >= MIN_TOKENS) + [(WORDS, n)] * (n > 0)
                rows += [(i, *row[1:]) for row in _windows([text], lengths, memory)]
            take, at, kind, n, h, values = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), pa.array(at, pa.int32()), pa.array(kind, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(values, pa.list_(pa.string()))],
                ["item_id", "item_at", "kind", "n", "window", "item_values"],
            )

    fields = [benchmark.schema["item_id"], T.StructField("item_at", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("window", T.LongType()), T.StructField("item_values", T.ArrayType(T.StringType()))]
    return benchmark.select("item_id", "text").mapInArrow(run, T.StructType(fields))


def _document_windows(docs: DataFrame, lengths: list[tuple[int, int]], wanted: np.ndarray | None, vocabulary: frozenset[str] | None) -> DataFrame:
    """(doc_id, at, window, values) of windows of the kinds and lengths whose hash is wanted (None: all) and whose words are in the vocabulary (None: all)."""
    sent = docs.sparkSession.sparkContext.broadcast((wanted, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers outlive their tasks, so what a task remembers is its own.
        known, memory = sent.value[0], _Words(sent.value[1])
        for b in batches:
            rows = []
            for start, texts in _together(b.column(1).to_pylist()):
                rows += [(start + i, a, x, values) for i, a, _, _, x, values in _windows(texts, lengths, memory, known)]
            take, at, h, values = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), pa.array(at, pa.int32()), pa.array(h, pa.int64()), pa.array(values, pa.list_(pa.string()))],
                ["doc_id", "doc_at", "window", "doc_values"],
            )

    fields = [docs.schema["doc_id"], T.StructField("doc_at", T.IntegerType()), T.StructField("window", T.LongType()), T.StructField("doc_values", T.ArrayType(T.StringType()))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, share, n_changed, short, bits): items that leak into a document."""
    spark = ship(docs.sparkSession)
    # Equal items are compared once.
    named = benchmark.select("item_id", "text").where("text is not null").withColumn("text_key", F.sha2("text", 256))
    texts = stored(named.groupBy("text_key").agg(F.first("text").alias("text")), "items")
    items = stored(_item_windows(texts.select(F.col("text_key").alias("item_id"), "text")), "item_windows")
    totals = items.groupBy("item_id", "kind").agg(F.countDistinct("item_at").cast("long").alias("n_windows"), (F.max("n") < WINDOW).alias("short"))
    lengths = sorted((r[0], r[1]) for r in items.select("kind", "n").distinct().collect())
    hashes = items.select("window").distinct()
    wanted = np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64) if hashes.count() <= MAX_SENT else None
    if wanted is not None:
        wanted = np.sort(wanted)
    if not lengths:
        return named.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", *[F.lit(0).cast(t).alias(c) for c, t in (("n_windows", "long"), ("n_matched", "long"), ("share", "double"), ("n_changed", "long"), ("short", "boolean"), ("bits", "double"))]).where("false")
    found = _document_windows(docs, lengths, wanted, _vocabulary(texts))
    same = items.select("item_id", "item_at", "kind", "window", "item_values")
    joined = found.join(same, "window").where(F.size("doc_values") == F.size("item_values"))
    matched = stored(joined.select("doc_id", "item_id", "kind", "item_at", (F.col("doc_at") - F.col("item_at")).alias("offset"), F.arrays_zip("item_values", "doc_values").alias("values")), "matched")
    run = ["doc_id", "item_id", "kind", "offset"]
    values = matched.select(*run, F.explode("values").alias("v")).groupBy(*run, F.col("v.item_values").alias("own")).agg(F.min("v.doc_values").alias("low"), F.max("v.doc_values").alias("high"))
    slots = values.groupBy(*run).agg(
        F.max(F.col("low") != F.col("high")).alias("broken"), F.sum((F.col("low") != F.col("own")).cast("long")).alias("changed")
    )
    slots = slots.select(*[F.col(c).alias(f"_{c}") for c in run], "broken", "changed")
    whole = matched.join(slots, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in run], "left").where(~F.coalesce("broken", F.lit(False)))
    pairs = whole.groupBy("doc_id", "item_id", "kind").agg(F.countDistinct("item_at").cast("long").alias("n_matched"), F.max(F.coalesce("changed", F.lit(0))).cast("long").alias("n_changed"))
    kept = pairs.join(totals, ["item_id", "kind"]).withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= share)
    best = F.max(F.struct("share", -F.col("kind"), "n_windows", "n_matched", "n_changed", "short")).alias("best")
    kept = stored(kept.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*"), "leaks")
    held = kept.groupBy("item_id").agg(F.count("*").alias("held"))
    bits = F.log2(F.lit(float(max(1, docs.count()))) / F.col("held"))
    kept = kept.join(held.select("item_id", F.greatest(bits, F.lit(0.0)).alias("bits")), "item_id")
    kept = kept.withColumnRenamed("item_id", "text_key").join(named.select("text_key", "item_id").distinct(), "text_key")
    return kept.select("doc_id", "item_id", "n_windows", "n_matched", "share", "n_changed", "short", "bits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_bits: float = LEAST_BITS) -> DataFrame:
    """The rows of docs into which no item leaks; a short item must tell least_bits."""
    (bad,) = fresh_names(docs, "bad")
    found = leaks(docs, benchmark, share).where(~F.col("short") | (F.col("bits") >= least_bits)).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(stored(found, "leaking"), F.col("doc_id").eqNullSafe(F.col(bad)), "left_anti")

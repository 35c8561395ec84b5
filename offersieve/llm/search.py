"""Ranked lexical search by sort-based accumulation.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased.  One pass over the
documents keeps, for each, how many terms it has and which terms of the items, how often.  From these postings come the
number of documents N, of terms L and each term's document frequency, and so its weight.  Then every task takes a range
of documents: the item-document-impact entries of all its matched terms are concatenated, their packed keys (item, document)
are sorted by radix, equal keys are summed with reduceat, and a heap of each item's best documents is kept.  No two tasks
share a key, so only k rows of an item leave a task; these meet in two rounds.

Entries are worked off in chunks of CHUNK, so a task's memory doesn't depend on its documents.  Items are a stated query
set: they are taken in blocks of about BLOCK_BYTES of text, each with one pass over all documents, so no number of items
is too large.  Terms are looked up by a 64-bit hash and then compared byte by byte.

A null text, of a document or item, has no terms, like an empty one; such documents are not counted in N.  Rows alike in
item_id and text are one item; different texts of one item_id are ranked each on their own.  Each row of documents is a
document, whether its id is repeated or not; a null doc_id is before all others among equal scores.  An empty table on
either side gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offersieve.llm.common import stored
from offersieve.llm.hashing import series
from offersieve.llm.rolling import spans, sums

BLOCK_BYTES, CHUNK, PIECE = 4 << 20, 1 << 20, 1 << 19
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about PIECE bytes, with their numbers; long texts are cut between terms."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at, n = 0, len(text or b"")
        while at < n:
            to = min(at + PIECE, n)
            while to < n and _IN_TERM[text[to]]:
                to += 1
            numbers.append(i)
            parts.append(text[at:to])
            size, at = size + to - at, to
            if size >= PIECE:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def _terms(numbers: list[int], parts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, and of each term its start, end, hash and the number of its text."""
    low = _LOWER[np.frombuffer(b" ".join(parts), np.uint8)]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _IN_TERM[low]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    owner = np.asarray(numbers)[np.searchsorted(begins, starts, "right") - 1]
    return low, starts, ends, spans(sums(letters[low]), starts, ends), owner


class Vocabulary:
    """The items' terms: sorted hashes, bytes to compare with, and for each term the items that hold it, with repeats."""

    def __init__(self, texts: list[str | None]) -> None:
        data = [(t or "").encode() for t in texts]
        seed, held = 0, {}
        while True:  # once, but for a clash of two terms' hashes
            self.letters, held, hashes = series(256, 23 + seed), {}, {}
            for numbers, parts in _pieces(data):
                low, starts, ends, found, owner = _terms(numbers, parts, self.letters)
                for a, b, h, i in zip(starts.tolist(), ends.tolist(), found.tolist(), owner.tolist(), strict=True):
                    term = low[a:b].tobytes()
                    hashes[term] = h
                    counts = held.setdefault(term, {})
                    counts[i] = counts.get(i, 0) + 1
            if len({*hashes.values()}) == len(hashes):
                break
            seed += 1
        terms = sorted(hashes, key=hashes.get)
        self.hashes = np.array([hashes[t] for t in terms], np.uint64)
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(terms), np.uint8)
        self.sizes = np.array([len(held[t]) for t in terms], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([i for t in terms for i in held[t]], np.int64)
        self.repeats = np.array([n for t in terms for n in held[t].values()], np.int64)

    def matches(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in here, and their numbers; the same hash alone does not do."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == ends - starts))
        at = at[hit]
        if not len(hit):
            return hit, at
        lengths = self.lengths[at]
        begins = np.cumsum(lengths) - lengths
        inner = np.arange(lengths.sum()) - np.repeat(begins, lengths)
        same = low[np.repeat(starts[hit], lengths) + inner] == self.bytes[np.repeat(self.offsets[at], lengths) + inner]
        equal = np.logical_and.reduceat(same, begins)
        return hit[equal], at[equal]


def _summed(keys: np.ndarray, values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's values."""
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of keys under 2**bits, sorted by 16 bits at a time from the lowest."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many it has, and which of the items' terms how often."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    many = max(1, len(vocabulary.hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary()).to_pylist()
            count, keys, counts = np.zeros(len(texts), np.int64), [], []
            for numbers, parts in _pieces(texts):
                low, starts, ends, hashes, owner = _terms(numbers, parts, vocabulary.letters)
                count += np.bincount(owner, minlength=len(texts))
                hit, at = vocabulary.matches(low, starts, ends, hashes)
                k, n = np.unique(owner[hit] * many + at, return_counts=True)
                keys.append(k)
                counts.append(n)
            keys = np.concatenate([np.zeros(0, np.int64), *keys])
            if len(keys):  # a long text's pieces
                keys, tfs = _summed(keys, np.concatenate(counts), np.argsort(keys, kind="stable"))
            else:
                tfs = keys
            left = np.flatnonzero(count)
            ends = np.searchsorted(keys // many, left, "right")
            offsets = np.r_[0, ends].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((keys % many).astype(np.int32), tfs.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(left)), pa.array(count[left]), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _best(postings: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task's range of documents."""
    kind = postings.schema["doc_id"].dataType.simpleString()
    n_items = int(vocabulary.items.max()) + 1 if len(vocabulary.items) else 0

    def rank(heaps: dict[int, list], least: np.ndarray, items: np.ndarray, ids: list, places: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= np.maximum(least[items], 1)
        items, places, scores = items[keep], places[keep], scores[keep]
        edges = np.r_[np.flatnonzero(np.r_[True, items[1:] != items[:-1]]), len(items)] if len(items) else [0]
        for a, b in pairwise(edges):
            own = scores[a:b]
            chosen = np.flatnonzero(own >= np.partition(own, b - a - k)[b - a - k]) if b - a > k else range(b - a)
            fresh = [(-int(own[j]), ids[places[a + j]] is not None, ids[places[a + j]]) for j in chosen]
            heap = heaps[int(items[a])] = heapq.nsmallest(k, heaps.get(int(items[a]), []) + fresh, key=lambda x: (x[0], x[1], x[2] if x[1] else 0))
            if len(heap) == k:
                least[items[a]] = -heap[-1][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, least, kind_ = {}, np.zeros(n_items, np.int64), pa.int64()
        for batch in batches:
            kind_ = batch.schema.field("doc_id").type
            ids, sizes = batch["doc_id"].to_pylist(), np.diff(batch["terms"].offsets.to_numpy())
            terms, tfs = batch["terms"].flatten().to_numpy(), batch["tfs"].flatten().to_numpy()
            # In Python's integers: the product of three counts may go beyond 64 bits.
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch["n"].to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(ids)), sizes)
            impacts = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc]))
            ends = np.cumsum(sizes)
            entries = np.r_[0, np.cumsum(vocabulary.sizes[terms])][np.r_[0, ends]]
            at, low = 0, len(ids).bit_length()
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(entries, entries[at] + CHUNK, "right")) - 1)
                part = slice(ends[at] - sizes[at], ends[to - 1])
                lengths = vocabulary.sizes[terms[part]]
                if lengths.sum():
                    inner = np.repeat(vocabulary.begins[terms[part]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                    keys = vocabulary.items[inner] << low | np.repeat(doc[part], lengths)
                    keys, scores = _summed(keys, vocabulary.repeats[inner] * np.repeat(impacts[part], lengths), radix_order(keys, low + n_items.bit_length()))
                    rank(heaps, least, keys >> low, ids, keys & ((1 << low) - 1), scores)
                at = to
        rows = [(i, x[2], -x[0]) for i, heap in heaps.items() for x in heap]
        if rows:
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), kind_, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return postings.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with rank; first among the rows of some tasks, then among what is left."""
    groups = max(1, math.isqrt(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    best = [F.desc("score"), F.asc_nulls_first("doc_id")]
    within = F.row_number().over(Window.partitionBy("item", "_group").orderBy(*best))
    some = found.withColumn("_group", F.spark_partition_id() % groups).withColumn("_rank", within).where(F.col("_rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*best))
    return some.select("item", "doc_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every item, best first."""
    spark = docs.sparkSession
    asked = stored(items.select("item_id", "text").where("text is not null").distinct(), "items")
    n_items, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = min(n_items, math.ceil((size or 0) / block_bytes))  # items without a letter make none
    parts = []
    for block in range(blocks):
        # About block_bytes of the query set at a time.
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        vocabulary = Vocabulary([r.text for r in rows])
        if not len(vocabulary.hashes):
            continue
        postings = stored(_postings(docs, vocabulary), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # terms of the block
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary.hashes))], np.int64)
        found = stored(_best(postings, vocabulary, weights, n_docs, n_terms, k), "best")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(_ranked(found, k).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out

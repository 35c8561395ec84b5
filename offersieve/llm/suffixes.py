"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a SPAN-byte string that covers it also starts in a document with
a smaller doc_id.  Equal strings must meet in one task without a sort of all
suffixes: each SPAN-byte string is owned by the least hash of its KEY-byte
parts, so equal strings have equal owners, and neighbouring strings of one
owner are one context.  Documents are packed into blobs of some megabytes, and
packs and buckets of owners exchange blobs in three rounds:

1. owners: which stand in two documents at all, and which in a crowd of
   different contexts;
2. contexts of the former by 128-bit hash: an owner whose contexts are all equal
   is settled;
3. the bytes of the contexts that differ.  A bucket deals them to shards, builds
   each shard's Burrows-Wheeler transform and merges the transforms by refining
   their interleave symbol pair by symbol pair.  The blocks that remain after as
   many symbols as a string has are the intervals of the common prefixes, and
   the least doc_id of an interval is the answer for each of its strings.

In the transforms an owner's bytes are written as the number that they have in
their bucket, which is exact: strings of one block whose owner stands at one
place are equal byte for byte.  A crowded owner (over CROWD contexts) is dealt
out string by string from the first round on, so no owner's group outgrows a task.

A bucket is for BUCKET bytes of text.  Up to DIRECT buckets each pack sends each
a blob.  Beyond, blobs take two hops: a pack sends to as many groups of buckets
as the root of their number, where the blobs of a squad of packs are joined by
bucket; answers go back the same way.  So no blob gets tiny.

Null and empty texts, and texts under SPAN bytes, lose nothing.  doc_id is an
integer.  Rows of equal doc_id don't remove from one another.  A null doc_id is
before all others (and equal to the least long).  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from offersieve.llm.common import stored
from offersieve.llm.hashing import _powers, mix, series
from offersieve.session import ship

SPAN, KEY = 50, 24
WIDTH = SPAN - KEY + 1
PACK = 4 << 20
#: Different contexts of one owner beyond which they are dealt out string by string.
CROWD = 4_000
SHARDS = 4
#: Bytes of text a bucket, and buckets that packs send to without a second hop.
BUCKET, DIRECT = 16 << 20, 4096
_SIDE, _MARK = SPAN - KEY, 4
_DEPTH = _SIDE + _MARK
_PIECE = 1 << 20
#: Short documents whose contexts are found at once, and text whose strings a bucket merges at once, in bytes.
_GROUP, PART = 1 << 17, 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_BYTES, _OTHER_BYTES = series(256, 83), series(256, 89)
_FIRST = np.iinfo(np.int64).min
_NEVER = np.iinfo(np.int64).max
_BASE = 0xC6BC279692B5C323
_tables: list[np.ndarray] = []


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return zstandard.compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, sizes of the documents inside): short documents together, longer ones than _PIECE in overlapping parts."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        start = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, start + _GROUP, "right")))
        if sizes[at] > _PIECE:
            for a in range(start, int(ends[at]) - SPAN + 1, _PIECE):
                z = min(a + _PIECE + SPAN - 1, int(ends[at]))
                yield a, z, np.array([z - a])
        else:
            yield start, int(ends[to - 1]), sizes[at:to]
        at = to


def contexts(data: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(owner hash, context hash, second context hash, start, owner's place, end) of the contexts of documents of these sizes, one by default."""
    if not _tables:
        _tables.extend((_powers(_BASE, _PIECE + SPAN + 1), _powers(pow(_BASE, -1, 1 << 64), _PIECE + SPAN + 1)))
    power, inverse = _tables
    out = []
    for a, z, inside in _pieces(np.array([len(data)]) if sizes is None else sizes):
        b = data[a:z]
        many = np.maximum(inside - SPAN + 1, 0)
        # Starts whose string ends in the same document; so does its owner, and owners of two documents are different places.
        starts = np.repeat(np.cumsum(inside) - inside, many) + _ragged(many)
        if not len(starts):
            continue
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * power[: len(b)], out=sums[1:])
        keys = mix((sums[KEY:] - sums[:-KEY]) * inverse[: len(b) - KEY + 1])
        # Least hash, rightmost on ties; a place fits the low bits.
        ranked = (keys & ~_PLACE) | (_PLACE - np.arange(len(keys), dtype=np.uint64))
        owner = (_PLACE - (_sliding_min(ranked, WIDTH)[starts] & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], len(owner)] - 1
        place, first, end = owner[first], starts[first], starts[last] + SPAN
        body = mix((sums[end] - sums[first]) * inverse[first] + (place - first).astype(np.uint64))
        np.cumsum(_OTHER_BYTES[b] * power[: len(b)], out=sums[1:])
        other = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
        out.append((keys[place], body, other, first + a, place + a, end + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 3


def _bucket_slices(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys; a bucket is a key's leading bits."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges, np.r_[edges[1:], len(keys)], strict=True)]


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, joined."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class _Replay:
    """What a pack asks in each round, given the answers to the rounds before."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, blob: bytes, bits: int):
        self.bits, self.ids, self.sizes = bits, ids, sizes
        self.data = np.frombuffer(zstandard.decompress(blob, max_output_size=int(sizes.sum()) or 1), np.uint8)
        self.offsets = np.cumsum(sizes) - sizes
        self.owner, self.body, self.other, self.start, self.place, self.end = contexts(self.data, sizes)
        self.doc = ids[np.searchsorted(self.offsets + sizes, self.start, "right")]
        self.owners, self.which = np.unique(self.owner, return_inverse=True)

    def ask_owners(self) -> Iterator[tuple[int, bytes]]:
        low, high = np.full(len(self.owners), _NEVER), np.full(len(self.owners), _FIRST)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        # The bits after the bucket's, whether two documents of this pack have the owner, and its different contexts here: six bytes.
        _, first = np.unique(self.body ^ mix(self.owner), return_index=True)
        kinds = np.minimum(np.bincount(self.which[first], minlength=len(self.owners)), 255)
        short = ((self.owners << np.uint64(self.bits)) >> np.uint64(25)) << np.uint64(1) | (low < high)
        short = (short | kinds.astype(np.uint64) << np.uint64(40)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        for bucket, a, b in _bucket_slices(self.owners, self.bits):
            yield bucket, short[a:b].tobytes()

    def hear_owners(self, answers: dict[int, bytes]) -> None:
        shared, crowded = np.zeros(len(self.owners), bool), np.zeros(len(self.owners), bool)
        for bucket, a, b in _bucket_slices(self.owners, self.bits):
            bits = np.unpackbits(np.frombuffer(answers[bucket], np.uint8)).reshape(2, -1)
            shared[a:b], crowded[a:b] = bits[:, : b - a]
        at = np.flatnonzero(shared[self.which])
        at = at[np.lexsort((self.other[at], self.body[at], self.owner[at]))]
        owner, body, other = self.owner[at], self.body[at], self.other[at]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (body[1:] != body[:-1]) | (other[1:] != other[:-1])] if len(at) else np.zeros(0, bool)
        self.at, self.pair, first = at, np.cumsum(new) - 1, np.flatnonzero(new)
        self.first = at[first]  # a context's first place in this pack
        self.least = np.minimum.reduceat(self.doc[at], first) if len(at) else np.zeros(0, np.int64)
        self.calm = np.flatnonzero(~crowded[self.which[self.first]])  # contexts whose owner is not crowded

    def ask_contexts(self) -> Iterator[tuple[int, bytes]]:
        first, least = self.first[self.calm], self.least[self.calm]
        owner, body, other = self.owner[first], self.body[first], self.other[first]
        for bucket, a, b in _bucket_slices(owner, self.bits):
            yield bucket, _pack(owner[a:b], body[a:b], other[a:b], least[a:b])

    def hear_contexts(self, answers: dict[int, bytes]) -> None:
        self.state, self.settled = np.full(len(self.first), 2, np.uint8), np.full(len(self.first), _NEVER)
        for bucket, a, b in _bucket_slices(self.owner[self.first[self.calm]], self.bits):
            self.state[self.calm[a:b]], self.settled[self.calm[a:b]] = _unpack(answers[bucket], np.uint8, np.int64)
        # Jobs: a context that is open, or each string of one whose owner is crowded.
        open_, crowd = np.flatnonzero(self.state == 1), np.flatnonzero(self.state == 2)
        many = self.end[self.first[crowd]] - self.start[self.first[crowd]] - SPAN + 1
        step = _ragged(many)
        self.job_pair = np.r_[open_, np.repeat(crowd, many)].astype(np.int64)
        first = self.first[self.job_pair]
        start = self.start[first] + np.r_[np.zeros(len(open_), np.int64), step]
        end = np.where(np.arange(len(first)) < len(open_), self.end[first], start + SPAN)
        key = self.owner[first].copy()
        for i in range(len(open_), len(first)):
            key[i] = np.frombuffer(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        order = np.argsort(key, kind="stable")
        self.job_pair, self.job_start, self.job_end, self.job_key = self.job_pair[order], start[order], end[order], key[order]

    def ask_strings(self) -> Iterator[tuple[int, bytes]]:
        first = self.first[self.job_pair]
        place = self.place[first]
        left, right = place - self.job_start, self.job_end - place - KEY
        for bucket, a, b in _bucket_slices(self.job_key, self.bits):
            parts = [self.data[x:y] for x, y in zip(self.job_start[a:b].tolist(), self.job_end[a:b].tolist(), strict=True)]
            yield bucket, _pack(left[a:b].astype(np.uint8), right[a:b].astype(np.uint8), self.least[self.job_pair[a:b]], np.concatenate(parts))

    def hear_strings(self, answers: dict[int, bytes]) -> None:
        got = [_unpack(answers[bucket], np.uint8, np.uint8, np.int64) for bucket, _, _ in _bucket_slices(self.job_key, self.bits)]
        counts, lengths, least = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint8),) * 2 + (np.zeros(0, np.int64),)
        counts, lengths = counts.astype(np.int64), lengths.astype(np.int64)
        job = np.repeat(np.arange(len(counts)), counts)
        before = np.cumsum(lengths) - lengths
        shift = before - before[np.repeat(np.cumsum(counts) - counts, counts)] if len(lengths) else before
        pair = self.job_pair[job]
        # Runs of strings with one least doc_id, relative to the context's start, by context.
        run_start = self.job_start[job] - self.start[self.first[pair]] + shift
        order = np.argsort(pair, kind="stable")
        self.run_start, self.run_end, self.run_least = run_start[order], (run_start + lengths)[order], least[order]
        self.runs = np.bincount(pair, minlength=len(self.first))

    def removed(self) -> np.ndarray:
        """A boolean for each byte of the pack."""
        change = np.zeros(len(self.data) + 1, np.int32)
        doc, start, end = self.doc[self.at], self.start[self.at], self.end[self.at]
        whole = self.settled[self.pair] < doc
        np.add.at(change, start[whole], 1)
        np.add.at(change, end[whole], -1)
        counts = self.runs[self.pair]
        run = np.repeat((np.cumsum(self.runs) - self.runs)[self.pair], counts) + _ragged(counts)
        hit = self.run_least[run] < np.repeat(doc, counts)
        base = np.repeat(start, counts)[hit]
        np.add.at(change, base + self.run_start[run[hit]], 1)
        np.add.at(change, base + self.run_end[run[hit]] - 1 + SPAN, -1)
        return np.cumsum(change[:-1]) > 0


def answer_owners(blobs: list[bytes], crowd: int = CROWD) -> list[bytes]:
    """For each pack's owners, packed bits: whether two documents have it, then whether it is crowded."""
    counts = [len(b) // 6 for b in blobs]
    raw = np.zeros((sum(counts), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    kinds = raw[:, 5].astype(np.int64)
    raw[:, 5] = 0
    value = raw.view("<u8").ravel()
    _, which, times = np.unique(value >> np.uint64(1), return_inverse=True, return_counts=True)
    shared = times > 1
    shared[which[(value & np.uint64(1)).astype(bool)]] = True
    # Packs that send one context each may all send the same one: the next round bears a few for each pack.
    total = np.bincount(which, kinds)
    crowded = (total > crowd) & (total > 4 * times)
    at = np.cumsum(counts)[:-1]
    return [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared[which], at), np.split(crowded[which], at), strict=True)]


def answer_contexts(blobs: list[bytes], crowd: int = CROWD) -> list[bytes]:
    """For each pack's contexts: settled with the owner's least doc_id (0), open (1), or open and crowded (2)."""
    got = [_unpack(b, np.uint64, np.uint64, np.uint64, np.int64) for b in blobs]
    owner, body, other, doc = (np.concatenate(x) for x in zip(*got, strict=True))
    state, settled = np.empty(len(owner), np.uint8), np.empty(len(owner), np.int64)
    # Owners are independent of one another: sorted arrays stay small, however large a bucket is.
    n = max(1, len(owner) >> 16)
    part = (owner % np.uint64(n)).astype(np.int64)
    for x in np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=n))[:-1]):
        state[x], settled[x] = _contexts_of(owner[x], body[x], other[x], doc[x], crowd)
    at = np.cumsum([len(g[0]) for g in got])[:-1]
    return [_pack(s, x) for s, x in zip(np.split(state, at), np.split(settled, at), strict=True)]


def _contexts_of(owner: np.ndarray, body: np.ndarray, other: np.ndarray, doc: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    state, settled = np.empty(len(owner), np.uint8), np.empty(len(owner), np.int64)
    if not len(owner):
        return state, settled
    order = np.lexsort((other, body, owner))
    o, c, d = owner[order], body[order], other[order]
    group = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
    new = np.r_[True, (o[1:] != o[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]
    kinds = np.add.reduceat(new.astype(np.int64), group)
    size = np.diff(np.r_[group, len(o)])
    least = np.minimum.reduceat(doc[order], group)
    state[order] = np.repeat(np.where(kinds == 1, 0, np.where(kinds > crowd, 2, 1)).astype(np.uint8), size)
    settled[order] = np.repeat(np.where(kinds == 1, least, _NEVER), size)
    return state, settled


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Places of a cyclic text in the order of their next 32 symbols."""
    n = len(text)
    word, width = text.astype(np.uint64), 1
    while width < 8:
        word, width = word << np.uint64(8 * width) | np.roll(word, -width), 2 * width
    order = np.argsort(word, kind="stable")
    for width in (8, 16):
        ordered = word[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]]).astype(np.uint64)
        word = rank * np.uint64(n) + np.roll(rank, -width)
        order = np.argsort(word, kind="stable")
    return order


def merged_blocks(texts: list[np.ndarray], depth: int = _DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Merge the texts' transforms; (place in the joined texts, number of its block) for all suffixes in merged order.

    Suffixes of one block agree in `depth` symbols.  Interleave refinement: `source` says
    from which shard each suffix of the merged order comes; sorting it stably by the
    symbols before each suffix refines the order by as many symbols.
    """
    orders = [sorted_suffixes(t) for t in texts]
    offsets = np.cumsum([0, *[len(t) for t in texts]])[:-1]
    places = np.concatenate([o + a for o, a in zip(orders, offsets.tolist(), strict=True)])
    one = np.concatenate([t[o - 1] for t, o in zip(texts, orders, strict=True)])
    two = np.concatenate([t[o - 2].astype(np.uint16) << np.uint16(8) | t[o - 1] for t, o in zip(texts, orders, strict=True)])
    source = np.repeat(np.arange(len(texts), dtype=np.uint8), [len(t) for t in texts])
    block = np.zeros(len(source), np.int32)
    known = 0
    while known < depth:
        column = two if depth - known > 1 else one
        before = np.empty(len(source), column.dtype)
        before[np.argsort(source, kind="stable")] = column
        refine = np.argsort(before, kind="stable")
        source, block, symbol = source[refine], block[refine], before[refine]
        block = np.cumsum(np.r_[False, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])]).astype(np.int32)
        known += 2 if column is two else 1
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = places
    return place, block


def answer_strings(blobs: list[bytes], part_bytes: int = PART) -> list[bytes]:
    """For each pack's jobs: the number of runs, and each run's number of strings and least doc_id.

    Strings of different owners are different, so a bucket is taken in parts of about part_bytes by its owners' hash.
    """
    got = [_unpack(b, np.uint8, np.uint8, np.int64, np.uint8) for b in blobs]
    left, right, doc = (np.concatenate([g[i] for g in got]) for i in range(3))
    raw, jobs = b"".join(g[3].tobytes() for g in got), [len(g[0]) for g in got]
    del got
    sizes = left.astype(np.int64) + right + KEY
    at = np.cumsum(sizes) - sizes
    n = -(-len(raw) // part_bytes)
    if n > 1:
        part = np.array([zlib.crc32(raw[k : k + KEY]) % n for k in (at + left).tolist()], np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.cumsum(np.bincount(part, minlength=n))[:-1]
    else:
        order, cuts = np.arange(len(doc)), np.zeros(0, np.int64)
    parts = [_strings_of(raw, left[x], right[x], doc[x], at[x]) for x in np.split(order, cuts) if len(x)]
    counts, length, low = (np.concatenate(x) for x in zip(*parts, strict=True))
    base, runs = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    base[order], runs[order] = np.cumsum(counts) - counts, counts
    out = []
    for own in np.split(np.arange(len(doc)), np.cumsum(jobs)[:-1]):
        pick = np.repeat(base[own], runs[own]) + _ragged(runs[own])
        out.append(_pack(runs[own].astype(np.uint8), length[pick], low[pick]))
    return out


def _strings_of(raw: bytes, left: np.ndarray, right: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each job, number of strings of each run, least doc_id of each run), by job."""
    rows: dict[bytes, int] = {}
    owners: dict[bytes, int] = {}
    row_of = []
    for a, b, o in zip(left.tolist(), right.tolist(), at.tolist(), strict=True):
        key = o + a
        mark = owners.setdefault(raw[key : key + KEY], len(owners))
        row_of.append(rows.setdefault(bytes((a, b)) + raw[o:key] + mark.to_bytes(_MARK, "big") + raw[key + KEY : key + KEY + b], len(rows)))
    del owners
    row_of = np.array(row_of, np.int64)
    least = np.full(len(rows), _NEVER)
    np.minimum.at(least, row_of, doc)
    keys = list(rows)
    del rows
    sizes = np.array([len(k) - 2 for k in keys], np.int64)
    left = np.array([k[0] for k in keys], np.int64)
    text = np.frombuffer(b"".join(k[2:] for k in keys), np.uint8)
    strings = sizes - _DEPTH + 1  # strings that start in each row
    cuts = np.unique([0, *[len(keys) * i // SHARDS for i in range(1, SHARDS)], len(keys)])
    ends = np.r_[0, np.cumsum(sizes)]
    place, block = merged_blocks([text[ends[a] : ends[b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    # Only places where a string starts count.
    row_at = np.repeat(np.arange(len(keys)), sizes)
    inside = np.arange(len(text)) - np.repeat(ends[:-1], sizes)
    starts = inside < strings[row_at]
    own = starts[place]
    place, block = place[own], block[own].astype(np.int64)
    # An interval is a block's strings with the owner at one place: a mark is never held against text.
    block = block * (_SIDE + 1) + (left[row_at] - inside)[place]
    order = np.argsort(block, kind="stable")
    place, block = place[order], block[order]
    edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    lows = np.minimum.reduceat(least[row_at[place]], edge)
    found = np.empty(len(text), np.int64)
    found[place] = np.repeat(lows, np.diff(np.r_[edge, len(place)]))
    found, row_at = found[starts], row_at[starts]
    new = np.r_[True, (found[1:] != found[:-1]) | (row_at[1:] != row_at[:-1])]
    run = np.flatnonzero(new)
    length, low = np.diff(np.r_[run, len(found)]).astype(np.uint8), found[run]
    runs = np.bincount(row_at[run], minlength=len(keys))
    base = np.cumsum(runs) - runs
    pick = np.repeat(base[row_of], runs[row_of]) + _ragged(runs[row_of])
    return runs[row_of], length[pick], low[pick]


_PACKS = T.StructType([T.StructField("pack", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("nulls", T.BinaryType()), T.StructField("data", T.BinaryType()), T.StructField("n_bytes", T.LongType())])
_ITEMS = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("blobs", T.ArrayType(T.BinaryType()))]
_BLOBS = T.StructType([T.StructField("pack", T.LongType()), T.StructField("round", T.IntegerType()), T.StructField("area", T.IntegerType()), *_ITEMS])
_DEALT = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("squad", "area", "bucket")], T.StructField("packs", T.ArrayType(T.LongType())), _ITEMS[1]])


def _packed(docs: DataFrame, size: int) -> DataFrame:
    """Documents in blobs of about `size` bytes: a row is enough to work on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def pack() -> pa.RecordBatch:
            rows = np.array([_FIRST if i is None else i for i in ids], np.int64).tobytes()
            nulls = np.array([i is None for i in ids], bool).tobytes()
            values = [number, rows, np.array([len(t) for t in texts], np.int64).tobytes(), nulls, zstandard.compress(b"".join(texts), 3), held]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 4, pa.int64()), strict=True)], _PACKS.names)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= size:
                    yield pack()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield pack()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PACKS)


def _gathered(keys: list[int], values: list[tuple[int, bytes]]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(key, firsts, seconds) of the values with each key."""
    found: dict[int, tuple[list[int], list[bytes]]] = {}
    for key, (number, blob) in zip(keys, values, strict=True):
        numbers, blobs = found.setdefault(key, ([], []))
        numbers.append(number)
        blobs.append(blob)
    for key, (numbers, blobs) in found.items():
        yield key, numbers, blobs


def _replayed(row: dict, answers: list[tuple[int, list[int], list[bytes]]], bits: int, rounds: int) -> _Replay:
    replay = _Replay(np.frombuffer(row["rows"], np.int64), np.frombuffer(row["sizes"], np.int64), row["data"], bits)
    heard: list[dict[int, bytes]] = [{}, {}, {}]
    for r, buckets, blobs in answers:
        heard[r].update(zip(buckets, blobs, strict=True))
    for hear, said in zip((replay.hear_owners, replay.hear_contexts, replay.hear_strings)[:rounds], heard, strict=False):
        hear(said)
    return replay


def _said(table: pa.Table) -> list[tuple[int, list[int], list[bytes]]]:
    return list(zip(*[table.column(c).to_pylist() for c in ("round", "buckets", "blobs")], strict=True))


def _asked(packs: DataFrame, answers: DataFrame | None, number: int, bits: int, shift: int) -> DataFrame:
    """The blobs of one round by area (a bucket's number without its last `shift` bits), from packs and the answers so far."""

    def blobs(replay: _Replay, pack: int) -> pa.Table:
        asked = list((replay.ask_owners, replay.ask_contexts, replay.ask_strings)[number]())
        rows = [(pack, number, *row) for row in _gathered([bucket >> shift for bucket, _ in asked], asked)]
        return _table(rows, _BLOBS)

    if answers is None:

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    (row,) = b.slice(i, 1).to_pylist()
                    yield from blobs(_replayed(row, [], bits, 0), row["pack"]).to_batches()

        return packs.mapInArrow(first, _BLOBS)

    def later(own: pa.Table, said: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        return blobs(_replayed(row, _said(said), bits, number), row["pack"])

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(later, _BLOBS)


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], kinds.names)


def _answered(asked: DataFrame, number: int, crowd: int, shift: int, squads: int) -> DataFrame:
    """Each bucket's answers to the packs that asked, as rows of what was asked."""
    answer = (partial(answer_owners, crowd=crowd), partial(answer_contexts, crowd=crowd), answer_strings)[number]
    if not shift:

        def run(table: pa.Table) -> pa.Table:
            said = answer([b[0] for b in table.column("blobs").to_pylist()])
            return pa.Table.from_arrays([*[table.column(c) for c in ("pack", "round", "area", "buckets")], pa.array([[x] for x in said], pa.list_(pa.binary()))], _BLOBS.names)

        return asked.groupBy("area").applyInArrow(run, _BLOBS)

    def deal(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [b for r in rows for b in r["buckets"]]
        values = [(r["pack"], x) for r in rows for x in r["blobs"]]
        return _table([(rows[0]["squad"], rows[0]["area"], *row) for row in _gathered(keys, values)], _DEALT)

    def answers_of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        said = iter(answer([x for r in rows for x in r["blobs"]]))
        return _table([(r["squad"], r["area"], r["bucket"], r["packs"], [next(said) for _ in r["packs"]]) for r in rows], _DEALT)

    def collect(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [p for r in rows for p in r["packs"]]
        values = [(r["bucket"], x) for r in rows for x in r["blobs"]]
        return _table([(pack, number, rows[0]["area"], buckets, blobs) for pack, buckets, blobs in _gathered(keys, values)], _BLOBS)

    dealt = asked.withColumn("squad", F.pmod(F.xxhash64("pack"), F.lit(squads)).cast("int")).groupBy("area", "squad").applyInArrow(deal, _DEALT)
    return dealt.groupBy("bucket").applyInArrow(answers_of, _DEALT).groupBy("area", "squad").applyInArrow(collect, _BLOBS)


@contextmanager
def _few_rows_a_batch(spark: SparkSession, packs: bool) -> Iterator[None]:
    """While packs are read one by one: a row is megabytes, and a batch of them stands in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    if packs:
        spark.conf.set(name, "8")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def repeated_spans(docs: DataFrame, pack_bytes: int = PACK, crowd: int = CROWD, bucket_bytes: int = BUCKET, direct: int = DIRECT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) for every row: maximal removed byte runs."""
    ship(docs.sparkSession)
    packs = stored(_packed(docs, pack_bytes), "packs")
    total, n_packs = packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    bits = max(8, int(total // bucket_bytes).bit_length())
    shift = bits // 2 if 1 << bits > direct else 0
    squads = max(1, n_packs >> shift)
    answers = None
    for number in range(3):
        with _few_rows_a_batch(docs.sparkSession, not number):
            said = stored(_answered(_asked(packs, answers, number, bits, shift), number, crowd, shift, squads), f"answers{number}")
        answers = said if answers is None else answers.union(said)
    id_type = docs.schema["doc_id"]
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]]
    names = [f.name for f in fields]

    def finish(own: pa.Table, said: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        replay = _replayed(row, _said(said), bits, 3)
        gone, out = replay.removed(), []
        nulls = np.frombuffer(row["nulls"], bool)
        for i, null, o, n in zip(replay.ids.tolist(), nulls.tolist(), replay.offsets.tolist(), replay.sizes.tolist(), strict=True):
            mask = gone[o : o + n]
            edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
            kept = hashlib.sha256(replay.data[o : o + n][~mask].tobytes()).hexdigest()
            out.append((None if null else i, n, int(mask.sum()), len(edges) // 2, kept, edges[::2].tolist(), edges[1::2].tolist()))
        kinds = [*[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int64())] * 2]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    done = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(finish, T.StructType(fields))
    return done.withColumn("doc_id", F.col("doc_id").cast(id_type.dataType))

"""BPE encoding and decoding with forced boundaries.

A byte pair that never stands inside any vocabulary token can never be merged
over, so every such pair is a certain cut.  A word is split at its certain
cuts, each fragment is merged by itself (and remembered), and the fragments'
ids are concatenated.

Null and empty texts have no tokens and decode to the empty string.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from offersieve.session import ship

#: White space as the tokenizer's pattern sees it (Unicode White_Space).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Separators that str.split() treats as white space but the tokenizer does not.
_CONTROL_SEPARATORS = "\x1c\x1d\x1e\x1f"
_CHUNKS = regex.compile(f"[^{_SPACE}]+")
_END = "</w>"
#: Entries a worker remembers while a task runs; a full memory is emptied, results do not depend on it.
MEMORY = 200_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder for one ``tokenizers`` JSON file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != _END or spec.get("decoder") is not None:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}"))
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.alphabet = byte_alphabet()
        self.inner = self._inner_pairs()
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        self.chunks: dict[str, tuple[str, int]] = {}

    def _inner_pairs(self) -> set[str]:
        """Pairs of byte characters that stand side by side inside some token."""
        pairs: set[str] = set()
        for token in self.vocab:
            body = token[: -len(_END)] if token.endswith(_END) and token != _END else token
            pairs.update(body[i : i + 2] for i in range(len(body) - 1))
        return pairs

    def cut(self, word: str) -> list[str]:
        """A word's pieces between certain cuts."""
        inner, out, start = self.inner, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inner:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merge(self, fragment: str, last: bool) -> list[int]:
        """Merge one fragment: lowest rank first, then leftmost."""
        symbols: list[str | None] = list(fragment)
        if last:
            symbols[-1] += _END
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [self.vocab[s] for s in symbols if s is not None and s in self.vocab]

    def _word(self, word: str) -> tuple[str, int]:
        """The fragments of one word, encoded by themselves and joined."""
        ids: list[int] = []
        pieces = self.cut(word if word.isascii() and word.isprintable() else "".join(map(self.alphabet.__getitem__, word.encode("utf-8"))))
        for i, piece in enumerate(pieces):
            key = (piece, i == len(pieces) - 1)
            found = self.fragments.get(key)
            if found is None:
                found = self.merge(*key)
                if len(pieces) > 1 and len(piece) <= 64:
                    if len(self.fragments) >= MEMORY:
                        self.fragments.clear()
                    self.fragments[key] = found
            ids += found
        return " ".join(map(str, ids)), len(ids)

    def _chunk(self, chunk: str) -> tuple[str, int]:
        """Ids and count of what stands between white space; words met before are not encoded again."""
        words = [chunk] if chunk.isalpha() and chunk.isascii() else self.words.findall(chunk)
        if len(words) == 1:
            out = self._word(words[0])
        else:
            parts = [p for w in words if (p := self.chunks.get(w) or self._chunk(w))[1]]
            out = " ".join([p[0] for p in parts]), sum([p[1] for p in parts])
        if len(chunk) <= 64:
            if len(self.chunks) >= MEMORY:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def _parts(self, text: str) -> list[tuple[str, int]]:
        """What each part between white space gives, in order."""
        out = []
        pieces, at = [], 0
        if "<|" in text:
            for m in self.marks.finditer(text):
                pieces += [(text[at : m.start()], None), (None, m[0])]
                at = m.end()
        pieces.append((text[at:] if at else text, None))
        get = self.chunks.get
        for piece, mark in pieces:
            if mark is not None:
                out.append((str(self.special[mark]), 1))
                continue
            if not (piece.isascii() or unicodedata.is_normalized("NFC", piece)):
                piece = unicodedata.normalize("NFC", piece)
            # The tokenizer lowers letter by letter: no final sigma.
            piece = piece.replace("Σ", "σ").lower()
            plain = not any(c in piece for c in _CONTROL_SEPARATORS)
            for chunk in piece.split() if plain else _CHUNKS.findall(piece):
                out.append(get(chunk) or self._chunk(chunk))
        return out

    def forget(self) -> None:
        """What was remembered goes: workers outlive their tasks and then hold it beside the next stage's data."""
        self.fragments.clear()
        self.chunks.clear()

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self._parts(text or "") for i in part[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def digest(self, text: str | None) -> tuple[int, str, str, str]:
        """Token count, SHA-256 of the ids and of the text that they decode to, and the ids joined by a space."""
        parts = [p for p in self._parts(text or "") if p[1]]
        ids = " ".join([p[0] for p in parts])
        decoded = self.decode(list(map(int, ids.split())))
        return sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids


@lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBpe:
    """One encoder for each file and worker."""
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs plus an array column of token ids (empty for null texts). A column named ids is replaced."""
    ship(docs.sparkSession)
    out = T.StructType([f for f in docs.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        try:
            for b in batches:
                column = pa.array([bpe.encode(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
                rest = [(f.name, b.column(f.name)) for f in b.schema if f.name != ids]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + [column], [n for n, _ in rest] + [ids])
        finally:
            bpe.forget()

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded plus the text its ids stand for (empty for null)."""
    ship(encoded.sparkSession)
    out = T.StructType([f for f in encoded.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            column = pa.array([bpe.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            rest = [(f.name, b.column(f.name)) for f in b.schema if f.name != text]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [column], [n for n, _ in rest] + [text])

    return encoded.mapInArrow(run, out)


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass and keep counts and hashes: (key, n_tokens, ids_sha256, decoded_sha256), and ids if asked for."""
    ship(docs.sparkSession)
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        try:
            for b in batches:
                found = [bpe.digest(t) for t in b.column(1).to_pylist()]
                n, ids, decoded, joined = zip(*found, strict=True) if found else ((), (), (), ())
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    columns.append(pa.array([np.fromstring(x, np.int32, sep=" ") for x in joined], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        finally:
            bpe.forget()

    fields = [docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.mapInArrow(run, T.StructType(fields))

"""Language ID with interpolated Kneser-Ney character models.

A language's model has a sorted array of 64-bit hashes of its character
sequences for each length up to four, beside their log probabilities, and one
of histories beside their back-off weights.  Texts are scored in batches: each
different sequence of a batch is looked up once in each model.  The language of the lowest
cross-entropy a character wins.  A text is rejected if that cross-entropy lies
above the upper quantile QUANTILE of what held-back training texts of the
language show at its length: pieces of these of BANDS characters are scored,
and a text is held against the longest band that it fills.

Models are fitted on a bounded sample of labelled rows: about DOCS_A_LANGUAGE
texts of each language, chosen by a hash of the text; copies count once.  The
limits are set by texts that a model has not counted: each half of the sample
against a model of the other half, and up to about HELD_MORE texts beside the
sample against the model of the whole.  A share of 0.1% shows itself only in
some thousand texts; where there are fewer, the limit goes on beyond what they
show (see `upper`).  A band of fewer than LEAST texts
takes the next shorter band's limit; a language without such a band takes the
limits of all languages together, and with fewer than FEW texts there is none.
Everything is scored on whole texts.

The score is the language's probability among those learned, held equally
likely beforehand, by all characters of the text.

Null texts and texts without a letter get `und` with score 0 and are rejected.
Rows with a null language are not learned from.  With no labelled row at all,
every text gets `und`.  Repeated rows get the same result each.  Other columns
are kept.  held_out is null where doc_id is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offersieve.llm.common import crc_bucket, fresh_names
from offersieve.llm.hashing import mix, series
from offersieve.session import ship

ORDER = 4
#: Bound of the training sample, in documents of each language.
DOCS_A_LANGUAGE = 1000
#: Bound of further labelled texts of each language that only set the limits.
HELD_MORE = 4000
#: So many texts of a language are kept; Z is the normal quantile of it. TAIL: the part of the texts whose excess tells the tail.
QUANTILE, Z, TAIL = 0.999, 3.0902, 0.1
#: Lengths of pieces in characters. A band with pieces of fewer than LEAST texts has the limit of the next shorter one;
#: languages with fewer held-back texts share the limits of all, which FEW texts set.
BANDS, LEAST, FEW = tuple(4 << i for i in range(15)), 30, 5
#: Pieces of each band from one text at most.
_PIECES = 8
_PLACES = series(ORDER, 31) | np.uint64(1)
_LETTERS: np.ndarray | None = None
_PIECE = 1 << 18


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def characters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, other runs as one space, a space around; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    end = [] if points[-1] == 32 else [32]
    return np.concatenate([np.full(ORDER - 1, 32), points, end]).astype(np.uint32)


def _hash(points: np.ndarray, first: int, last: int) -> np.ndarray:
    """Hash of the characters first..last - 1 of sequences that end where the ORDER-character rows of points end or one before."""
    out = np.zeros(len(points), np.uint64)
    for i in range(first, last):
        out += (points[:, i].astype(np.uint64) + np.uint64(1)) * _PLACES[i + ORDER - last]
    return mix(out + np.uint64(last - first))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted hashes in the sorted ones, and which of them are there."""
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return where, keys[where] == wanted


@dataclass
class LanguageModel:
    """Of each length from one: sorted sequences with log probabilities, sorted histories with log back-off weights."""

    unknown: float
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    histories: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def log_probabilities(self, hashed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of the last characters of sequences, from (sequence, history) hashes of each length."""
        out = np.full(len(hashed[0][0]), self.unknown)
        for n, (own, past) in enumerate(hashed):
            if n:
                where, known = _found(self.histories[n], past)
                out += np.where(known, self.weights[n][where], 0)
            where, known = _found(self.keys[n], own)
            out = np.where(known, self.logs[n][where], out)
        return out


@dataclass
class Model:
    """Languages, a model of each, and the limits of rejection by language and band."""

    languages: list[str]
    models: list[LanguageModel] = field(default_factory=list)
    limits: np.ndarray | None = None

    def _logs(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each language, log probabilities of the last characters of ORDER-character rows."""
        _, first, at = np.unique(_hash(rows, 0, ORDER), return_index=True, return_inverse=True)
        once = rows[first]
        hashed = [(_hash(once, ORDER - n, ORDER), _hash(once, ORDER - n, ORDER - 1)) for n in range(1, ORDER + 1)]
        for model in self.models:
            yield model.log_probabilities(hashed)[at]

    def scored(self, texts: Iterable[str | None]) -> list[tuple[np.ndarray, int]]:
        """Sum of the log probabilities by language, and the number of characters, of each text."""
        out: list[tuple[np.ndarray, int]] = []
        parts: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            ends = np.cumsum([len(p) for _, p in parts])
            for k, logs in enumerate(self._logs(np.concatenate([p for _, p in parts]))):
                for (i, _), total in zip(parts, np.add.reduceat(logs, np.r_[0, ends[:-1]]), strict=True):
                    out[i][0][k] += total
            parts.clear()

        for i, text in enumerate(texts):
            points = characters(text)
            n = max(len(points) - ORDER + 1, 0)
            out.append((np.zeros(len(self.languages)), n))
            for a in range(0, n, _PIECE):
                parts.append((i, np.lib.stride_tricks.sliding_window_view(points[a : a + _PIECE + ORDER - 1], ORDER)))
                held += len(parts[-1][1])
                if held >= _PIECE:
                    flush()
                    held = 0
        if parts:
            flush()
        return out

    def limit(self, language: int, n: int) -> float:
        """Highest cross-entropy at which a text of n characters still counts as of the language."""
        return np.inf if self.limits is None else float(self.limits[language, max(bisect_right(BANDS, n) - 1, 0)])

    def pieces(self, text: str | None, language: int) -> list[tuple[int, float]]:
        """Band and cross-entropy in the language of pieces of the text, spread evenly over it."""
        points = characters(text)
        n = len(points) - ORDER + 1
        if n <= 0:
            return []
        rows, own = np.lib.stride_tricks.sliding_window_view(points, ORDER), Model([self.languages[language]], [self.models[language]])
        logs = [next(own._logs(rows[a : a + _PIECE])) for a in range(0, n, _PIECE)]
        sums = np.concatenate([[0.0], np.cumsum(np.concatenate(logs), dtype=np.float64)])
        out = []
        for band, size in enumerate(BANDS):
            if size <= n:
                at = np.unique(np.linspace(0, n - size, min(_PIECES, n // size)).astype(np.int64))
                out += [(band, float(e)) for e in (sums[at] - sums[at + size]) / size]
        return out

    def predictions(self, texts: Iterable[str | None]) -> list[tuple[str, float, bool]]:
        """(language, probability, rejected) of each text."""
        texts, out = list(texts), []
        if not self.languages:
            return [("und", 0.0, True)] * len(texts)
        for total, n in self.scored(texts):
            if not n:
                out.append(("und", 0.0, True))
                continue
            best = int(total.argmax())
            odds = np.exp(np.maximum(total - total[best], -700))
            out.append((self.languages[best], float(1 / odds.sum()), bool(-total[best] / n > self.limit(best, n))))
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predictions([text])[0]


def upper(entropy: np.ndarray, texts: int) -> float:
    """Upper quantile of a further text's pieces: the highest of that of the pieces as they are, of a normal law, and of an exponential tail.

    The tail's mean excess is that over the pieces' upper TAIL: texts in part in another language, or of one word over
    and over, make it longer than a normal law's.
    """
    v = texts - 1
    # Student's quantile by its expansion in 1 / v.
    t = Z + (Z**3 + Z) / (4 * v) + (5 * Z**5 + 16 * Z**3 + 3 * Z) / (96 * v**2)
    high = np.quantile(entropy, 1 - TAIL)
    excess = entropy[entropy >= high] - high
    tail = high + excess.mean() * np.log(TAIL / (1 - QUANTILE))
    return float(max(np.quantile(entropy, QUANTILE), entropy.mean() + t * entropy.std(ddof=1) * np.sqrt(1 + 1 / texts), tail))


def fit_language(points: np.ndarray, count: np.ndarray, alphabet: int) -> LanguageModel:
    """From different sequences of ORDER characters (a row each) and their counts; alphabet is the number of characters of all languages."""
    levels = []
    for n in range(ORDER, 0, -1):
        keys, first, key = np.unique(_hash(points, ORDER - n, ORDER), return_index=True, return_inverse=True)
        seen = np.bincount(key, count, len(keys))
        known, of_key = np.unique(_hash(points[first], ORDER - n, ORDER - 1), return_inverse=True)
        once, twice = (seen == 1).sum(), (seen == 2).sum()
        discount = np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95)
        total, kinds = np.bincount(of_key, seen), np.bincount(of_key)
        levels.append((keys, (seen - discount) / total[of_key], known, discount * kinds / total, of_key, points[first]))
        # Continuation counts: in how many different sequences each shorter one ends.
        points, count = points[first], np.ones(len(first))
    below, model = np.full(1, 1 / (alphabet + 1)), LanguageModel(0.0)
    for n, (keys, own, known, rest, of_key, of) in enumerate(reversed(levels), 1):
        if n == 1:
            model.unknown = float(np.log(rest[0] / (alphabet + 1)))
            lower = below[0]
        else:
            lower = below[np.searchsorted(model.keys[-1], _hash(of, ORDER - n + 1, ORDER))]
        below = own + rest[of_key] * lower
        model.keys.append(keys)
        model.logs.append(np.log(below))
        model.histories.append(known)
        model.weights.append(np.log(rest))
    return model


def fit(languages: list[str], lang: np.ndarray, grams: list[str], count: np.ndarray) -> Model:
    """From each counted sequence of ORDER characters: its language's number, itself, its count. Languages without one are left out."""
    return fit_points(languages, lang, np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER), count)


def fit_points(languages: list[str], lang: np.ndarray, points: np.ndarray, count: np.ndarray) -> Model:
    """As `fit`, from a row of code points for each sequence."""
    if not len(points):
        return Model([])
    alphabet = len(np.unique(points[:, -1]))
    seen = np.unique(lang).tolist()
    return Model([languages[i] for i in seen], [fit_language(points[lang == i], count[lang == i].astype(np.float64), alphabet) for i in seen])


def _points(grams: pa.Array) -> np.ndarray:
    """A row of code points for each sequence, from their UTF-32 bytes."""
    fixed = grams.cast(pa.binary(4 * ORDER))
    return np.frombuffer(fixed.buffers()[1], np.uint32)[fixed.offset * ORDER :][: len(fixed) * ORDER].reshape(-1, ORDER)


def learn(labelled: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, held_more: int = HELD_MORE) -> Model:
    """A model from columns text and lang; the sample, half against half, and held_more texts beside it set the limits."""
    ship(labelled.sparkSession)
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([])
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_a_language / n))])
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # Copies have one draw: they count once, or a large group of them would exceed the bound.
    sample = labelled.withColumn("draw", draw / share[F.col("lang")]).where(F.col("draw") < 1 + held_more / docs_a_language).dropDuplicates(["text", "lang"])
    # The halves of the sample, and what is beside it.
    part = F.when(F.col("draw") < 0.5, 0).when(F.col("draw") < 1, 1).otherwise(2)
    sample = sample.select("text", "lang", part.alias("part"), F.xxhash64("text").alias("id"))
    index = {k: i for i, k in enumerate(languages)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for frame in frames:
            for text, lang, part in zip(frame["text"], frame["lang"], frame["part"], strict=True):
                points = characters(text)
                if len(points):
                    whole = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    found.update((index[lang], part, whole[i : i + ORDER]) for i in range(len(whole) - ORDER + 1))
        yield pd.DataFrame([(k, part, g.encode("utf-32-le", "surrogatepass"), n) for (k, part, g), n in found.items()], columns=["lang", "part", "gram", "n"])

    counts = sample.where("part < 2").select("text", "lang", "part").mapInPandas(count, "lang int, part int, gram binary, n long")
    counts = counts.groupBy("lang", "gram").agg(*[F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2)])
    got = counts.toArrow()  # bounded by the sample; no object for each row
    if not got.num_rows:
        return Model([])
    points = np.concatenate([_points(c) for c in got["gram"].chunks])
    lang, n = got["lang"].to_numpy(), [got["n0"].to_numpy(), got["n1"].to_numpy()]
    del got
    fitted = lambda n: fit_points(languages, lang[n > 0], points[n > 0], n[n > 0])
    model = fitted(n[0] + n[1])
    # Each text is held against a model that has not counted it.
    others = ship(labelled.sparkSession).sparkContext.broadcast([fitted(n[1]), fitted(n[0]), model])
    languages = model.languages
    number = {k: i for i, k in enumerate(languages)}

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, lang, part, i in zip(frame["text"], frame["lang"], frame["part"], frame["id"], strict=True):
                other = others.value[part]
                if lang in other.languages:
                    rows += [(number[lang], i, *p) for p in other.pieces(text, other.languages.index(lang))]
            yield pd.DataFrame(rows, columns=["lang", "id", "band", "entropy"])

    # Bounded by the sample and held_more: pieces of so many texts.
    held = sample.mapInPandas(check, "lang int, id long, band int, entropy double").toArrow().to_pandas()
    others.unpersist()
    model.limits = np.full((len(languages), len(BANDS)), np.inf)
    every = {b: upper(g["entropy"].to_numpy(), n) for b, g in held.groupby("band") if (n := g["id"].nunique()) >= FEW}
    own = {k: upper(g["entropy"].to_numpy(), n) for k, g in held.groupby(["lang", "band"]) if (n := g["id"].nunique()) >= LEAST}
    for i in range(len(languages)):
        few = not any(k[0] == i for k in own)
        for band in range(len(BANDS)):
            found = every.get(band) if few else own.get((i, band))
            # Longer texts scatter less: a limit never rises with the length.
            model.limits[i, band] = min(np.inf if found is None else found, model.limits[i, band - 1] if band else np.inf)
    return model


def _guess(docs: DataFrame, model: Model) -> Column:
    held = ship(docs.sparkSession).sparkContext.broadcast(model)  # bounded by the training sample
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(kind)
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(held.value.predictions(texts), columns=["lang_pred", "score", "rejected"])

    return guess("text")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred, score and rejected (columns of these names are replaced)."""
    rest = docs.drop("lang_pred", "score", "rejected")
    (name,) = fresh_names(rest, "guess")
    return rest.withColumn(name, _guess(docs, model)).select(*rest.columns, *[F.col(name)[c].alias(c) for c in ("lang_pred", "score", "rejected")])


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, with the columns of docs."""
    (name,) = fresh_names(docs, "guess")
    return docs.withColumn(name, _guess(docs, model)).where(~F.col(name)["rejected"]).drop(name)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 3 is not 1 and predict every row."""
    model = learn(docs.where(crc_bucket(3) != 1))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_bucket(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")

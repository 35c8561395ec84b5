"""Quality classifier: naive Bayes features in a linear support-vector machine.

A text is a set of n-grams: its words, and sequences of one to three word
shapes (letters, capitals, digits and marks as classes, with a mark for a word
that repeats the one before).  Each n-gram is an indicator scaled by its log
count ratio between the classes; a hinge-loss linear model is fitted on that
by dual coordinate descent, mixed with its mean weight, and mapped to a
probability by a logistic fit on rows held back from training.

The model is fitted on a bounded sample of at most about LABELLED_ROWS rows,
chosen by a hash of the row.  Whole texts are scored.

Null and empty texts have no n-gram and get the score of the intercept.  Null
labels, labels of a null doc_id, and those of a doc_id that has both labels are
not learned from.  Rows that repeat a doc_id are learned from once, by the least
text.  With one class or none among the labels, every score is that class's
share (0.5 with no label).  Every row is scored; held_out is null where doc_id
is.  Other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offersieve.llm.common import crc_bucket
from offersieve.llm.hashing import mix, series, word_hashes
from offersieve.session import ship

#: Bound of the training sample.
LABELLED_ROWS = 6000
WIDTH = 1 << 18
_REMEMBERED = 500_000
_PLACES = series(8, 41) | np.uint64(1)
_RUNS = re.compile(r"(.)\1+")
_shapes: dict[str, int] = {}
_hashes: dict[str, int] = {}


class _Classes(dict):
    """The class of each code point, found when first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = found = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return found


_CLASSES = _Classes()


def shape(word: str) -> str:
    """Classes of characters, runs of one class or mark shortened to two."""
    return _RUNS.sub(r"\1\1", word.translate(_CLASSES))


def _shape(word: str) -> int:
    found = _shapes.get(word)
    if found is None:
        form = shape(word)
        found = _hashes.get(form)
        if found is None:
            found = int.from_bytes(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            if len(_hashes) < _REMEMBERED:
                _hashes[form] = found
        if len(word) <= 40:
            if len(_shapes) >= _REMEMBERED:
                _shapes.clear()
            _shapes[word] = found
    return found


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32)
    shapes = np.fromiter(map(_shape, words), np.uint64, len(words))
    again = np.fromiter((a == b for a, b in zip(words, ["", *words], strict=False)), bool, len(words))
    shapes = np.where(again, mix(shapes), shapes)
    found = [mix(word_hashes(text) + np.uint64(99)), mix(shapes)]
    for n in (2, 3):
        size = len(shapes) - n + 1
        if size > 0:
            found.append(mix(sum(shapes[i : i + size] * _PLACES[i] for i in range(n)) + np.uint64(n)))
    return np.unique((np.concatenate(found) >> np.uint64(46)).astype(np.int32))


class Model:
    """weights (already scaled by the ratios), intercept, and the logistic map (slope, offset)."""

    def __init__(self, weights: np.ndarray | None, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def margin(self, found: np.ndarray) -> float:
        if self.weights is None:
            return 0.0
        return float(self.weights[found].sum() / np.sqrt(len(found)) + self.weights[WIDTH]) if len(found) else float(self.weights[WIDTH])

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the classes' smoothed shares of each n-gram's documents."""
    counts = np.ones((2, WIDTH))
    for found, label in zip(rows, labels, strict=True):
        counts[int(label), found] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, c: float = 1.0, rounds: int = 12, mixing: float = 0.75) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; classes weigh alike. The last weight is the intercept."""
    sign, n = np.where(labels > 0, 1.0, -1.0), len(rows)
    share = np.where(labels > 0, (labels > 0).mean(), (labels <= 0).mean())
    top = c * 0.5 / share
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    w, alpha, order = np.zeros(WIDTH + 1), np.zeros(n), np.random.default_rng(17)
    for _ in range(rounds):
        for i in order.permutation(n):
            gradient = sign[i] * (values[i] @ w[rows[i]] + w[WIDTH]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                w[WIDTH] += step
                alpha[i] = new
    used = w[:WIDTH][w[:WIDTH] != 0]
    mean = np.abs(used).mean() if len(used) else 0.0
    return np.append((mixing * w[:WIDTH] + (1 - mixing) * mean) * ratio, w[WIDTH]).astype(np.float64)


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with smoothed targets."""
    positive, negative = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, np.log((positive + 1) / (negative + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """From docs (doc_id, text) and labels (doc_id, quality); at most about `rows` labelled rows are read."""
    ship(docs.sparkSession)
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    sizes = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        share = float(next(iter(sizes), 0.5))
        return Model(None, 0.0, 40.0 if share == 1 else -40.0 if share == 0 else 0.0)
    # Each class gets up to half of the bound.
    share = F.when(F.col("quality") == 1, min(1.0, rows / 2 / sizes[1])).otherwise(min(1.0, rows / 2 / sizes[0]))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.withColumn("draw", draw / share).where("draw < 1")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"quality": frame["quality"], "draw": frame["draw"], "found": [features(t) for t in frame["text"]]})

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `rows`
    sample = sample.groupBy("doc_id", "quality", "draw").agg(F.min("text").alias("text"))
    got = sample.select("text", "quality", "draw").mapInPandas(read, "quality int, draw double, found array<int>").toPandas()
    got = got.sort_values("draw", ignore_index=True)
    found, y, draw = [np.asarray(f, np.int64) for f in got["found"]], got["quality"].to_numpy(), got["draw"].to_numpy()
    fitted, back = np.flatnonzero(draw < 0.8), np.flatnonzero(draw >= 0.8)
    if len(np.unique(y[fitted])) < 2:
        return Model(None, 0.0, float(np.log((sizes[1] + 1) / (sizes[0] + 1))))
    rows_fit = [found[i] for i in fitted]
    model = Model(descend(rows_fit, y[fitted], ratios(rows_fit, y[fitted])), 1.0, 0.0)
    if len(np.unique(y[back])) == 2:
        model.slope, model.offset = logistic(np.array([model.margin(found[i]) for i in back]), y[back])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus score (a column of that name is replaced)."""
    held = ship(docs.sparkSession).sparkContext.broadcast(model)
    score = F.pandas_udf(lambda s: s.map(held.value.score, na_action=None).astype("float64"), T.DoubleType())
    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id) mod 4 is not 2 and score every row."""
    model = learn(docs, labels.where(crc_bucket(4) != 2))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_bucket(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A text is the set of its five-word shingles.  Sketching throws every shingle
into a bin, round after round with fresh hashes, until all bins are filled; in
the last rounds each bin in turn gets all shingles, so it always ends.  Bands
of sketch coordinates propose candidates; every link is confirmed on the full
sets, and linked texts form components.

Equal sets are one node from the start.  Within a band's bucket, candidates are
tested against pivots only: first one, then ever more, until all of the
bucket's nodes are in one component or every pair of different components has
been tested.  So a large group of copies costs a pair for each copy, and no link
between proposed candidates is given up.

Shingles and sets are compared by 64-bit hashes of words and their order.

Null and empty texts, and texts without words, have an empty set and are linked
with nothing.  Repeated rows keep their row each.  A null doc_id takes part with
its text; the component is named by the least doc_id that is not null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offersieve.llm.common import fresh_names, stored
from offersieve.llm.hashing import mix, series, shingle_set
from offersieve.session import ship

#: Probability, at most, that two sets of just the wanted similarity share no band.
MISSED = 5e-6
#: Coordinates of a sketch at most: a value carries the number of its round, which is below twice that, in ten bits.
MOST = 511
_SEEDS = series(2 * MOST, 53)
_FACTORS = series(16, 59) | np.uint64(1)
_NAMES = series(MOST, 61)
#: Longs of a parity sketch.
PARITY = 16
#: Ids that are broadcast at most (a key of 16 bytes each, about 20 MB as a relation); beyond, a shuffled join is used.
_BROADCAST_IDS = 200_000


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for a similarity: (32, 7) at 85, (31, 5) at 80."""
    p = min(percent, 95) / 100
    rows = max(1, min(16, round(math.log(0.3) / math.log(p)))) if p > 0 else 1
    while (bands := math.ceil(math.log(MISSED) / math.log(1 - p**rows))) * rows > MOST:
        rows -= 1
    return bands, rows


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """size coordinates of a set that is not empty; two sets agree in a coordinate with their similarity's probability."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    n, at = len(shingles), 0
    step = max(1, 2048 // n)
    while at < 2 * size:
        rounds = np.arange(at, min(at + step, 2 * size))
        h = mix(shingles[None, :] ^ _SEEDS[rounds, None])
        place = np.where(rounds[:, None] < size, (h % np.uint64(size)).astype(np.int64), rounds[:, None] - size)
        value = (rounds.astype(np.uint64) << np.uint64(54))[:, None] | (h >> np.uint64(10))
        np.minimum.at(out, place.ravel(), value.ravel())
        at += step
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def bands(shingles: np.ndarray, percent: int = 85) -> np.ndarray:
    """One 64-bit key for each band."""
    n, rows = banding(percent)
    return mix((sketch(shingles, n * rows).reshape(n, rows) * _FACTORS[:rows]).sum(1, dtype=np.uint64) ^ _NAMES[:n])


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITY classes of shingles: whether the set holds an odd number of them.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    counts = np.bincount((mix(shingles ^ _NAMES[0]) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def _sketched(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bands, parity): text_key is the text's SHA-256, node names the set and is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, keys, odd, names = [], [], [], [], []
            for text in b.column(1).to_pylist():
                found = shingle_set(text, shingle)
                sizes.append(len(found))
                names.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest())
                nodes.append(_name(found))
                keys.append(bands(found, percent).view(np.int64) if len(found) else None)
                odd.append(parity(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "node", "bands", "parity"],
            )

    fields = [docs.schema["doc_id"], T.StructField("text_key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("bands", "parity")]]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def _name(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _node_texts(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, text) for nodes (node, id): id is a doc_id whose text has that set."""
    wanted = nodes.select("node", "id")
    side = F.broadcast(wanted) if wanted.count() <= _BROADCAST_IDS else wanted
    found = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # rows that repeat a doc_id can have other texts
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            take = pa.array([i for i, (node, text) in enumerate(pairs) if _name(shingle_set(text, shingle)) == node], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], ["node", "text"])

    return found.mapInArrow(run, "node binary, text string")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, good = batch.column(0), batch.column(1), []
            for i, (key, left, right) in enumerate(zip(a.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if key != name:  # rows come sorted by a
                    name, kept = key, shingle_set(left, shingle)
                if linked(kept, shingle_set(right, shingle), percent):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node of its component.

    Each round takes the least label around a node and then that label's own label.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = stored(moved.join(jump, "new").select("node", F.least("new", "far").alias("new"), "label"), "labels")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _possible(percent: int):
    """Whether sets can be similar enough: their sizes, and a lower bound of the shingles in which they differ."""
    total = F.col("n_shingles") + F.col("n_shingles_a")
    apart = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity_a")[i])) for i in range(1, PARITY)), F.bit_count(F.col("parity")[0].bitwiseXOR(F.col("parity_a")[0])))
    return (100 * F.least("n_shingles", "n_shingles_a") >= percent * F.greatest("n_shingles", "n_shingles_a")) & ((100 + percent) * apart <= (100 - percent) * total)


def _merged(labels: DataFrame | None, members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels (node, label) and members' labels after new links between components."""
    if labels is None:
        labels = connected(links)
        return labels, _relabelled(members, labels)
    names = labels.select(F.col("node"), F.col("label"))
    between = links.join(names.toDF("a", "label_a"), "a", "left").join(names.toDF("b", "label_b"), "b", "left")
    joined = connected(between.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
    known = labels.join(joined.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = joined.join(labels, "node", "left_anti")
    return stored(known.union(fresh.select("node", "label")), "merged"), _relabelled(members, joined)


def _relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    out = members.join(labels.toDF("label", "to"), "label", "left")
    return out.select(*[c for c in members.columns if c != "label"], F.coalesce("to", "label").alias("label"))


def components(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """(doc_id, text_key, n_shingles, label, component_id) for every row of docs; label names the component, null for empty sets."""
    ship(docs.sparkSession)
    rows = stored(_sketched(docs, shingle, percent), "sketched")
    # Equal sets have equal bands, parities and sizes; the least doc_id leads to their text.
    sets = rows.where("node is not null").groupBy("node")
    nodes = stored(sets.agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "parity")]), "nodes")
    keyed = stored(nodes.select("node", F.explode("bands").alias("band")), "keyed")
    shared = stored(keyed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    # Sides that grow with the corpus are never broadcast, at no size.
    members = stored(keyed.join(shared.hint("merge"), "band"), "members")
    degree = stored(members.groupBy("node").agg(F.sum("size").alias("degree")), "degree")
    candidates = stored(degree.join(nodes.drop("bands").hint("merge"), "node"), "candidates")
    members = stored(members.join(candidates.hint("merge"), "node").select("band", "node", "size", "degree", "n_shingles", "parity", F.col("node").alias("label")), "ranked")
    texts = stored(_node_texts(docs, candidates, shingle), "texts")
    labels = None
    pivots, tested = 1, 0
    while True:
        # Buckets of more than one component whose pairs are not all tested.
        mixed = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("size").alias("size"))
        mixed = stored(mixed.where((F.col("low") != F.col("high")) & (F.col("size") > tested + 1)).select("band"), "mixed")
        members = stored(members.join(mixed, "band"), "live")
        if not members.limit(1).count():
            break
        rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("degree"), "node"))
        chosen = members.withColumn("rank", rank).where((F.col("rank") <= pivots) & (F.col("rank") > tested))
        chosen = stored(chosen.select("band", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n_shingles", "parity")]), "pivots")
        pairs = members.join(chosen, (members["band"] == chosen["band"]) & (F.col("label") != F.col("label_a")) & _possible(percent))
        pairs = stored(pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        links = stored(_confirmed(pairs, texts, percent, shingle), "links")
        if links.limit(1).count():
            labels, members = _merged(labels, members, links)
        pivots, tested = 16 * pivots, pivots
    label = F.col("node")
    if labels is not None:
        nodes, label = nodes.join(labels, "node", "left"), F.coalesce("label", "node")
    labelled = stored(nodes.select("node", "id", label.alias("label")), "labelled")
    least = stored(labelled.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    named = stored(labelled.join(least.hint("merge"), "label").select("node", "label", "component_id"), "named")
    out = rows.select("doc_id", "text_key", "n_shingles", "node").join(named.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", "label", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    found = components(docs, percent, shingle)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """docs with the first document of each component: the least doc_id, then the least hash of the text.

    Rows without words stay, and rows alike in doc_id and text stay together.
    """
    found = stored(components(docs, percent, shingle).select("doc_id", "text_key", "label"), "components")
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    own, id_, key = fresh_names(docs, "own", "id", "key")
    kept = stored(first.union(found.where("label is null").select("doc_id", "text_key")), "kept").toDF(id_, key)
    keyed = docs.withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return keyed.join(kept.hint("merge"), (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi").drop(own)

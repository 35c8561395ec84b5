"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

The trie of all words is never built in one place.  Its nodes are the words' prefixes; a node's heavy letter is the one
below which most words stand (ties: the least).  A word leaves heavy paths at log2(words) nodes at most, its light edges,
whatever its length, and an end of a word counts as a light edge.  At each light edge the rest of the word is merged into
the node's heavy subtree with one character replaced by the heavy letter, skipped, or the heavy letter put before it
(which is the skip seen from the heavy side), and into the other light subtrees with the character replaced by a mark.
Terminals that coincide are words one edit apart; the edit stands at the first place where the two differ, so each pair
is found at one node and once.  Merging small into large keeps all this at words * log2(words) rows.

Nodes are told apart by 64-bit hashes.  A clash could only give two nodes the same heavy letter, which costs rows and
changes no result, since terminals are compared as text.  Words that differ in one marked place are one group of at most
as many words as there are letters; their counts and best words are taken from the group, no pairs are made.

Words are runs of `LETTERS`, A-Z lower-cased.  `misspelt` takes a letter from every 97th (document, run), as the contract
of the query wants it; `words` leaves them as they are.  A null doc_id counts as an empty text there.

Null and empty texts hold no words.  Rows that repeat count each.  Words and texts may be of any length.  An empty table,
or no word that is frequent enough, gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import stored
from offersieve.llm.hashing import mix
from offersieve.llm.rolling import spans, sums

LETTERS, LEAST_LENGTH, LEAST_COUNT, EVERY, HELD = "[A-Za-zÀ-ÿ]+", 5, 3, 97, 200_000


def misspelt(doc_id: object, run: str) -> str:
    """The run, or what is left of it without one letter where 97 divides the crc32 of `<doc_id>:<run>`."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(docs: DataFrame, edited: bool, least_length: int) -> DataFrame:
    """(word, n): each task's counts, given out whenever it holds HELD words."""
    pattern = re.compile(LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist(), strict=True):
                if not text:
                    continue
                # The lower() of bytes touches A-Z alone.
                found = Counter(pattern.findall(text.lower().decode()))
                if edited:
                    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word in [w for w in found if not zlib.crc32(w.encode(), begun) % EVERY]:
                        n, new = found.pop(word), misspelt(doc_id, word)
                        if len(new) >= least_length:
                            held[new] += n
                for word, n in found.items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def words(docs: DataFrame, edited: bool = False, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): all words of so many letters that occur so often, in lower case."""
    return _counts(docs, edited, least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _steps(vocabulary: DataFrame) -> DataFrame:
    """(word, n, depth, node, letter): every prefix's hash and the letter after it; none at a word's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["word"].to_pylist()
            at = 0
            while at < len(texts):  # about a million letters at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                    size += len(texts[to]) + 1
                    to += 1
                part = texts[at:to]
                points = np.frombuffer("".join(w + "\0" for w in part).encode("utf-32-le"), np.uint32).astype(np.uint64)
                lengths = np.array([len(w) + 1 for w in part])
                starts = np.cumsum(lengths) - lengths
                depth = np.arange(len(points)) - np.repeat(starts, lengths)
                begin = np.repeat(starts, lengths)
                node = mix(spans(sums(mix(points)), begin, begin + depth) + depth.astype(np.uint64))
                rows = pa.array(np.repeat(np.arange(at, to), lengths))
                letter = pa.array(points.astype(np.int32), mask=points == 0)
                yield pa.RecordBatch.from_arrays([batch["word"].take(rows), batch["n"].take(rows), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), letter], ["word", "n", "depth", "node", "letter"])
                at = to

    return vocabulary.mapInArrow(run, "word string, n long, depth int, node long, letter int")


def _light(vocabulary: DataFrame) -> DataFrame:
    """(word, n, depth, heavy): where words leave heavy paths or end, with the node's heavy letter."""
    steps = _steps(vocabulary)
    children = steps.groupBy("node", "letter").agg(F.count("*").alias("below"))
    # A node with one child has no light edge.
    heavy = children.groupBy("node").agg(F.min(F.when(F.col("letter").isNotNull(), F.struct((-F.col("below")).alias("below"), "letter")))["letter"].alias("heavy"), F.count("*").alias("children"))
    heavy = stored(heavy.where("children > 1 and heavy is not null").select("node", "heavy"), "heavy")
    found = steps.join(heavy, "node").where("letter is null or letter <> heavy")
    return found.select("word", "n", "depth", F.char("heavy").alias("heavy"))


def _stats(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and the first of them by count and then by letters."""
    light = stored(_light(vocabulary), "light")
    word, depth = F.col("word"), F.col("depth")
    prefix, letter, rest = F.substring(word, F.lit(1), depth), F.substring(word, depth + 1, F.lit(1)), F.substring(word, depth + 2, F.length(word))
    ended = letter == ""
    # A skipped letter that the next one equals would be found at a later node, too.
    skipped = F.when(~ended & (letter != F.substring(rest, 1, 1)), F.concat(prefix, rest))
    made = F.array(F.when(~ended, F.concat(prefix, "heavy", rest)), skipped, F.concat(prefix, "heavy", letter, rest))
    asked = light.select("word", "n", F.explode(F.array_compact(made)).alias("target"))
    pairs = stored(asked.join(vocabulary.select(F.col("word").alias("target"), F.col("n").alias("m")), "target"), "pairs")

    def seen(of: str, other: str, n: str) -> DataFrame:
        return pairs.groupBy(F.col(of).alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col(n)).alias("rank"), F.col(other).alias("word"))).alias("best"))

    member = F.struct((-F.col("n")).alias("rank"), "word")
    groups = light.where(~ended).groupBy("depth", F.concat(prefix, rest).alias("left")).agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    first, second = F.col("members")[0], F.col("members")[1]
    among = groups.select(F.explode("members").alias("m"), first.alias("first"), second.alias("second"), (F.size("members") - 1).cast("long").alias("n_near"))
    among = among.select("m.word", "n_near", F.when(F.col("m.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    every = seen("word", "target", "m").unionByName(seen("target", "word", "n")).unionByName(among)
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Counts double at each form, so few rounds do, and each round doubles the way."""
    links = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stored(joined, "links")
        links = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return links


def variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n); a form occurs at least ratio times as often."""
    known = stored(vocabulary, "words")
    is_form: Column = -F.col("best.rank") >= ratio * F.col("n")
    formed = known.join(_stats(known), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.rank")).alias("form_n")
    )
    formed = stored(formed, "formed")
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

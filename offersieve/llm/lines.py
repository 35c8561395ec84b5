"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines with a word are numbered in each document (lines without one are kept
and not compared).  A window is the shortest run of lines from a line on that
has WINDOW_WORDS words or WINDOW_LINES lines (at a document's end it may have
less).  The least line hash of each window is a fingerprint, so two documents
that share a run of such a size share a fingerprint, whatever stands around it.

A fingerprint that was selected at two places is joined to every place of its
line; where the line stood before, that is a match.  A match is extended both
ways, line by line, as long as the two neighbouring lines stood before as
neighbours.  The run that comes of it is deleted if it has MIN_WORDS words, so
runs go to both their ends, short last lines included, and a run's first place
always stays.  Repeated runs under the size of a window go where a line of
theirs was selected twice, as lines of many copies always are.

`First` is the order of doc_id, then of lines; rows that repeat a doc_id follow
in the order of their text's hash.  Lines and pairs of neighbours are told
apart by 128-bit hashes.

Null texts stay null, empty ones stay empty.  A null doc_id is before all
others.  Rows alike in doc_id and text are one document: each gets the same
result.  Surviving lines are joined by a line feed.  Columns of any name may
stand beside doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offersieve.llm.common import fresh_names, stored

MIN_WORDS, WINDOW_WORDS, WINDOW_LINES = 5, 50, 8
_DOC = ("doc_id", "text_key")


def _hash(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, "[ \\t\\x0B\\f\\r]+"), lambda w: w != ""))


def _lines(docs: DataFrame, window_words: int, window_lines: int) -> DataFrame:
    """A row for each line with a word: document, number, words, hash, hash with the next line, that one's place and words, and its window's least hash and that one's number."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("at"), _hash(line).alias("hash"), _words(line).alias("words"))), lambda x: x["words"] > 0)
    # Numbers are those among the lines with a word.
    numbered = docs.where("text is not null and text <> ''").select(*_DOC, lines.alias("lines"))
    none = F.struct(F.lit(0).alias("words"), F.lit(None).cast("struct<hash:binary,number:int>").alias("least"))

    def line(x: Column, i: Column) -> Column:
        def add(acc: Column, y: Column) -> Column:
            return F.when(acc["words"] >= window_words, acc).otherwise(
                F.struct((acc["words"] + y["words"]).alias("words"), F.least(acc["least"], F.struct(y["hash"].alias("hash"), y["number"].alias("number"))).alias("least"))
            )

        ahead = F.transform(F.slice("lines", i + 1, F.lit(window_lines)), lambda y, j: F.struct(y["words"].alias("words"), y["hash"].alias("hash"), (i + j).alias("number")))
        following = F.get(F.col("lines"), i + 1)
        return F.struct(
            i.alias("number"), x["at"].alias("at"), x["words"].alias("words"), x["hash"].alias("hash"),
            F.when(following.isNotNull(), _hash(F.concat(x["hash"], following["hash"]))).alias("pair"), following["at"].alias("next_at"), following["words"].alias("next_words"),
            F.aggregate(ahead, none, add)["least"].alias("least"),
        )

    return numbered.select(*_DOC, F.explode(F.transform("lines", line)).alias("w")).select(*_DOC, "w.number", "w.at", "w.words", "w.hash", "w.pair", "w.next_at", "w.next_words", "w.least")


def _places(lines: DataFrame, key: str, number: str = "number") -> DataFrame:
    """(key, first): keys that stand at two places, with the first of them."""
    place = F.struct(*_DOC, F.col(number).alias("number"))
    both = lines.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return both.where("first <> last").select("key", "first")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, window_words: int = WINDOW_WORDS, window_lines: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, text_key, lines): the numbers of the lines to delete, from 0, for documents that have any."""
    lines = stored(_lines(docs, window_words, window_lines), "lines")
    selected = lines.select(*_DOC, F.col("least.number").alias("number"), F.col("least.hash").alias("hash"))
    fingerprints = stored(_places(selected, "hash").select("key"), "fingerprints")
    matched = stored(_places(lines, "hash").join(fingerprints, "key", "left_semi"), "matched")
    neighbours = stored(_places(lines, "pair"), "neighbours")
    later = F.struct(*_DOC, "number") > F.col("first")

    def flagged(number: Column, at: str, words: str, match: bool, joined: bool) -> Column:
        return F.struct(number.alias("number"), F.col(at).alias("at"), F.col(words).alias("words"), F.lit(match).alias("match"), F.lit(joined).alias("joined"))

    number = F.col("number")
    matches = lines.join(matched, F.col("hash") == F.col("key")).where(later).select(*_DOC, flagged(number, "at", "words", True, False).alias("n"))
    ends = F.array(flagged(number, "at", "words", False, True), flagged(number + 1, "next_at", "next_words", False, False))
    chained = lines.join(neighbours, F.col("pair") == F.col("key")).where(later).select(*_DOC, F.explode(ends).alias("n"))
    flags = matches.union(chained).select(*_DOC, "n.*").repartition(*_DOC)
    own = flags.groupBy(*_DOC, "number", "at", "words").agg(F.max("match").alias("match"), F.max("joined").alias("joined"))
    # A run ends where a line and its follower did not stand before as neighbours.
    order = Window.partitionBy(*_DOC).orderBy("number")
    begins = ~F.coalesce(F.lag("joined").over(order) & (F.lag("number").over(order) == F.col("number") - 1), F.lit(False))
    runs = own.select(*_DOC, "number", "at", "words", "match", begins.cast("int").alias("begins"))
    runs = runs.withColumn("run", F.sum("begins").over(order)).groupBy(*_DOC, "run").agg(F.max("match").alias("match"), F.sum("words").alias("words"), F.collect_list("at").alias("lines"))
    return runs.where(F.col("match") & (F.col("words") >= min_words)).groupBy(*_DOC).agg(F.flatten(F.collect_list("lines")).alias("lines"))


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed"), min_words: int = MIN_WORDS, window_words: int = WINDOW_WORDS, window_lines: int = WINDOW_LINES) -> DataFrame:
    """docs with deduplicated texts, plus two counts, of lines and of lines removed (columns of their names are replaced)."""
    rest = [c for c in docs.columns if c.lower() not in counts]
    key, id_, key_, lines_ = fresh_names(docs, "key", "other_id", "other_key", "lines")
    keyed = docs.select(*rest, _hash(F.col("text")).alias(key))
    found = repeated_lines(keyed.select("doc_id", F.col(key).alias("text_key"), "text"), min_words, window_words, window_lines)
    removed = stored(found, "removed").toDF(id_, key_, lines_)
    both = keyed.join(removed, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_)), "left")
    parts = F.split("text", "\n")
    # Texts of very many lines: array_except hashes, and the outer lambda splits a text once.
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lines_)
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n"))[0]
    text = F.when(F.col(lines_).isNull(), F.col("text")).otherwise(kept)
    return both.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in rest],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias(counts[0]),
        F.coalesce(F.array_size(lines_), F.lit(0)).cast("long").alias(counts[1]),
    )


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_kept_chars, kept_sha256) for every row."""
    out = dedup_lines(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_kept_chars"), F.sha2(text, 256).alias("kept_sha256"))

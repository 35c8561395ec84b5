"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

Every stage takes the rows that its predecessor kept.  All but the last return
the columns of documents; the last returns each document's tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.llm import bpe, decontaminate, language, lines, minhash
from offersieve.llm.common import crc_bucket, fresh_names, stored
from offersieve.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject; they learn from rows whose crc32(doc_id) mod 3 is not 1.

    Null texts and texts without a letter are rejected, as are all if no row has a language.  Rows with a null doc_id
    are not learned from, but kept or rejected like others.  Repeated rows fare alike.  An empty table gives an empty
    one.  All columns are kept as they are, whatever their names.
    """
    return language.accepted(docs, language.learn(docs.where(crc_bucket(3) != 1)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars, if it is there, follows. Documents of which no word is left go.

    Null and empty texts stay as they are.  A line's first place is that of the least doc_id, null before all;
    rows alike in doc_id and text keep their row each.  An empty table gives an empty one.
    """
    counts = fresh_names(docs, "n_lines", "n_removed")
    out, same = lines.dedup_lines(docs, tuple(counts)), F.col(counts[1]) == 0
    left = out.where(same | F.col("text").rlike(r"[^\s]"))
    if "n_chars" in docs.columns:
        chars = F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", chars)
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the least doc_id, null before all.

    Null and empty texts, and texts without words, stay.  Rows alike in doc_id and text stay or go together.  An
    empty table gives an empty one.
    """
    return minhash.deduplicated(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    An item of fewer than eight words takes documents away only if less than one of a thousand holds it.
    Null and empty texts, and null items, hold nothing, so such documents stay.  All rows of a doc_id into one of
    whose texts an item leaks go.  An empty table, on either side, takes nothing away.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for every document; null texts count as empty, without tokens."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Trained language models, sketches and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Duplicates: exact rows first, then suspected ones among the rest; never removed without confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions.text import is_null_token, plain_text
from offersieve.schema import KEEP_ALL, KEEP_FIRST


def suspected_key() -> Column:
    """The offer id if there is one, else requirement, name and start date; both of the first must be there."""
    offer = plain_text(F.col("offer_id"))
    parts = F.concat_ws("|", F.col("requirement_id"), F.col("candidate_name"), F.coalesce(F.col("start_date").cast("string"), F.lit("")))
    return F.when(F.coalesce(F.col("offer_id"), F.lit("")) != "", F.concat(F.lit("offer|"), F.lower(offer))).when(
        F.col("requirement_id").isNotNull() & F.col("candidate_name").isNotNull(), F.lower(parts)
    )


def exact_key(texts: Column) -> Column:
    """Plain texts of a row's cells (plain_cells) joined; null for a row that is blank throughout."""
    return F.when(F.exists(texts, lambda t: ~is_null_token(F.coalesce(t, F.lit("")))), F.array_join(texts, "\u001f", ""))


def _named(groups: DataFrame, key: str, kind: str, prefix: str) -> DataFrame:
    """Keys with two rows or more, with n, first and group; a group has the name of its first record."""
    first = F.col("first")
    found = (F.concat(F.lit(f"{kind}#"), first["record_id"]), F.col("n"), F.struct(first["source_row"].alias("source_row"), first["record_id"].alias("record_id")))
    return groups.where("n > 1").select(key, *[c.alias(f"{prefix}_{name}") for c, name in zip(found, ("group", "n", "first"), strict=True)])


def mark(rows: DataFrame) -> DataFrame:
    """rows (record_id, source_row, exact_key, suspected_key) plus dup_kind, dup_group, dup_n and is_first."""
    n, row = F.count("*").alias("n"), F.struct("source_row", "record_id", "suspected_key")
    texts = rows.where(F.col("exact_key").isNotNull()).groupBy("exact_key").agg(n, F.min(row).alias("first"))
    # Rows in no exact group: a group of one is its row, so they need no join.
    rest = texts.where("n = 1").select("first.*").unionByName(rows.where(F.col("exact_key").isNull()).select(row.alias("first")).select("first.*"))
    likes = rest.where(F.col("suspected_key").isNotNull()).groupBy("suspected_key").agg(n, F.min(F.struct("source_row", "record_id")).alias("first"))
    one = rows.join(_named(texts, "exact_key", "exact", "exact"), "exact_key", "left")
    two = one.join(_named(likes, "suspected_key", "suspected", "s"), "suspected_key", "left")
    exactly = F.col("exact_group").isNotNull()
    near = ~exactly & F.col("s_group").isNotNull()
    first = F.when(exactly, F.col("exact_first")).when(near, F.col("s_first"))
    return two.select(
        *rows.columns,
        F.when(exactly, F.lit("exact")).when(near, F.lit("suspected")).otherwise(F.lit("none")).alias("dup_kind"),
        F.when(exactly, F.col("exact_group")).when(near, F.col("s_group")).alias("dup_group"),
        F.when(exactly, F.col("exact_n")).when(near, F.col("s_n")).alias("dup_n"),
        (first == F.struct("source_row", "record_id")).alias("is_first"),
    )


def decide(marked: DataFrame, strategy: str = KEEP_FIRST, confirmed: bool = False) -> DataFrame:
    """marked plus dedup_action and dedup_by."""
    if strategy not in (KEEP_ALL, KEEP_FIRST):
        raise ValueError(strategy)
    alone = F.col("dup_kind") == "none"
    if not confirmed:
        action, by = F.lit("pendingUserConfirmation"), "default"
    elif strategy == KEEP_ALL:
        action, by = F.lit("kept"), "user"
    else:
        action, by = F.when(F.col("is_first"), F.lit("kept")).otherwise(F.lit("removedAsDuplicate")), "user"
    return marked.withColumns({"dedup_action": F.when(alone, F.lit("kept")).otherwise(action), "dedup_by": F.when(alone, F.lit("none")).otherwise(F.lit(by))})


def group_summary(marked: DataFrame) -> DataFrame:
    """(dup_kind, n_groups, n_rows)."""
    found = marked.where("dup_kind <> 'none'")
    return found.groupBy("dup_kind").agg(F.count_distinct("dup_group").alias("n_groups"), F.count("*").alias("n_rows"))

"""Salary benchmarks of comparable positions and where a record stands in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offersieve.functions.numbers import MIN_SAMPLE, valid_amount
from offersieve.functions.text import key_text, says_something

KEYS = ("city", "job_family", "position", "currency", "salary_unit")
SEPARATOR = "\u001f"


def group_key() -> Column:
    """city, family, position, currency and unit in one; null if any of them says nothing."""
    # The array gives the cleaned parts a name, so that each is cleaned once.
    parts = F.array(F.array(*[key_text(F.col(c)) for c in KEYS]))
    return F.get(F.transform(parts, lambda p: F.when(F.forall(p, says_something), F.array_join(p, SEPARATOR))), F.lit(0))


def samples(reference: DataFrame) -> DataFrame:
    """(group_key, amount) of the records that count."""
    return reference.select(group_key().alias("group_key"), valid_amount(F.col("salary_amount")).alias("amount")).where("group_key is not null and amount is not null")


def build(reference: DataFrame, min_sample: int = MIN_SAMPLE, comparable: bool = True) -> DataFrame:
    """(group_key, n, p25, p50, p75, sufficient); quartiles only from min_sample values on; empty if not comparable."""
    sufficient = F.count("amount") >= min_sample
    q = F.when(sufficient, F.percentile("amount", [0.25, 0.5, 0.75]))
    rows = samples(reference).where(F.lit(comparable))
    return rows.groupBy("group_key").agg(F.count("amount").alias("n"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), sufficient.alias("sufficient"))


def ranks(reference: DataFrame) -> DataFrame:
    """(group_key, amount, rank): mid-rank percentile (below + half of equal) / n of every value seen.

    Values are counted before they are ranked, so a large group costs one row for each different amount.
    """
    counted = samples(reference).groupBy("group_key", "amount").agg(F.count("*").alias("equal"))
    group = Window.partitionBy("group_key")
    below = F.coalesce(F.sum("equal").over(group.orderBy("amount").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("group_key", "amount", ((below + F.lit(0.5) * F.col("equal")) / F.sum("equal").over(group)).alias("rank"))


def _placed(records: DataFrame, reference: DataFrame) -> DataFrame:
    """(group_key, amount, rank, n, p50) of every value, missing ones too, that either table has; n, rank and p50 count the reference alone.

    Values are counted once, in one shuffle; records that are their own reference are read once for it.
    """
    pair = lambda d, n: d.select(group_key().alias("group_key"), valid_amount(F.col("salary_amount")).alias("amount"), n.cast("long").alias("equal")).where("group_key is not null")
    rows = pair(reference, valid_amount(F.col("salary_amount")).isNotNull())
    if records is not reference:
        rows = rows.unionByName(pair(records, F.lit(0)))
    counted = rows.groupBy("group_key", "amount").agg(F.sum("equal").alias("equal"))
    group = Window.partitionBy("group_key")
    below = F.coalesce(F.sum("equal").over(group.orderBy("amount").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("equal").over(group)
    rank = F.when((total > 0) & F.col("amount").isNotNull(), (below + F.lit(0.5) * F.col("equal")) / total)
    return counted.select("group_key", "amount", rank.alias("rank"), total.alias("n"), F.percentile("amount", 0.5, F.col("equal")).over(group).alias("p50"))


def _beside(records: DataFrame, placed: DataFrame) -> DataFrame:
    keyed = records.withColumns({"_key": group_key(), "_amount": valid_amount(F.col("salary_amount"))})
    same = (F.col("_key") == F.col("_group")) & F.col("_amount").eqNullSafe(F.col("_value"))
    return keyed.join(placed.withColumnsRenamed({"group_key": "_group", "amount": "_value"}), same, "left").drop("_key", "_amount", "_group", "_value")


def ranks_of(records: DataFrame, reference: DataFrame) -> DataFrame:
    """records plus percentile_rank against another set: values that the reference does not hold are placed between its own."""
    placed = _placed(records, reference)
    return _beside(records, placed.select("group_key", "amount", F.col("rank").alias("percentile_rank")))


def decorate(records: DataFrame, reference: DataFrame, min_sample: int = MIN_SAMPLE, comparable: bool = True) -> DataFrame:
    """records plus benchmark_n, benchmark_p50, percentile_rank and below_median.

    The rank looks at neither sample size nor comparability; below_median at both.
    """
    shown = F.lit(comparable) & (F.col("n") > 0)
    placed = _placed(records, reference).select(
        "group_key", "amount", F.when(shown, F.col("n")).alias("benchmark_n"), F.when(shown & (F.col("n") >= min_sample), F.col("p50")).alias("benchmark_p50"), F.col("rank").alias("percentile_rank")
    )
    return _beside(records, placed).withColumn("below_median", valid_amount(F.col("salary_amount")) < F.col("benchmark_p50"))


def label(key: Column) -> Column:
    return F.replace(key, F.lit(SEPARATOR), F.lit(" / "))

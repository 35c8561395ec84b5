"""Exact ranks and pages of tables of any size, without a task that sees all rows.

Rows are dealt to ranges of the order, each range is sorted and counted on its own, and a row's rank is its place in its
range after the rows of the ranges before it.  Only the list of ranges and their counts is summed in one place.  Orders
should end with a unique column; rows that are equal in them get ranks one after another in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offersieve.tables import stored


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ranked_by(rows: DataFrame, order: Sequence[Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """rows with their rank from 1 in an order; a column of that name is replaced."""
    rest = [c for c in rows.columns if c.lower() != name.lower()]
    part, before = _free(rows, "_range"), _free(rows, "_before")
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part).agg(F.count("*").alias(before))
    # A row for each range.
    starts = counts.select(F.col(part), (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, place).join(F.broadcast(starts), part).select(*rest, (F.col(name) + F.col(before)).cast("int").alias(name))


@dataclass(frozen=True)
class Pages:
    """A ranked table on disk, in order, whose pages are read by the ranges of rank of its files."""

    rows: DataFrame
    size: int
    n_rows: int

    @property
    def n_pages(self) -> int:
        return -(-self.n_rows // self.size)

    def page(self, number: int) -> DataFrame:
        """Page `number`, from 1, with the column rank."""
        return self.rows.where(F.col("rank").between((number - 1) * self.size + 1, number * self.size))


def paged(rows: DataFrame, order: Sequence[Column], size: int = 25) -> Pages:
    table = stored(ranked_by(rows, order), "pages")
    return Pages(table, size, table.count())


def after(rows: DataFrame, order: Sequence[str], last: Sequence[object] | None, size: int = 25) -> DataFrame:
    """The page that follows a row, whose values in the columns of the order are `last`; the first one for None.

    A name with a minus before it is descending.  Values must not be null.  Nothing before the page is sorted or counted.
    """
    names = [o.lstrip("-") for o in order]
    further, same = F.lit(last is None), F.lit(True)
    for o, name, value in zip(order, names, last or (), strict=False):
        step = F.col(name) < F.lit(value) if o.startswith("-") else F.col(name) > F.lit(value)
        further, same = further | (same & step), same & (F.col(name) == F.lit(value))
    return rows.where(further).orderBy(*[F.desc(n) if o.startswith("-") else F.asc(n) for o, n in zip(order, names, strict=True)]).limit(size)

"""Filters as predicates, with counters of what they drop, in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions.dates import strict_date
from offersieve.operators.grouping import dimension
from offersieve.schema import DIMENSIONS, OFFER_STATUSES


@dataclass(frozen=True)
class Filters:
    """Dimension lists, status list, and an inclusive date range on start_date or join_date; empty means all."""

    dimensions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    statuses: Sequence[str] = ()
    basis: str = "start_date"
    date_from: str | None = None
    date_to: str | None = None
    include_missing_date: bool = False
    salary_edges: Sequence[float] = ()

    def in_dimensions(self) -> Column:
        out = F.lit(True)
        for name, values in self.dimensions.items():
            if values:
                out = out & dimension(name, self.salary_edges).isin(list(values))
        return out

    def in_statuses(self) -> Column:
        return F.col("offer_status").isin(list(self.statuses)) if self.statuses else F.lit(True)

    def active(self) -> bool:
        """Whether anything is filtered."""
        return any(self.dimensions.values()) or bool(self.statuses) or self.has_range()

    def has_range(self) -> bool:
        return bool(self.date_from or self.date_to)

    def in_range(self) -> Column:
        """Three-valued: null for a missing date."""
        date, out = F.col(self.basis), F.lit(True)
        for bound, test in ((self.date_from, date.__ge__), (self.date_to, date.__le__)):
            if bound:
                limit = strict_date(F.lit(bound))  # an invalid bound does not bind
                out = out & F.when(limit.isNull(), True).otherwise(test(limit))
        return F.when(date.isNotNull(), out)

    def described(self) -> list[str]:
        out = [f"{DIMENSIONS[k]}：{'、'.join(v)}" for k, v in self.dimensions.items() if v]
        if self.statuses:
            out.append("offer状态：" + "、".join(s for s in OFFER_STATUSES if s in self.statuses))
        if self.has_range():
            out.append(f"{self.basis}：{self.date_from or '不限'} 至 {self.date_to or '不限'}" + ("（含缺失日期）" if self.include_missing_date else ""))
        return out

    def is_status_subset(self) -> bool:
        return bool(self.statuses)

    def issues(self) -> list[str]:
        """What is wrong with the typed dates."""
        import datetime

        out, parsed = [], []
        for bound in (self.date_from, self.date_to):
            try:
                parsed.append(datetime.date.fromisoformat(bound) if bound else None)
            except ValueError:
                parsed.append(None)
                out.append(f"日期格式无效：{bound}")
        if all(parsed) and parsed[0] > parsed[1]:
            out.append("开始日期晚于结束日期")
        return out


def retained(records: DataFrame) -> DataFrame:
    """Records that were not removed as duplicates."""
    return records.where(~F.col("dedup_action").eqNullSafe(F.lit("removedAsDuplicate")))


def apply_filters(records: DataFrame, filters: Filters) -> DataFrame:
    kept = retained(records).where(filters.in_dimensions() & filters.in_statuses())
    if not filters.has_range():
        return kept
    return kept.where(F.coalesce(filters.in_range(), F.lit(filters.include_missing_date)))


def filter_counters(records: DataFrame, filters: Filters) -> DataFrame:
    """One row: n_retained, n_after_dimensions, n_excluded_status, n_missing_date, n_kept, n_pending_duplicates.

    Statuses are counted after dimensions, dates after statuses; a missing date counts even if it is kept.
    """
    dims, status = filters.in_dimensions(), filters.in_statuses()
    here = dims & status
    ranged = filters.in_range() if filters.has_range() else F.lit(True)
    missing = F.col(filters.basis).isNull() if filters.has_range() else F.lit(False)
    kept = here & F.coalesce(ranged, F.lit(filters.include_missing_date))
    return retained(records).agg(
        F.count("*").alias("n_retained"), F.count_if(dims).alias("n_after_dimensions"), F.count_if(dims & ~status).alias("n_excluded_status"),
        F.count_if(here & missing).alias("n_missing_date"), F.count_if(kept).alias("n_kept"),
        F.count_if(F.col("dedup_action").eqNullSafe(F.lit("pendingUserConfirmation"))).alias("n_pending_duplicates"),
    )

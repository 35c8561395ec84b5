"""The analysis summary: key figures, tables of all dimensions, the profile of rejections, cycles, quality, notes.

All dimensions come from one pass: records are counted by dimension, key, status and cycle days before anything is
aggregated, so a large group arrives as few counted rows.  Two populations are kept apart: rates have D as denominator,
the profile compares rejected records with joined ones, and says how many are in neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.functions.numbers import rate
from offersieve.functions.text import is_blank
from offersieve.operators.grouping import dimension
from offersieve.operators.metrics import LONG_CYCLE_DAYS, actual_days, count_where, cycle_stats, planned_days, status_counts
from offersieve.operators.rejection import comparison_group, reason_distribution
from offersieve.schema import DIMENSIONS, UNFILLED
from offersieve.tables import stored

#: Records of both groups from which a profile cell can be published.
PROFILE_LEAST = 5


def _counted(records: DataFrame, names: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """(dimension, key, offer_status, days, _n) of all dimensions.

    """
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), dimension(n, edges).alias("key")) for n in names])
    rows = records.select("offer_status", actual_days().alias("days"), F.inline(pairs))
    return rows.groupBy("dimension", "key", "offer_status", "days").agg(F.count("*").alias("_n"))


def dimension_tables(records: DataFrame, names: Sequence[str] = DIMENSIONS, edges: Sequence[float] = ()) -> DataFrame:
    """(dimension, key, N, D, R, n_rejected_group, n_joined_group, n_compared, cycle_n, cycle_median) of every group."""
    return _tables(_counted(records, names, edges))


def _tables(values: DataFrame) -> DataFrame:
    n = F.col("_n")
    groups = values.groupBy("dimension", "key").agg(*status_counts(n), *cycle_stats(F.col("days"), "actual", n))
    return groups.select(
        "dimension", "key", F.col("n_total").alias("N"), F.col("n_core").alias("D"), F.col("n_rejected").alias("R"), F.col("n_rejected").alias("n_rejected_group"), F.col("n_joined").alias("n_joined_group"),
        (F.col("n_rejected") + F.col("n_joined")).alias("n_compared"), F.col("actual_n").alias("cycle_n"), F.col("actual_median").alias("cycle_median"),
    )


def rejection_profile(records: DataFrame, names: Sequence[str] = DIMENSIONS, edges: Sequence[float] = (), least: int = PROFILE_LEAST) -> DataFrame:
    """(dimension, key, n_rejected_group, n_joined_group, rejected_share, joined_share, contrast, usable).

    Shares are of the rejected and of the joined records: what the two groups are made of, not rates of rejection.  The
    contrast is their difference in percentage points.  Cells in neither group are left out; usable ones have `least`
    records in both together.
    """
    return _profile(records, _counted(records, names, edges), least)


def _profile(records: DataFrame, values: DataFrame, least: int) -> DataFrame:
    sides = [count_where(comparison_group() == s, F.col("_n")) for s in ("rejected", "joined")]
    cells = values.where(comparison_group().isNotNull()).groupBy("dimension", "key").agg(sides[0].alias("n_rejected_group"), sides[1].alias("n_joined_group"))
    totals = records.agg(*[count_where(comparison_group() == s).alias(f"_{s}") for s in ("rejected", "joined")])
    shares = [rate(F.col(f"n_{s}_group"), F.col(f"_{s}")) for s in ("rejected", "joined")]
    return cells.crossJoin(F.broadcast(totals)).select(  # one row
        "dimension", "key", "n_rejected_group", "n_joined_group", shares[0].alias("rejected_share"), shares[1].alias("joined_share"),
        (100 * (shares[0] - shares[1])).alias("contrast"), (F.col("n_rejected_group") + F.col("n_joined_group") >= least).alias("usable"),
    )


def key_figures(records: DataFrame, too_long: int = LONG_CYCLE_DAYS) -> DataFrame:
    """(section, measure, value) of the key figures, the compared groups, cycles and quality, in one aggregation."""
    counts = {c: f"n_{c}" for c in ("total", "joined", "pending", "approving", "rejected_offer", "rejected_verbally", "rejected", "core")}
    labels = dict(zip(counts, ("N", "J", "P", "A", "R1", "R2", "R", "D"), strict=True))
    one = records.agg(
        *status_counts(), *cycle_stats(actual_days(), "actual"), *cycle_stats(planned_days(), "planned"), count_where(actual_days() > too_long).alias("too_long"),
        count_where(F.col("salary_amount").isNull()).alias("missing_salary"), count_where(is_blank(F.col("school"))).alias("unknown_school"),
    )
    parts = [("kpi", labels[c], F.col(name)) for c, name in counts.items()] + [("kpi", "U", F.col("n_unknown") + F.col("n_other"))]
    parts += [("rejection", "excluded", F.col("n_pending") + F.col("n_approving") + F.col("n_other") + F.col("n_unknown"))]
    parts += [("cycle", c, F.col(c)) for c in ("actual_n", "actual_mean", "actual_median", "actual_p75", "planned_n", "planned_median", "too_long")]
    parts += [("quality", "unknown_status", F.col("n_unknown")), ("quality", "missing_salary", F.col("missing_salary")), ("quality", "unknown_school", F.col("unknown_school")), ("quality", "cycle_missing", F.col("n_total") - F.col("actual_n"))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("measure"), v.cast("double").alias("value")) for s, m, v in parts])))


def analysis_summary(records: DataFrame, names: Sequence[str] = DIMENSIONS, edges: Sequence[float] = (), disabled: Sequence[str] = (), too_long: int = LONG_CYCLE_DAYS) -> DataFrame:
    """(section, dimension, key, measure, value): the whole summary as one long table; disabled dimensions are left out."""
    names = [n for n in names if n not in disabled]
    none = F.lit(None).cast("string")

    def long(df: DataFrame, section: str, measures: Sequence[str]) -> DataFrame:
        values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(section).alias("section"), "dimension", "key", F.inline(values))

    # Five tables of the same records: these are joined and counted once.
    used = [c for c in records.columns if c in {*names, "salary_amount", "school", "offer_status", "start_date", "join_date", "rejection_reason"}]
    records = stored(records.select(*used), "records")
    values = stored(_counted(records, names, edges), "counted")
    out = key_figures(records, too_long).select("section", none.alias("dimension"), none.alias("key"), "measure", "value")
    out = out.union(long(_tables(values), "dimension", ("N", "D", "R", "n_compared", "cycle_n", "cycle_median")))
    out = out.union(long(_profile(records, values, PROFILE_LEAST).where("usable"), "profile", ("n_rejected_group", "n_joined_group", "contrast")))
    reasons = reason_distribution(records).select(none.alias("dimension"), F.col("category").alias("key"), F.col("n").alias("count"), (F.col("category") == UNFILLED).cast("int").alias("unfilled"))
    return out.union(long(reasons, "reasons", ("count", "unfilled")))


def notes(dedup: str, unavailable: Sequence[str] = (), comparable: bool = True) -> list[str]:
    """What the figures of a summary mean, in sentences without markup."""
    out = [
        "N 为保留的全部记录，含审批中；D 只含已入职、待入职与两类拒绝。",
        "入职率的分母是 D；审批中占比的分母是 N，二者不能并列比较。",
        "画像对比只看拒绝组与入职组，其余状态不参与，但仍计入 D 或 N。",
        "所有比率先合计分子与分母再相除，不对各组比率求平均。",
        "实际周期只取已入职且日期有效的记录；计划周期另列。",
        f"去重方式：{dedup}。",
    ]
    if unavailable:
        out.append(f"未提供的模块：{'、'.join(unavailable)}。")
    if not comparable:
        out.append("计薪单位尚未确认，与薪资有关的维度未提供。")
    return out

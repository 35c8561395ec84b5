"""The metric bundle: status counts, ratio-of-sums rates, cycles, coverage.

Rates are sums divided by sums, null without a denominator; group rates are
never averaged.  All metrics of a group come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions.dates import actual_cycle_days, cycle_between, expected_internship_days, planned_cycle_days
from offersieve.functions.numbers import rate
from offersieve.functions.text import is_blank, trim_space
from offersieve.schema import APPROVING, CORE, JOINED, OFFER_STATUSES, OTHER, PENDING, REJECTED, REJECTED_VERBALLY, REJECTIONS, UNKNOWN

#: Smallest denominator from which a conclusion is drawn, and longest usual cycle in days.
MIN_DENOMINATOR, LONG_CYCLE_DAYS = 10, 180


def _status() -> Column:
    return F.col("offer_status")


def is_accepted(status: Column | None = None) -> Column:
    """Null for 其他 and 未知."""
    status = _status() if status is None else status
    return F.when(~status.isin(OTHER, UNKNOWN), status.isin(JOINED, PENDING))


def is_rejected(status: Column | None = None) -> Column:
    status = _status() if status is None else status
    return F.when(~status.isin(OTHER, UNKNOWN), status.isin(*REJECTIONS))


def in_core(status: Column | None = None) -> Column:
    status = _status() if status is None else status
    return status.isin(*CORE)


def count_where(condition: Column, weight: Column | None = None) -> Column:
    """Rows where it holds; with a weight the sum of theirs, for rows that stand for several."""
    if weight is None:
        return F.count_if(F.coalesce(condition, F.lit(False)))
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))


def status_counts(weight: Column | None = None) -> list[Column]:
    """N, J, P, A, R1, R2, R, other, unknown, accepted and D."""
    count = lambda *s: count_where(_status().isin(*s), weight)
    return [
        count_where(F.lit(True), weight).alias("n_total"), count(JOINED).alias("n_joined"), count(PENDING).alias("n_pending"), count(APPROVING).alias("n_approving"),
        count(REJECTED).alias("n_rejected_offer"), count(REJECTED_VERBALLY).alias("n_rejected_verbally"), count(*REJECTIONS).alias("n_rejected"),
        count(OTHER).alias("n_other"), count(UNKNOWN).alias("n_unknown"), count(JOINED, PENDING).alias("n_accepted"), count(*CORE).alias("n_core"),
    ]


def core_rates() -> list[Column]:
    """Of a table with status counts."""
    c = F.col
    return [
        rate(c("n_accepted"), c("n_core")).alias("acceptance_rate"), rate(c("n_joined"), c("n_core")).alias("joined_rate"),
        rate(c("n_rejected"), c("n_core")).alias("rejection_rate"), rate(c("n_pending"), c("n_core")).alias("pending_core_share"),
        rate(c("n_pending"), c("n_total")).alias("pending_share"), rate(c("n_approving"), c("n_total")).alias("approving_share"),
    ]


def actual_days() -> Column:
    return actual_cycle_days(_status(), F.col("start_date"), F.col("join_date"))


def planned_days() -> Column:
    return planned_cycle_days(_status(), F.col("start_date"), F.col("join_date"))


def cycle_stats(days: Column, name: str, weight: Column | None = None) -> list[Column]:
    """n, mean, exact quartiles, and the rows without a valid cycle."""
    weight = F.lit(1).cast("long") if weight is None else weight
    q = F.percentile(days, [0.25, 0.5, 0.75], weight)
    n = count_where(days.isNotNull(), weight)
    return [
        n.alias(f"{name}_n"), rate(F.sum(days * weight), n).alias(f"{name}_mean"), q[0].alias(f"{name}_p25"), q[1].alias(f"{name}_median"), q[2].alias(f"{name}_p75"),
        count_where(days.isNull(), weight).alias(f"{name}_excluded"),
    ]


def bundled(records: DataFrame, **keys: Column) -> DataFrame:
    """keys plus everything a group shows: status counts, cycles, different requirements, rows without one, filled reasons."""
    return bundle_of(counted(records, **keys), *keys)


def counted(records: DataFrame, **keys: Column) -> DataFrame:
    """Different values of what a bundle needs, by keys (as columns with a _ before), with their number _n.

    Each record gives two rows, what it counts for and its requirement; equal rows are counted first, on the map side and
    then in one shuffle, so that a large group comes to its quantiles and different requirements as few counted values.
    """
    blank = is_blank(F.col("requirement_id"))
    filled = ~is_blank(F.col("rejection_reason")) & _status().isin(*REJECTIONS)
    none = lambda kind: F.lit(None).cast(kind)
    facts = F.struct(
        _status().alias("offer_status"), actual_days().alias("actual"), planned_days().alias("planned"), filled.alias("filled"), blank.alias("no_requirement"),
        F.lit(True).alias("is_record"), none("string").alias("requirement"),
    )
    requirement = F.struct(
        none("string").alias("offer_status"), none("int").alias("actual"), none("int").alias("planned"), none("boolean").alias("filled"), none("boolean").alias("no_requirement"),
        F.lit(False).alias("is_record"), trim_space(F.col("requirement_id")).alias("requirement"),
    )
    both = F.when(blank, F.array(facts)).otherwise(F.array(facts, requirement))
    rows = records.select(*[value.alias(f"_{name}") for name, value in keys.items()], F.inline(both))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))


def merged(parts: DataFrame, **keys: Column) -> DataFrame:
    """Counted values under other keys, for which groups are put together: equal ones are summed."""
    facts = ("offer_status", "actual", "planned", "filled", "no_requirement", "is_record", "requirement")
    named = {f"_{name}": value for name, value in keys.items()}
    return parts.select(*[value.alias(name) for name, value in named.items()], *facts, "_n").groupBy(*named, *facts).agg(F.sum("_n").alias("_n"))


def bundle_of(values: DataFrame, *keys: str) -> DataFrame:
    """The bundle of counted values, by keys."""
    names = {f"_{name}": name for name in keys}
    n = F.when(F.col("is_record"), F.col("_n"))  # what a requirement counts for in the figures of records: nothing
    weight = F.coalesce(n, F.lit(0))
    out = values.groupBy(*names).agg(
        *status_counts(n), *cycle_stats(F.col("actual"), "actual", weight), *cycle_stats(F.col("planned"), "planned", weight),
        F.count("requirement").alias("n_requirements"), count_where(F.col("no_requirement"), n).alias("n_requirement_missing"), count_where(F.col("filled"), n).alias("n_reason_filled"),
    )
    return out.withColumnsRenamed(names)


def with_rates(grouped: DataFrame) -> DataFrame:
    out = grouped.select("*", *core_rates())
    if "n_reason_filled" in grouped.columns:
        out = out.withColumn("reason_fill_rate", rate(F.col("n_reason_filled"), F.col("n_rejected")))
    return out


def summarize(records: DataFrame) -> DataFrame:
    """The bundle over all records: one row."""
    return with_rates(bundled(records))


def identity_holds(counts: DataFrame) -> DataFrame:
    """counts plus whether N = J + P + A + R1 + R2 + other + unknown."""
    parts = ("n_joined", "n_pending", "n_approving", "n_rejected_offer", "n_rejected_verbally", "n_other", "n_unknown")
    return counts.withColumn("identity_holds", F.col("n_total") == sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def status_composition(records: DataFrame) -> DataFrame:
    """(status, n, share): all seven statuses, also those with no row."""
    spark = records.sparkSession
    known = spark.createDataFrame([(i, s) for i, s in enumerate(OFFER_STATUSES)], "position int, status string")
    counts = records.groupBy(_status().alias("status")).agg(F.count("*").alias("n"))
    total = records.agg(F.count("*").alias("total"))
    out = F.broadcast(known).join(counts, "status", "left").crossJoin(F.broadcast(total))  # seven rows and one
    return out.select("position", "status", F.coalesce("n", F.lit(0)).alias("n"), rate(F.coalesce("n", F.lit(0)), F.col("total")).alias("share"))


def sufficiency(denominator: Column, least: int = MIN_DENOMINATOR) -> Column:
    return F.when(denominator <= 0, F.lit("none")).when(denominator < least, F.lit("small")).otherwise(F.lit("sufficient"))


def cycles(records: DataFrame) -> DataFrame:
    """(kind, n, mean, p25, median, p75, excluded, n_too_long) of actual, planned and expected cycles."""
    expected = expected_internship_days(F.col("join_date"), F.col("end_date")) if "end_date" in records.columns else F.lit(None).cast("int")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), d.alias("days")) for k, d in (("actual", actual_days()), ("planned", planned_days()), ("expected", expected))])
    long_form = records.select(F.inline(pairs))
    stats = cycle_stats(F.col("days"), "days")
    out = long_form.groupBy("kind").agg(*stats, count_where(F.col("days") > LONG_CYCLE_DAYS).alias("n_too_long"))
    return out.select("kind", *[F.col(f"days_{c}").alias(c) for c in ("n", "mean", "p25", "median", "p75", "excluded")], "n_too_long")


def expected_cycle_excluded(records: DataFrame) -> DataFrame:
    return records.select(cycle_between(F.col("join_date"), F.col("end_date")).alias("days")).agg((F.count("*") - F.count("days")).alias("excluded"))

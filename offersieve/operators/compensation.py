"""Salary distributions, histograms, housing, and cash totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offersieve.functions.numbers import MIN_SAMPLE, round_half_up, valid_amount
from offersieve.schema import CASH, LODGING, NO_SUBSIDY, OTHER, UNIT_PERIODS, UNKNOWN

#: Up to so many different values, each is a bin of its own.
VALUE_BINS = 12


def total_cash() -> Column:
    """(salary, housing_cash, total, alignable) of a record."""
    salary, housing = valid_amount(F.col("salary_amount")), valid_amount(F.col("housing_amount"))
    kind = F.col("housing_type")
    period = F.lit(None).cast("string")
    for unit, p in UNIT_PERIODS.items():
        period = F.when(F.col("salary_unit") == unit, F.lit(p)).otherwise(period)
    fits = F.coalesce((F.col("housing_period") == period) & salary.isNotNull() & housing.isNotNull(), F.lit(False))
    cash = F.when(kind == NO_SUBSIDY, F.lit(0.0)).when(kind == CASH, housing)
    total = F.when(kind == NO_SUBSIDY, salary).when((kind == CASH) & fits, salary + housing)
    return F.struct(salary.alias("salary"), cash.alias("housing_cash"), total.alias("total"), ((kind == NO_SUBSIDY) | ((kind == CASH) & fits)).alias("alignable"))


def salary_by_unit(records: DataFrame, min_sample: int = MIN_SAMPLE, comparable: bool = True) -> DataFrame:
    """(unit, n_records, n, n_excluded, sufficient, p25, p50, p75, mean, min, max); figures only from min_sample values on."""
    amount = valid_amount(F.col("salary_amount"))
    enough = F.count(amount) >= min_sample
    q = F.when(enough, F.percentile(amount, [0.25, 0.5, 0.75]))
    return records.where(F.lit(comparable)).groupBy(F.col("salary_unit").alias("unit")).agg(
        F.count("*").alias("n_records"), F.count(amount).alias("n"), (F.count("*") - F.count(amount)).alias("n_excluded"), enough.alias("sufficient"),
        q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"),
        F.when(enough, F.avg(amount)).alias("mean"), F.when(enough, F.min(amount)).alias("min"), F.when(enough, F.max(amount)).alias("max"),
    )


def histogram(records: DataFrame, bins: int = 8, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """(unit, bin, low, high, n): each different value up to VALUE_BINS of them, else equal widths, the last one closed."""
    amount = valid_amount(F.col("salary_amount"))
    values = records.select(F.col("salary_unit").alias("unit"), amount.alias("v")).where("v is not null").groupBy("unit", "v").agg(F.count("*").alias("n"))
    facts = values.groupBy("unit").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")).where(F.col("total") >= min_sample)
    joined = values.join(facts, values["unit"].eqNullSafe(facts["unit"])).drop(facts["unit"])
    single = joined.where(F.col("kinds") <= VALUE_BINS)
    place = F.row_number().over(Window.partitionBy("unit").orderBy("v")) - 1  # at most VALUE_BINS rows
    single = single.select("unit", place.cast("int").alias("bin"), F.col("v").alias("from"), F.lit(None).cast("double").alias("to"), "n")
    count = max(1, int(bins))
    width = (F.col("high") - F.col("low")) / count
    grid = facts.where(F.col("kinds") > VALUE_BINS).select("unit", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bin"))
    index = F.least(F.greatest(F.floor((F.col("v") - F.col("low")) / width), F.lit(0)), F.lit(count - 1)).cast("int")
    filled = joined.where(F.col("kinds") > VALUE_BINS).groupBy(F.col("unit").alias("u"), index.alias("b")).agg(F.sum("n").alias("n"))
    end = F.when(F.col("bin") == count - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * width)
    wide = grid.join(filled, grid["unit"].eqNullSafe(filled["u"]) & (grid["bin"] == filled["b"]), "left").select(
        "unit", "bin", round_half_up(F.col("low") + F.col("bin") * width).alias("from"), round_half_up(end).alias("to"), F.coalesce("n", F.lit(0)).alias("n")
    )
    return single.unionByName(wide).select("unit", "bin", F.col("from").alias("low"), F.col("to").alias("high"), "n")


def housing_cash_by_period(records: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """(period, n, n_excluded, sufficient, p25, p50, p75) of cash housing subsidies."""
    amount = valid_amount(F.col("housing_amount"))
    enough = F.count(amount) >= min_sample
    q = F.when(enough, F.percentile(amount, [0.25, 0.5, 0.75]))
    cash = records.where(F.col("housing_type") == CASH)
    return cash.groupBy(F.col("housing_period").alias("period")).agg(
        F.count(amount).alias("n"), (F.count("*") - F.count(amount)).alias("n_excluded"), enough.alias("sufficient"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75")
    )


def housing_counters(records: DataFrame) -> DataFrame:
    kind = F.col("housing_type")
    missing = (kind == CASH) & valid_amount(F.col("housing_amount")).isNull()
    return records.agg(
        F.count_if(kind == LODGING).alias("n_lodging"), F.count_if(kind == NO_SUBSIDY).alias("n_no_subsidy"),
        F.count_if(missing).alias("n_cash_amount_missing"), F.count_if(kind.isin(UNKNOWN, OTHER)).alias("n_unknown_or_other"),
    )


def histogram_notes(records: DataFrame, bins: int = 8, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """(unit, binning, n_values, n_bins): why a unit's histogram looks as it does: too few, single values or equal widths."""
    amount = valid_amount(F.col("salary_amount"))
    values = records.select(F.col("salary_unit").alias("unit"), amount.alias("v")).groupBy("unit", "v").agg(F.count("v").alias("n"))
    facts = values.groupBy("unit").agg(F.sum("n").alias("total"), F.count("v").alias("n_values"))
    few, single = F.col("total") < min_sample, F.col("n_values") <= VALUE_BINS
    binning = F.when(few, F.lit("tooFew")).when(single, F.lit("singleValues")).otherwise(F.lit("equalWidths"))
    n_bins = F.when(few, F.lit(0)).when(single, F.col("n_values")).otherwise(F.lit(max(1, int(bins))))
    return facts.select("unit", binning.alias("binning"), "n_values", n_bins.cast("long").alias("n_bins"))

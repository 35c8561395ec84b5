"""Grouping by dimension and month, cross tables, top-N with a remainder, facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions.dates import month_of
from offersieve.functions.numbers import band_of, cycle_band_of
from offersieve.functions.text import text_or_unknown, tri_label
from offersieve.operators.metrics import actual_days, bundle_of, bundled, count_where, counted, merged, with_rates
from offersieve.operators.ranking import ranked_by
from offersieve.schema import CORE, UNKNOWN, UNSPLIT
from offersieve.tables import stored


def by_core() -> tuple[Column, ...]:
    """Order of groups: D, then N, then key."""
    return F.desc("n_core"), F.desc("n_total"), F.asc("key")


def dimension(name: str, edges: Sequence[float] = ()) -> Column:
    """A record's group label; blank is 未知, negative salaries count as 0."""
    c = F.col(name) if name != "salary_band" else F.col("salary_amount")
    if name == "salary_band":
        return F.coalesce(band_of(F.when(c < 0, 0.0).otherwise(c), edges), F.lit(UNKNOWN))
    if name == "is_gpt":
        return tri_label(c)
    return text_or_unknown(c.cast("string"))


def aggregate_by(records: DataFrame, key: str | Column, edges: Sequence[float] = ()) -> DataFrame:
    """The bundle and its rates for each value of a dimension, or of any column."""
    value = key if isinstance(key, Column) else dimension(key, edges)
    return with_rates(bundled(records, key=value))


def aggregate_all(records: DataFrame, names: Sequence[str], metrics: Sequence[Column], edges: Sequence[float] = ()) -> DataFrame:
    """Several dimensions in one pass: (dimension, key, metrics)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), dimension(n, edges).alias("key")) for n in names])
    return records.select("*", F.explode(pairs).alias("_d")).groupBy("_d.dimension", "_d.key").agg(*metrics)


def aggregate_by_month(records: DataFrame, basis: str = "start_date") -> DataFrame:
    """By month of a date; rows without one form the group of key null."""
    return with_rates(bundled(records, key=month_of(F.col(basis))))


def covers_all(timeline: DataFrame, records: DataFrame) -> DataFrame:
    """One row: whether the groups of a timeline, that without a date among them, hold every record once."""
    grouped = timeline.agg(F.coalesce(F.sum("n_total"), F.lit(0)).alias("n_grouped"))
    total = records.agg(F.count("*").alias("n_records"))
    return grouped.crossJoin(total).withColumn("covers_all", F.col("n_grouped") == F.col("n_records"))  # one row each


def with_cycles(groups: DataFrame) -> DataFrame:
    """Groups that have an actual or a planned cycle to show."""
    return groups.where((F.col("actual_n") > 0) | (F.col("planned_n") > 0))


def n_unsplit(records: DataFrame) -> DataFrame:
    """One row: records whose requirement type was not told apart."""
    return records.agg(F.count_if(F.col("requirement_type") == UNSPLIT).alias("n_unsplit"))


def aggregate_by_cycle_band(records: DataFrame) -> DataFrame:
    band = cycle_band_of(actual_days())
    return with_rates(bundled(records.where(band.isNotNull()), key=band))


def cross_table(records: DataFrame, rows: str, columns: str, metrics: Sequence[Column], edges: Sequence[float] = ()) -> DataFrame:
    """(row_key, column_key, metrics): all cells also without records, totals with a null key, each aggregated anew."""
    keyed = records.withColumns({"row_key": dimension(rows, edges), "column_key": dimension(columns, edges)})
    cube = keyed.cube("row_key", "column_key").agg(*metrics)
    # Key lists have as many rows as a dimension has values.
    grid = cube.where("row_key is not null and column_key is null").select("row_key").crossJoin(cube.where("row_key is null and column_key is not null").select("column_key"))
    every = grid.union(cube.where("row_key is null or column_key is null").select("row_key", "column_key"))
    same = F.col("e.row_key").eqNullSafe(F.col("c.row_key")) & F.col("e.column_key").eqNullSafe(F.col("c.column_key"))
    names = [c for c in cube.columns if c not in ("row_key", "column_key")]
    counts = {f.name for f in cube.schema.fields if f.dataType.typeName() == "long"}
    return every.alias("e").join(cube.alias("c"), same, "left").select(
        "e.row_key", "e.column_key", *[F.coalesce(f"c.{n}", F.lit(0)).alias(n) if n in counts else F.col(f"c.{n}") for n in names]
    )


def ranked(groups: DataFrame) -> DataFrame:
    """groups plus their rank by D, N and key."""
    return ranked_by(groups, by_core())


def top_with_other(records: DataFrame, name: str, n: int, edges: Sequence[float] = ()) -> DataFrame:
    """The first n groups and one for the rest, aggregated from its records; all groups if there are no more than n, or n is 0."""
    values = counted(records, key=dimension(name, edges))
    if n > 0:
        # Records are read once: the first n and the rest are both made of the counted values.
        values = stored(values, "counted")
        core = count_where(F.col("offer_status").isin(*CORE), F.col("_n"))
        sizes = values.where("is_record").groupBy(F.col("_key").alias("key")).agg(core.alias("n_core"), F.sum("_n").alias("n_total"))
        # D and N of each key are enough to find the first n; only these and one count go to all tasks.
        first = sizes.orderBy(*by_core()).limit(n).select(F.col("key").alias("_first"))
        groups = sizes.agg(F.count("*").alias("_groups"))
        rest = F.concat(F.lit("其他（"), (F.col("_groups") - n).cast("string"), F.lit(" 个分组合并）"))
        values = values.join(F.broadcast(first), F.col("_key") == F.col("_first"), "left").crossJoin(F.broadcast(groups))
        values = merged(values, key=F.coalesce("_first", rest))
    return with_rates(bundle_of(values, "key")).withColumn("is_merged", F.col("key").rlike(r"^其他（\d+ 个分组合并）$"))


def facets(records: DataFrame, name: str, edges: Sequence[float] = ()) -> DataFrame:
    """(key, n, position): values by count, then value; 未知 last."""
    counts = records.groupBy(dimension(name, edges).alias("key")).agg(F.count("*").alias("n"))
    return ranked_by(counts, [(F.col("key") == UNKNOWN).cast("int").asc(), F.desc("n"), F.asc("key")], "position")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 25) -> DataFrame:
    """Page `number` (from 1) of a table; `ranking.paged` keeps the table for more of them."""
    rank = "_page_rank"
    return ranked_by(df, order, rank).where(F.col(rank).between((number - 1) * size + 1, number * size)).drop(rank)


def for_chart(groups: DataFrame, metric: str) -> DataFrame:
    """Groups by one metric, missing values last."""
    return ranked_by(groups, [F.desc_nulls_last(metric), *by_core()], "position")


def scatter_points(groups: DataFrame, smallest: float = 8, largest: float = 40) -> DataFrame:
    """Groups with a rate, their symbol scaled by the largest N."""
    known = groups.where(F.col("rejection_rate").isNotNull() & ~F.col("key").rlike(r"^其他（\d+ 个分组合并）$"))
    known = known.crossJoin(F.broadcast(known.agg(F.max("n_total").alias("_largest"))))  # one row
    share = F.sqrt(F.col("n_total") / F.col("_largest"))
    return known.select("key", "n_total", "n_core", "rejection_rate", (smallest + (largest - smallest) * share).alias("symbol_size"))


def ranking_availability(groups: DataFrame, least: int = 10) -> DataFrame:
    """One row: known recruiters, those with D of at least `least`, and whether two of them can be ranked."""
    known = groups.where(F.col("key") != UNKNOWN)
    ready = F.count_if(F.col("n_core") >= least)
    return known.agg(F.count("*").alias("n_known"), ready.alias("n_rankable"), (ready >= 2).alias("can_rank"))


def source_counts(records: DataFrame, column: str) -> DataFrame:
    """Records by where a value came from."""
    return records.groupBy(F.coalesce(column, F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))

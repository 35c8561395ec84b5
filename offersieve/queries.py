"""Registered queries of the analytics operators, with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.bindings import OFFERS_SQL, offers
from offersieve.functions import numbers
from offersieve.functions.dates import expected_internship_days, month_range, parse_date_cell, waiting
from offersieve.functions.text import cell_text, display_id, looks_like_identifier, safe_cell
from offersieve.operators import benchmarks, cleaning, compensation, duplicates, grouping, mapping, metrics, quality, ranking, rejection
from offersieve.operators.filters import Filters, apply_filters, filter_counters, retained
from offersieve.plans import digests, linked, privacy, report, scan, summary
from offersieve.schema import DIMENSIONS, MODULES, OFFER_STATUSES, REASON_CATEGORIES, REASON_WORDS
from offersieve.sources import vault, versions
from offersieve.tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2001-09-01"
EDGES = (920, 940, 960, 980)

# ------------------------------------------------------------------ SQL fragments
_J, _P, _A, _R1, _R2 = (f"offer_status = '{s}'" for s in OFFER_STATUSES[:5])
_REJ = "offer_status IN ('拒绝offer', '拒绝口头offer')"
_CORE = "offer_status IN ('已入职', '待入职', '拒绝offer', '拒绝口头offer')"
_DAYS = "date_diff('day', start_date, join_date)"
_ACTUAL = f"CASE WHEN {_J} AND {_DAYS} >= 0 THEN {_DAYS} END"
_PLANNED = f"CASE WHEN {_P} AND {_DAYS} >= 0 THEN {_DAYS} END"


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


COUNTS_SQL = f"""count(*) AS n_total, {_n(_J)} AS n_joined, {_n(_P)} AS n_pending, {_n(_A)} AS n_approving, {_n(_R1)} AS n_rejected_offer,
 {_n(_R2)} AS n_rejected_verbally, {_n(_REJ)} AS n_rejected, {_n("offer_status = '其他'")} AS n_other, {_n("offer_status = '未知'")} AS n_unknown,
 {_n(f"{_J} OR {_P}")} AS n_accepted, {_n(_CORE)} AS n_core"""


def _cycle_sql(days: str, name: str) -> str:
    return f"""count({days}) AS {name}_n, round(avg({days}), 6) AS {name}_mean, quantile_cont({days}, 0.25) AS {name}_p25,
 quantile_cont({days}, 0.5) AS {name}_median, quantile_cont({days}, 0.75) AS {name}_p75, count(*) - count({days}) AS {name}_excluded"""


def _rate_sql(a: str, b: str, name: str) -> str:
    return f"round({a}::DOUBLE / nullif({b}, 0), 6) AS {name}"


RATES_SQL = ", ".join(
    _rate_sql(a, b, n)
    for a, b, n in (
        ("n_accepted", "n_core", "acceptance_rate"), ("n_joined", "n_core", "joined_rate"), ("n_rejected", "n_core", "rejection_rate"),
        ("n_pending", "n_core", "pending_core_share"), ("n_pending", "n_total", "pending_share"), ("n_approving", "n_total", "approving_share"),
        ("n_reason_filled", "n_rejected", "reason_fill_rate"),
    )
)
BUNDLE_SQL = f"""{COUNTS_SQL}, {_cycle_sql(_ACTUAL, "actual")}, {_cycle_sql(_PLANNED, "planned")},
 count(DISTINCT requirement_id) AS n_requirements, {_n("requirement_id IS NULL")} AS n_requirement_missing,
 {_n(f"rejection_reason IS NOT NULL AND {_REJ}")} AS n_reason_filled"""


def _sql(body: str) -> str:
    return f"WITH offers AS ({OFFERS_SQL}) {body}"


def _by_sql(key: str, where: str = "TRUE") -> str:
    return _sql(f"SELECT *, {RATES_SQL} FROM (SELECT {key} AS key, {BUNDLE_SQL} FROM offers WHERE {where} GROUP BY 1)")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, dates as text, for comparison."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c) for c in df.columns])


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _rounded(query(offers(spark, sf_dir)))
    if sql is not None:
        ORACLE_SQL[name] = sql


# ------------------------------------------------------------------ grouping and metrics
_register("rejection_by_city", lambda d: grouping.aggregate_by(d, "city"), _by_sql("city"))
_LABELS = {
    "graduation_year": "coalesce(CAST(graduation_year AS VARCHAR), '未知')",
    "is_gpt": "CASE WHEN is_gpt THEN '是' WHEN NOT is_gpt THEN '否' ELSE '未知' END",
    "salary_band": "CASE WHEN salary_amount IS NULL THEN '未知' WHEN salary_amount >= 980 THEN '≥980' WHEN salary_amount >= 960 THEN '960–979' "
    "WHEN salary_amount >= 940 THEN '940–959' WHEN salary_amount >= 920 THEN '920–939' ELSE '<920' END",
}
for _name in DIMENSIONS:
    if _name != "city":
        _register(f"group_by_{_name}", lambda d, n=_name: grouping.aggregate_by(d, n, EDGES), _by_sql(_LABELS.get(_name, f"coalesce({_name}, '未知')")))
_register("summary", metrics.summarize, _sql(f"SELECT *, {RATES_SQL} FROM (SELECT {BUNDLE_SQL} FROM offers)"))
_register(
    "status_identity",
    lambda d: metrics.identity_holds(d.groupBy("department").agg(*metrics.status_counts())),
    _sql(f"SELECT *, n_total = n_joined + n_pending + n_approving + n_rejected_offer + n_rejected_verbally + n_other + n_unknown AS identity_holds FROM (SELECT department, {COUNTS_SQL} FROM offers GROUP BY 1)"),
)
_VALUES = lambda items: ", ".join(f"({i}, '{s}')" for i, s in enumerate(items))
_register(
    "status_composition",
    metrics.status_composition,
    _sql(f"SELECT k.position, status, count(o.record_id) AS n, round(count(o.record_id)::DOUBLE / (SELECT count(*) FROM offers), 6) AS share FROM (VALUES {_VALUES(OFFER_STATUSES)}) k(position, status) LEFT JOIN offers o ON o.offer_status = k.status GROUP BY 1, 2"),
)
_register("timeline_by_start", grouping.aggregate_by_month, _by_sql("strftime(start_date, '%Y-%m')"))
_register("timeline_by_join", lambda d: grouping.aggregate_by_month(d, "join_date"), _by_sql("strftime(join_date, '%Y-%m')"))
_BAND = f"CAST(floor({_ACTUAL} / 10) * 10 AS INT)"
_register("cycle_bands", grouping.aggregate_by_cycle_band, _by_sql(f"concat({_BAND}, '-', {_BAND} + 9, '天')", f"({_ACTUAL}) IS NOT NULL"))
_register(
    "cycle_stats",
    metrics.cycles,
    _sql(f"""SELECT kind, count(d) AS n, round(avg(d), 6) AS mean, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS p75,
 count(*) - count(d) AS excluded, count(*) FILTER (WHERE d > 180) AS n_too_long
 FROM (SELECT 'actual' AS kind, {_ACTUAL} AS d FROM offers UNION ALL SELECT 'planned', {_PLANNED} FROM offers UNION ALL SELECT 'expected', NULL FROM offers) GROUP BY 1"""),
)
_register(
    "sample_sufficiency",
    lambda d: d.groupBy("position").agg(*metrics.status_counts()).select("position", "n_core", metrics.sufficiency(F.col("n_core"), 800).alias("sufficiency")),
    _sql(f"SELECT position, n_core, CASE WHEN n_core <= 0 THEN 'none' WHEN n_core < 800 THEN 'small' ELSE 'sufficient' END AS sufficiency FROM (SELECT position, {_n(_CORE)} AS n_core FROM offers GROUP BY 1)"),
)
_register(
    "cross_table",
    lambda d: grouping.cross_table(d, "city", "channel", metrics.status_counts()),
    _sql(f"""SELECT e.row_key, e.column_key, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_total", "n_joined", "n_pending", "n_approving", "n_rejected_offer", "n_rejected_verbally", "n_rejected", "n_other", "n_unknown", "n_accepted", "n_core"))}
 FROM (SELECT a.city AS row_key, b.channel AS column_key FROM (SELECT DISTINCT city FROM offers UNION ALL SELECT NULL) a CROSS JOIN (SELECT DISTINCT channel FROM offers UNION ALL SELECT NULL) b) e
 LEFT JOIN (SELECT city AS row_key, channel AS column_key, {COUNTS_SQL} FROM offers GROUP BY CUBE (city, channel)) c
 ON e.row_key IS NOT DISTINCT FROM c.row_key AND e.column_key IS NOT DISTINCT FROM c.column_key"""),
)
_TOP = f"""SELECT coalesce(position, '未知') AS k, row_number() OVER (ORDER BY {_n(_CORE)} DESC, count(*) DESC, coalesce(position, '未知')) AS rank, count(*) OVER () AS groups FROM offers GROUP BY 1"""
_register(
    "top_positions_with_other",
    lambda d: grouping.top_with_other(d, "position", 5),
    _sql(f"""SELECT *, {RATES_SQL}, key LIKE '其他（%个分组合并）' AS is_merged FROM (SELECT CASE WHEN groups <= 5 OR rank <= 5 THEN k ELSE concat('其他（', groups - 5, ' 个分组合并）') END AS key, {BUNDLE_SQL}
 FROM offers JOIN ({_TOP}) t ON coalesce(position, '未知') = t.k GROUP BY 1)"""),
)
_register(
    "facets_school",
    lambda d: grouping.facets(d, "school"),
    _sql("SELECT key, n, row_number() OVER (ORDER BY key = '未知', n DESC, key) AS position FROM (SELECT coalesce(school, '未知') AS key, count(*) AS n FROM offers GROUP BY 1)"),
)
_register(
    "dimension_counts",
    lambda d: grouping.aggregate_all(d, ["city", "channel", "housing_type", "is_gpt"], metrics.status_counts()),
    _sql(" UNION ALL ".join(f"SELECT '{n}' AS dimension, {_LABELS.get(n, n)} AS key, {COUNTS_SQL} FROM offers GROUP BY 2" for n in ("city", "channel", "housing_type", "is_gpt"))),
)
_register(
    "recruiter_ranking",
    lambda d: grouping.ranked(d.where("recruiter is not null").groupBy(F.col("recruiter").alias("key")).agg(*metrics.status_counts())).where("n_core >= 10").select("key", "n_core", "n_total", "rank"),
    _sql(f"SELECT key, n_core, n_total, rank FROM (SELECT *, row_number() OVER (ORDER BY n_core DESC, n_total DESC, key) AS rank FROM (SELECT recruiter AS key, {_n(_CORE)} AS n_core, count(*) AS n_total FROM offers WHERE recruiter IS NOT NULL GROUP BY 1)) WHERE n_core >= 10"),
)
_register(
    "scatter_points",
    lambda d: grouping.scatter_points(metrics.with_rates(d.groupBy(F.col("position").alias("key")).agg(*metrics.status_counts()))),
    _sql(f"SELECT key, n_total, n_core, round(n_rejected::DOUBLE / n_core, 6) AS rejection_rate, round(8 + 32 * sqrt(n_total::DOUBLE / max(n_total) OVER ()), 6) AS symbol_size FROM (SELECT position AS key, {COUNTS_SQL} FROM offers GROUP BY 1) WHERE n_core > 0"),
)

# ------------------------------------------------------------------ filters
_FILTERS = Filters({"city": ["上海", "广州"], "salary_band": ["940–959", "≥980"]}, ("已入职", "拒绝offer", "待入职"), "join_date", "1996-01-01", "1999-12-31", True, EDGES)
_IN_DIMS = f"city IN ('上海', '广州') AND {_LABELS['salary_band']} IN ('940–959', '≥980')"
_IN_STATUS = "offer_status IN ('已入职', '拒绝offer', '待入职')"
_IN_RANGE = "coalesce(join_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31', TRUE)"
_KEPT = "dedup_action <> 'removedAsDuplicate'"
_register("filtered_by_channel", lambda d: grouping.aggregate_by(apply_filters(d, _FILTERS), "channel"), _by_sql("channel", f"{_KEPT} AND {_IN_DIMS} AND {_IN_STATUS} AND {_IN_RANGE}"))
_register(
    "filter_counters",
    lambda d: filter_counters(d, _FILTERS),
    _sql(f"""SELECT count(*) AS n_retained, {_n(_IN_DIMS)} AS n_after_dimensions, {_n(f"{_IN_DIMS} AND NOT {_IN_STATUS}")} AS n_excluded_status,
 {_n(f"{_IN_DIMS} AND {_IN_STATUS} AND join_date IS NULL")} AS n_missing_date, {_n(f"{_IN_DIMS} AND {_IN_STATUS} AND {_IN_RANGE}")} AS n_kept,
 {_n("dedup_action = 'pendingUserConfirmation'")} AS n_pending_duplicates FROM offers WHERE {_KEPT}"""),
)
_register("retained_counts", lambda d: retained(d).groupBy("offer_status").agg(F.count("*").alias("n")), _sql(f"SELECT offer_status, count(*) AS n FROM offers WHERE {_KEPT} GROUP BY 1"))

# ------------------------------------------------------------------ benchmarks and compensation
_KEY = "CASE WHEN city NOT IN ('其他', '未知') AND currency IS NOT NULL AND salary_unit IS NOT NULL THEN concat_ws(chr(31), city, job_family, position, currency, salary_unit) END"
_SAMPLES = f"SELECT {_KEY} AS group_key, salary_amount AS amount FROM offers WHERE salary_amount IS NOT NULL AND {_KEY} IS NOT NULL"
_BENCH = "SELECT group_key, count(*) AS n, CASE WHEN count(*) >= 5 THEN quantile_cont(amount, 0.25) END AS p25, CASE WHEN count(*) >= 5 THEN quantile_cont(amount, 0.5) END AS p50, CASE WHEN count(*) >= 5 THEN quantile_cont(amount, 0.75) END AS p75, count(*) >= 5 AS sufficient FROM samples GROUP BY 1"
_register("salary_benchmarks", benchmarks.build, _sql(f", samples AS ({_SAMPLES}) SELECT group_key, n, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, sufficient FROM ({_BENCH})"))
_RANKS = "SELECT group_key, amount, (count(*) FILTER (WHERE b < amount) + CAST(0.5 AS DOUBLE) * count(*) FILTER (WHERE b = amount)) / count(*) AS rank FROM (SELECT DISTINCT group_key, amount FROM samples) JOIN (SELECT group_key AS g, amount AS b FROM samples) ON group_key = g GROUP BY 1, 2"
_register("percentile_ranks", benchmarks.ranks, _sql(f", samples AS ({_SAMPLES}) SELECT group_key, amount, round(rank, 6) AS rank FROM ({_RANKS})"))
_register(
    "decorated_records",
    lambda d: benchmarks.decorate(apply_filters(d, Filters(statuses=("拒绝offer",))), d).groupBy("city", "below_median").agg(F.count("*").alias("n"), F.avg("percentile_rank").alias("mean_rank"), F.sum("benchmark_n").alias("sum_n")),
    _sql(f""", samples AS ({_SAMPLES}), bench AS ({_BENCH}), ranks AS ({_RANKS}), mine AS (SELECT *, {_KEY} AS k FROM offers WHERE {_KEPT} AND offer_status = '拒绝offer')
 SELECT city, salary_amount < p50 AS below_median, count(*) AS n, round(avg(rank), 6) AS mean_rank, CAST(sum(b.n) AS BIGINT) AS sum_n
 FROM mine LEFT JOIN bench b ON k = b.group_key LEFT JOIN ranks r ON k = r.group_key AND salary_amount = r.amount GROUP BY 1, 2"""),
)
_ENOUGH = "count(salary_amount) >= 5"
_register(
    "salary_by_unit",
    compensation.salary_by_unit,
    _sql(f"""SELECT salary_unit AS unit, count(*) AS n_records, count(salary_amount) AS n, count(*) - count(salary_amount) AS n_excluded, {_ENOUGH} AS sufficient,
 round(quantile_cont(salary_amount, 0.25), 6) AS p25, round(quantile_cont(salary_amount, 0.5), 6) AS p50, round(quantile_cont(salary_amount, 0.75), 6) AS p75,
 round(avg(salary_amount), 6) AS mean, min(salary_amount) AS min, max(salary_amount) AS max FROM offers GROUP BY 1"""),
)
_register(
    "salary_histogram",
    compensation.histogram,
    _sql("""SELECT unit, bin, floor((lo + bin * w) * 100 + 0.5) / 100 AS low, floor(CASE WHEN bin = 7 THEN hi ELSE lo + (bin + 1) * w END * 100 + 0.5) / 100 AS high, count(v) AS n
 FROM (SELECT salary_unit AS unit, min(salary_amount) AS lo, max(salary_amount) AS hi, (max(salary_amount) - min(salary_amount)) / 8 AS w FROM offers GROUP BY 1) f
 CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS bin) LEFT JOIN (SELECT salary_unit AS u, salary_amount AS v FROM offers WHERE salary_amount IS NOT NULL) x
 ON u IS NOT DISTINCT FROM unit AND least(greatest(floor((v - lo) / w), 0), 7) = bin GROUP BY 1, 2, 3, 4"""),
)
_register(
    "housing_cash_by_period",
    compensation.housing_cash_by_period,
    _sql("""SELECT housing_period AS period, count(housing_amount) AS n, count(*) - count(housing_amount) AS n_excluded, count(housing_amount) >= 5 AS sufficient,
 CASE WHEN count(housing_amount) >= 5 THEN quantile_cont(housing_amount, 0.25) END AS p25, CASE WHEN count(housing_amount) >= 5 THEN quantile_cont(housing_amount, 0.5) END AS p50,
 CASE WHEN count(housing_amount) >= 5 THEN quantile_cont(housing_amount, 0.75) END AS p75 FROM offers WHERE housing_type = '现金房补' GROUP BY 1"""),
)
_register(
    "housing_counters",
    compensation.housing_counters,
    _sql(f"""SELECT {_n("housing_type = '提供住宿'")} AS n_lodging, {_n("housing_type = '无补贴'")} AS n_no_subsidy, {_n("housing_type = '现金房补' AND housing_amount IS NULL")} AS n_cash_amount_missing,
 {_n("housing_type IN ('未知', '其他')")} AS n_unknown_or_other FROM offers"""),
)
_register(
    "total_cash",
    lambda d: d.select("salary_unit", "housing_type", compensation.total_cash().alias("t")).groupBy("salary_unit", "housing_type").agg(F.count("t.total").alias("n"), F.sum("t.total").alias("total"), F.count_if("t.alignable").alias("n_alignable")),
    _sql("""SELECT salary_unit, housing_type, count(t) AS n, round(sum(t), 6) AS total, count(*) FILTER (WHERE a) AS n_alignable FROM (
 SELECT salary_unit, housing_type, CASE WHEN housing_type = '无补贴' THEN salary_amount WHEN fits THEN salary_amount + housing_amount END AS t, housing_type = '无补贴' OR fits AS a
 FROM (SELECT *, coalesce(housing_type = '现金房补' AND housing_amount IS NOT NULL AND salary_amount IS NOT NULL AND housing_period = CASE salary_unit WHEN '元/月' THEN '月' WHEN '元/天' THEN '天' END, FALSE) AS fits FROM offers)) GROUP BY 1, 2"""),
)

# ------------------------------------------------------------------ rejections
_CAT = "CASE WHEN rejection_reason IS NULL THEN '未填写' WHEN k.c IS NOT NULL THEN k.c ELSE '未分类' END"
_WORDS = ", ".join(f"('{a.lower()}', '{b}')" for a, b in REASON_WORDS.items())
_REASONS = f"SELECT {_CAT} AS category FROM offers LEFT JOIN (VALUES {_WORDS}) k(w, c) ON lower(replace(rejection_reason, ' ', '')) = k.w WHERE {_REJ}"
_register(
    "rejection_reasons",
    rejection.reason_distribution,
    _sql(f", reasons AS ({_REASONS}) SELECT position, p.category, count(r.category) AS n, round(count(r.category)::DOUBLE / (SELECT count(*) FROM reasons), 6) AS share FROM (VALUES {_VALUES(REASON_CATEGORIES)}) p(position, category) LEFT JOIN reasons r ON r.category = p.category GROUP BY 1, 2"),
)
_register(
    "rejection_summary",
    rejection.reason_summary,
    _sql(f", reasons AS ({_REASONS}) SELECT count(*) AS n_rejected, {_n("category <> '未填写'")} AS n_filled, {_n("category NOT IN ('未填写', '未分类')")} AS n_matched, {_n("category = '未分类'")} AS n_unclassified, round({_n("category <> '未填写'")}::DOUBLE / count(*), 6) AS fill_rate FROM reasons"),
)


def _flagged(d: DataFrame) -> DataFrame:
    return rejection.with_conditions(benchmarks.decorate(d, d), AS_OF)


_FLAGS = f""", samples AS ({_SAMPLES}), bench AS ({_BENCH}), flagged AS (SELECT o.*, is_gpt AS c0,
 CASE WHEN housing_type = '无补贴' THEN TRUE WHEN housing_type IN ('提供住宿', '现金房补') THEN FALSE END AS c1, salary_amount < p50 AS c2,
 CASE WHEN {_J} AND {_DAYS} >= 0 THEN {_DAYS} > 30 WHEN {_P} OR {_A} THEN date_diff('day', start_date, DATE '{AS_OF}') > 30 END AS c3
 FROM offers o LEFT JOIN bench b ON {_KEY} = b.group_key)"""


def _rule_sql(rule: rejection.Rule) -> str:
    flags = [f"c{list(rejection.CONDITIONS).index(c)}" for c in rule.conditions]
    hit = " AND ".join(f"coalesce({f}, FALSE)" for f in flags)
    unmet = " OR ".join(f"NOT coalesce({f}, TRUE)" for f in flags)
    unknown = " OR ".join(f"{f} IS NULL" for f in flags)
    compared = f"({_REJ} OR {_J})"
    return f"""SELECT '{rule.id}' AS rule_id, {_n(f"({hit}) AND {_REJ}")} AS n_hit_rejected, {_n(f"({hit}) AND {_J}")} AS n_hit_joined, {_n(f"({hit}) AND {_P}")} AS p,
 {_n(f"{compared} AND ({unknown}) AND NOT ({unmet})")} AS n_unknown, {_n(f"{compared} AND ({unmet})")} AS n_unmet, {_n(_REJ)} AS ar, {_n(_CORE)} AS ac FROM flagged"""


_register(
    "rejection_rules",
    lambda d: rejection.evaluate_rules(_flagged(d)),
    _sql(f"""{_FLAGS} SELECT rule_id, n_hit_rejected + n_hit_joined AS n_hit, n_hit_rejected, n_hit_joined, d AS n_core, round(rate, 6) AS rate, round(base, 6) AS baseline_rate, round(gap, 6) AS gap,
 CASE WHEN d < 10 OR n_hit_rejected < 3 THEN 'insufficient' WHEN gap >= 10 THEN 'observed' ELSE 'description' END AS level, n_unknown, n_unmet
 FROM (SELECT *, floor((rate - base) * 10000 + 0.5) / 100 AS gap FROM (SELECT *, n_hit_rejected + n_hit_joined + p AS d, n_hit_rejected::DOUBLE / nullif(n_hit_rejected + n_hit_joined + p, 0) AS rate, ar::DOUBLE / ac AS base
 FROM ({" UNION ALL ".join(map(_rule_sql, rejection.DEFAULT_RULES))})))"""),
)
_register(
    "condition_buckets",
    lambda d: rejection.condition_buckets(_flagged(d)),
    _sql(_FLAGS + " " + " UNION ALL ".join(f"SELECT '{c}' AS condition, CASE WHEN bool_or(coalesce(c{i}, FALSE)) THEN 'met' WHEN bool_or(c{i} IS NULL) THEN 'unknown' ELSE 'unmet' END AS bucket FROM flagged WHERE {_REJ} OR {_J}" for i, c in enumerate(rejection.CONDITIONS))),
)
_register(
    "rejection_features",
    lambda d: rejection.feature_rates(_flagged(d)),
    _sql(f"""{_FLAGS} SELECT CASE WHEN {_J} THEN 'joined' ELSE 'rejected' END AS comparison_group, count(*) AS n, {", ".join(f"floor(avg(CAST(c{i} AS INT)) * 10000 + 0.5) / 100 AS {c}_percent" for i, c in enumerate(rejection.CONDITIONS))}
 FROM flagged WHERE {_REJ} OR {_J} GROUP BY 1"""),
)
_register(
    "waiting",
    lambda d: d.select("offer_status", waiting(F.col("offer_status"), F.col("start_date"), F.col("join_date"), F.lit(AS_OF).cast("date")).alias("w")).groupBy("offer_status", "w.kind").agg(F.count("*").alias("n"), F.sum("w.days").alias("days")),
    _sql(f"""SELECT offer_status, CASE WHEN a IS NOT NULL THEN 'actualCycle' WHEN c IS NOT NULL THEN 'currentWaiting' ELSE 'unknown' END AS kind, count(*) AS n, CAST(sum(coalesce(a, c)) AS BIGINT) AS days
 FROM (SELECT offer_status, {_ACTUAL} AS a, CASE WHEN ({_P} OR {_A}) AND start_date <= DATE '{AS_OF}' THEN date_diff('day', start_date, DATE '{AS_OF}') END AS c FROM offers) GROUP BY 1, 2"""),
)
_register(
    "long_waits",
    lambda d: rejection.long_waits(d, AS_OF, 1000),
    _sql(f"SELECT {_n(f"({_P} OR {_A}) AND start_date <= DATE '{AS_OF}' AND date_diff('day', start_date, DATE '{AS_OF}') > 1000")} AS n_waiting_too_long FROM offers"),
)

# ------------------------------------------------------------------ quality
_register(
    "quality_counters",
    quality.counters,
    _sql(f"""SELECT {_n("start_date IS NULL")} AS n_start_missing, {_n("salary_amount IS NULL")} AS n_salary_missing, {_n(f"{_DAYS} < 0")} AS n_negative_cycle,
 {_n(f"({_ACTUAL}) > 180")} AS n_cycle_too_long, {_n("offer_status = '未知'")} AS n_status_unknown, {_n("requirement_id IS NULL")} AS n_requirement_missing FROM offers"""),
)
_ISSUES = (
    ("NEGATIVE_CYCLE", "datediff(join_date, start_date) < 0 AND offer_status = '已入职'", f"{_J} AND {_DAYS} < 0"),
    ("PLANNED_DATE_UNCERTAIN", "offer_status = '待入职' AND join_date IS NOT NULL", f"{_P} AND join_date IS NOT NULL"),
    ("UNKNOWN_ENUM_VALUE", "offer_status = '未知'", "offer_status = '未知'"),
)


def _issues(d: DataFrame) -> DataFrame:
    each = F.array(*[F.when(F.expr(spark_sql), F.struct(F.lit(code).alias("code"), F.lit("入职时间").alias("field"))) for code, spark_sql, _ in _ISSUES])
    return d.select("source_row", F.explode(F.array_compact(each)).alias("i")).select("source_row", "i.*")


_ISSUES_SQL = " UNION ALL ".join(f"SELECT source_row, '{code}' AS code FROM offers WHERE {sql}" for code, _, sql in _ISSUES)
_register("issues_by_code", lambda d: quality.by_code(_issues(d)), _sql(f"SELECT code, count(*) AS n FROM ({_ISSUES_SQL}) GROUP BY 1"))
_register(
    "issues_by_severity",
    lambda d: quality.by_severity(_issues(d)),
    _sql(f"SELECT severity, count(code) AS n FROM (VALUES ('阻断'), ('字段错误'), ('警告')) s(severity) LEFT JOIN ({_ISSUES_SQL}) i ON severity = CASE code WHEN 'NEGATIVE_CYCLE' THEN '字段错误' ELSE '警告' END GROUP BY 1"),
)
_register("disabled_modules", lambda d: quality.disabled_modules(_issues(d)), _sql(f"SELECT unnest(['房补对比', '渠道对比']) AS module WHERE EXISTS (SELECT 1 FROM ({_ISSUES_SQL}) WHERE code = 'UNKNOWN_ENUM_VALUE')"))
_register(
    "issue_worklist",
    lambda d: quality.worklist(d.select("source_row", F.col("record_id").cast("string").alias("record_id")), _issues(d)).groupBy("severity", F.array_join("codes", ",").alias("codes")).agg(F.count("*").alias("n")),
    _sql(f"""SELECT severity, codes, count(*) AS n FROM offers JOIN (SELECT source_row, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, CASE WHEN bool_or(code = 'NEGATIVE_CYCLE') THEN '字段错误' ELSE '警告' END AS severity FROM ({_ISSUES_SQL}) GROUP BY 1) USING (source_row) GROUP BY 1, 2"""),
)
_register(
    "module_samples",
    quality.module_samples,
    _sql(" UNION ALL ".join(f"SELECT '{m}' AS module, {_n(c)} AS n FROM offers" for m, c in (
        ("核心率", _CORE), ("审批中占比", "TRUE"), ("招聘周期", f"({_ACTUAL}) IS NOT NULL"), ("薪资对比", "salary_amount IS NOT NULL"), ("房补对比", "housing_type <> '未知'"),
        ("拒offer原因", f"{_REJ} AND rejection_reason IS NOT NULL"), ("城市对比", "city <> '未知'"), ("渠道对比", "channel <> '未知'"), ("HR效能", "recruiter IS NOT NULL"),
        ("画像分析", "position IS NOT NULL"), ("需求分析", "requirement_id IS NOT NULL"),
    ))),
)

# ------------------------------------------------------------------ scalar functions
_register(
    "salary_bands",
    lambda d: d.groupBy(numbers.salary_band_of(F.col("salary_amount"), EDGES).alias("band")).agg(F.count("*").alias("n")),
    _sql("SELECT CASE WHEN salary_amount >= 980 THEN '>=980' WHEN salary_amount >= 960 THEN '960-980' WHEN salary_amount >= 940 THEN '940-960' WHEN salary_amount >= 920 THEN '920-940' WHEN salary_amount IS NOT NULL THEN '<920' END AS band, count(*) AS n FROM offers GROUP BY 1"),
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _date_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in several spellings, parsed back."""
    o = _cells(spark, sf_dir)
    day = F.to_date("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy/M/d")).when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "yyyy年M月d日"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "d-M-yyyy")).when(F.col("o_orderkey") % 5 == 3, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
        .otherwise(F.lit("n/a"))
    )
    found = o.select(text.alias("cell")).select(parse_date_cell(F.col("cell")).alias("p"))
    return _rounded(found.groupBy("p.rule", "p.date", "p.confirm", "p.code").agg(F.count("*").alias("n")))


QUERIES["date_cells"] = _date_cells
ORACLE_SQL["date_cells"] = """
WITH o AS (SELECT o_orderkey % 5 AS m, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT rule, CASE WHEN known THEN CAST(d AS VARCHAR) END AS date, confirm, code, count(*) AS n FROM (
 SELECT d, m <> 4 AND NOT (m = 2 AND day(d) <= 12) AS known,
  CASE WHEN m <= 1 THEN 'date.ymd' WHEN m = 2 AND day(d) <= 12 THEN 'date.ambiguousUnconfirmed' WHEN m = 2 THEN 'date.yearLast' WHEN m = 3 THEN 'date.serialTextExcel1900.assumed1900' ELSE 'date.missing' END AS rule,
  m = 3 OR (m = 2 AND day(d) <= 12) AS confirm, CASE WHEN m = 2 AND day(d) <= 12 THEN 'DATE_NOT_CONVERTED' END AS code FROM o) GROUP BY 1, 2, 3, 4
"""
QUERIES["month_ranges"] = lambda spark, sf_dir: _rounded(_cells(spark, sf_dir).select(F.date_format("o_orderdate", "yyyy-MM").alias("period")).distinct().select("period", month_range(F.col("period")).alias("r")).select("period", F.col("r.from").alias("first"), F.col("r.to").alias("last")))
ORACLE_SQL["month_ranges"] = "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS first, CAST(last_day(o_orderdate) AS VARCHAR) AS last FROM orders"
QUERIES["cell_texts"] = lambda spark, sf_dir: _cells(spark, sf_dir).select(cell_text(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" \t　 x "))).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
ORACLE_SQL["cell_texts"] = "SELECT concat(o_orderpriority, ' x') AS text, count(*) AS n FROM orders GROUP BY 1"
QUERIES["identifiers"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(looks_like_identifier(F.col("p_name")).alias("identifier")).agg(F.count("*").alias("n"))
ORACLE_SQL["identifiers"] = "SELECT regexp_matches(p_name, '^[A-Za-z0-9]') AND (regexp_matches(p_name, '[-_]') OR length(p_name) >= 12) AS identifier, count(*) AS n FROM part GROUP BY 1"
QUERIES["safe_cells"] = lambda spark, sf_dir: _cells(spark, sf_dir).select(safe_cell(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("="), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
ORACLE_SQL["safe_cells"] = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('''=', o_orderpriority) ELSE o_orderpriority END AS cell, count(*) AS n FROM orders GROUP BY 1"
QUERIES["amounts"] = lambda spark, sf_dir: _rounded(_cells(spark, sf_dir).select("o_orderkey", numbers.extract_amount(F.concat(F.lit("约 "), F.format_number("o_totalprice", 2), F.lit(" 元/月"))).alias("amount")))
ORACLE_SQL["amounts"] = "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders"
QUERIES["expected_days"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(_cells(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).select(expected_internship_days(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("days")).groupBy("days").agg(F.count("*").alias("n"))
ORACLE_SQL["expected_days"] = "SELECT CASE WHEN d >= 0 THEN d END AS days, count(*) AS n FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1"


# ------------------------------------------------------------------ duplicates
def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows: a user's events of one type and day are suspected, texts of documents are exact duplicates."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    suspected = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string"))
    return e.select(F.col("event_id").cast("string").alias("record_id"), F.col("event_id").cast("int").alias("source_row"), F.when(F.col("event_id") % 50 == 0, F.lit("same")).alias("exact_key"), suspected.alias("suspected_key"))


QUERIES["duplicates"] = lambda spark, sf_dir: duplicates.decide(duplicates.mark(_event_rows(spark, sf_dir)), confirmed=True).groupBy("dup_kind", "dup_group", "dup_n", "dedup_action").agg(F.count("*").alias("n"))
ORACLE_SQL["duplicates"] = """
WITH r AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'same' END AS ek, concat_ws('|', user_id, event_type, CAST(ts AS DATE)) AS sk FROM events),
x AS (SELECT *, CASE WHEN ek IS NOT NULL AND count(*) OVER (PARTITION BY ek) > 1 THEN 'exact' END AS kx FROM r),
s AS (SELECT *, CASE WHEN kx IS NULL THEN count(*) OVER (PARTITION BY kx, sk) END AS ns FROM x),
k AS (SELECT event_id, CASE WHEN kx IS NOT NULL THEN 'exact' WHEN ns > 1 THEN 'suspected' ELSE 'none' END AS dup_kind, CASE WHEN kx IS NOT NULL THEN ek WHEN ns > 1 THEN sk END AS g FROM s),
f AS (SELECT dup_kind, g, count(*) AS dup_n, min(event_id) AS first FROM k WHERE g IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, concat(dup_kind, '#', first) AS dup_group FROM f)
SELECT k.dup_kind, o.dup_group, o.dup_n, CASE WHEN k.g IS NULL OR k.event_id = o.first THEN 'kept' ELSE 'removedAsDuplicate' END AS dedup_action, count(*) AS n
FROM k LEFT JOIN o ON k.dup_kind = o.dup_kind AND k.g = o.g GROUP BY 1, 2, 3, 4
"""
QUERIES["exact_documents"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
ORACLE_SQL["exact_documents"] = "SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"
QUERIES["display_ids"] = lambda spark, sf_dir: _cells(spark, sf_dir).select("o_orderkey", display_id(F.col("o_orderkey").cast("string")).alias("display_id"))
ORACLE_SQL["display_ids"] = """SELECT o_orderkey, format('C-{:06X}', list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: (a * 31 + x) % 16777216)) AS display_id FROM orders"""

# ------------------------------------------------------------------ disclosure control
_register(
    "suppressed_schools",
    lambda d: privacy.dimension_table(d, "school", privacy.Rules(suppress_below=2400)).drop("code", "cycle_p25_band", "cycle_median_band", "cycle_p75_band", "cycle_mean"),
    _sql(f""", base AS (SELECT *, coalesce(school, '未知') AS k FROM offers), sizes AS (SELECT k, count(*) AS n, sum(CAST(count(*) < 2400 AS INT)) OVER () AS merged, count(*) OVER () AS groups FROM base GROUP BY 1),
 named AS (SELECT b.*, n < 2400 AS is_merged, merged, groups, CASE WHEN n < 2400 THEN concat('其他（', merged, ' 个分组合并）') ELSE k END AS key FROM base b JOIN sizes USING (k)),
 g AS (SELECT key, is_merged, merged, groups, {BUNDLE_SQL} FROM named GROUP BY 1, 2, 3, 4),
 h AS (SELECT *, groups <= 1 OR (count(*) OVER () > greatest(2 - merged, 0) AND row_number() OVER (ORDER BY n_total, n_core, key) <= greatest(2 - merged, 0)) AS suppressed, row_number() OVER (ORDER BY is_merged, n_core DESC, n_total DESC, key) AS position FROM g)
 SELECT position, CASE WHEN suppressed THEN concat(key, '（已抑制）') ELSE key END AS label, {", ".join(f"CASE WHEN suppressed THEN 0 ELSE {c} END AS {c}" for c in ("n_total", "n_joined", "n_pending", "n_approving", "n_rejected", "n_core"))},
 CASE WHEN NOT suppressed AND n_core >= 2400 THEN floor(n_rejected::DOUBLE / n_core * 100 + 0.5) / 100 END AS rejection_rate, suppressed OR n_core < 2400 AS rate_suppressed,
 CASE WHEN NOT suppressed THEN actual_n END AS cycle_n, suppressed, is_merged FROM h"""),
)
_register(
    "complementary_suppression",
    lambda d: privacy.complementary(d.groupBy(F.col("department").alias("key")).agg(*metrics.status_counts()).select("key", "n_total", "n_core", (F.col("key") == "BUILDING").alias("suppressed"))),
    _sql(f"""SELECT key, n_total, n_core, s OR (NOT s AND rank <= 1) AS suppressed FROM (SELECT *, row_number() OVER (ORDER BY s, n_total, n_core, key) AS rank FROM (SELECT department AS key, count(*) AS n_total, {_n(_CORE)} AS n_core, department = 'BUILDING' AS s FROM offers GROUP BY 1))"""),
)
_CELLS = {
    "city": "city", "channel": "channel", "referral_type": "referral_type", "requirement_type": "requirement_type", "education": "education",
    "graduation_year": _LABELS["graduation_year"], "housing_type": "housing_type", "school_level": "CASE WHEN is_gpt THEN 'GPT 院校' WHEN NOT is_gpt THEN '非 GPT 院校' ELSE '未标注' END",
    "position_category": "CASE WHEN lower(replace(position, ' ', '')) = 'brand#11' THEN '甲类' ELSE '有岗位记录' END", "salary_band": _LABELS["salary_band"], "cycle_band": f"concat({_BAND}, '-', {_BAND} + 9, '天')",
}
_CELLS_SQL = (
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS key, count(*) AS N, {_n(_J)} AS J, {_n(_P)} AS P, {_n(_A)} AS A, {_n(_REJ)} AS R, {_n(_CORE)} AS D FROM offers {f'WHERE ({_ACTUAL}) IS NOT NULL' if k == 'cycle_band' else ''} GROUP BY 2" for k, v in _CELLS.items())
    + ") WHERE D >= 5 AND key IS NOT NULL"
)
_register(
    "summary_cells",
    lambda d: privacy.summary_cells(d, categories={"brand#11": "甲类"}, edges=EDGES),
    _sql(_CELLS_SQL),
)
_register(
    "collapsed_cells",
    lambda d: privacy.collapse(privacy.summary_cells(d, categories={"brand#11": "甲类"}, edges=EDGES), 3),
    _sql(f"""SELECT dimension, CASE WHEN rank <= 3 THEN key ELSE '其他' END AS key, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in "NJPARD")}
 FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY D DESC, N DESC, key) AS rank FROM ({_CELLS_SQL})) GROUP BY 1, 2"""),
)
_SENTINELS_SQL = """SELECT DISTINCT 'recruiter' AS field, recruiter AS value FROM offers WHERE length(recruiter) > 1 UNION SELECT DISTINCT 'school', school FROM offers WHERE length(school) > 1
 UNION SELECT DISTINCT 'requirement_id', requirement_id FROM offers WHERE length(requirement_id) > 1"""
_register("sentinels", privacy.collect_sentinels, _sql(_SENTINELS_SQL))
_register(
    "first_sentinels",
    lambda d: privacy.first_sentinels(privacy.collect_sentinels(d), 50),
    _sql(f"SELECT field, value, n_values FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) AS rank, count(*) OVER (PARTITION BY field) AS n_values FROM ({_SENTINELS_SQL})) WHERE rank <= 50"),
)


def _sentinel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned for the opening of every document: 24 letters, without case and white space around."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan.sentinel_counts(docs.select("doc_id", "text"), docs.select(F.substring("text", 1, 24).alias("value"))).drop("text")


QUERIES["sentinel_scan"] = _sentinel_scan
ORACLE_SQL["sentinel_scan"] = """WITH s AS (SELECT DISTINCT lower(trim(substr(text, 1, 24), ' ')) AS s FROM documents)
 SELECT d.doc_id, count(s) AS n_sentinels FROM documents d LEFT JOIN s ON s <> '' AND contains(lower(text), s) GROUP BY d.doc_id"""


def _sentinel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("The And",), ("zzzz",), ("nichT",)], "value string")
    return scan.rows_with_sentinels(spark.read.parquet(f"{sf_dir}/documents.parquet"), words).select("doc_id")


QUERIES["sentinel_rows"] = _sentinel_rows
ORACLE_SQL["sentinel_rows"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'the and') OR contains(lower(text), 'zzzz') OR contains(lower(text), 'nicht')"
_register(
    "chart_series",
    lambda d: report.chart_series(privacy.dimension_table(d, "channel"), "渠道"),
    _sql(f""", g AS (SELECT channel AS key, count(*) AS n, {_n(_CORE)} AS d, count(*) OVER () AS groups, row_number() OVER (ORDER BY count(*), {_n(_CORE)}, channel) AS rank FROM offers GROUP BY 1)
 SELECT '渠道' AS chart, key AS category, s AS series, CASE s WHEN 'N' THEN n ELSE d END AS value FROM g CROSS JOIN (VALUES ('N'), ('D')) t(s) WHERE rank > 2
 UNION ALL SELECT '渠道', '合计', s, CAST(CASE s WHEN 'N' THEN (SELECT sum(n) FROM g WHERE rank > 2) ELSE (SELECT sum(d) FROM g WHERE rank > 2) END AS BIGINT) FROM (VALUES ('N'), ('D')) t(s)"""),
)


# ------------------------------------------------------------------ cleaning, end to end
_HEADERS = ("需求ID", "城市", "offer状态", "启动招聘时间", "入职时间", "薪资", "房补", "渠道", "姓名")


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the rows of a messy list."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    pick = lambda n, *words: F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), (k % n + 1).cast("int"))
    cells = F.array(
        F.concat(F.lit("00"), k.cast("string")), pick(6, " 上海　", "广州网易大厦", "杭州（滨江）", "北京", "-", None), pick(7, "已入职", "待入职", "已送审批", "拒绝 offer", "审批通过", "", None),
        F.date_format(day, "yyyy/M/d"), F.date_format(F.date_add(day, (k % 50 - 10).cast("int")), "yyyy年M月d日"), pick(5, "4,000", "3000-4000", "-5", "面议", None),
        pick(4, "５００元/月", "无（外地）", "住宿", "待定"), pick(3, "BOSS", "官网 ", "x"), F.concat(F.lit("N"), (F.col("o_custkey") % 97).cast("string")),
    )
    numbers = F.array_repeat(F.lit(None).cast("double"), len(_HEADERS))
    return _cells(spark, sf_dir).select(k.cast("int").alias("source_row"), cells.alias("cells"), numbers.alias("numbers"), F.lit(False).alias("empty"), (k % 11 == 0).alias("hidden"), F.array().cast("array<string>").alias("notes"))


def _cleaned(spark: SparkSession, sf_dir: str) -> cleaning.Cleaned:
    plan, _ = mapping.decide(mapping.suggest(_HEADERS), mapping.Decisions(), "2026-01-01")
    return cleaning.clean(_raw_rows(spark, sf_dir), plan, cleaning.Settings(AS_OF, include_hidden=False))


def _clean_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("city", "offer_status", "channel", "housing_type", "currency")
    return _rounded(_cleaned(spark, sf_dir).records.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("salary_amount").alias("salary"), F.sum("housing_amount").alias("housing"), F.sum("d_cycle_days").alias("days"), F.count_if("d_planned_eligible").alias("planned"), F.min("requirement_id").alias("first")))


_CLEAN_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 50 - 10 AS gap FROM orders WHERE o_orderkey % 11 <> 0), r AS (SELECT *,
  CASE k % 6 WHEN 0 THEN '上海' WHEN 1 THEN '广州' WHEN 2 THEN '杭州' WHEN 3 THEN '其他' ELSE '未知' END AS city,
  CASE k % 7 WHEN 0 THEN '已入职' WHEN 1 THEN '待入职' WHEN 2 THEN 'offer审批中' WHEN 3 THEN '拒绝offer' ELSE '未知' END AS offer_status,
  CASE k % 3 WHEN 0 THEN 'Boss' WHEN 1 THEN '官网' ELSE '其他' END AS channel,
  CASE k % 4 WHEN 0 THEN '现金房补' WHEN 1 THEN '无补贴' WHEN 2 THEN '提供住宿' ELSE '未知' END AS housing_type,
  CASE k % 4 WHEN 0 THEN 500.0 WHEN 1 THEN 0.0 END AS housing_amount, CASE k % 5 WHEN 0 THEN 4000.0 END AS salary_amount FROM o) """
QUERIES["cleaned_offers"] = _clean_groups
ORACLE_SQL["cleaned_offers"] = (
    _CLEAN_SQL
    + """SELECT city, offer_status, channel, housing_type, CASE WHEN salary_amount IS NOT NULL THEN 'CNY' END AS currency, count(*) AS n, sum(salary_amount) AS salary, sum(housing_amount) AS housing,
 CAST(sum(CASE WHEN offer_status = '已入职' AND gap >= 0 THEN gap END) AS BIGINT) AS days, count(*) FILTER (WHERE offer_status = '待入职') AS planned, min(concat('00', k)) AS first FROM r GROUP BY 1, 2, 3, 4, 5"""
)
QUERIES["cleaning_issues"] = lambda spark, sf_dir: _cleaned(spark, sf_dir).issues.groupBy("code", "field").agg(F.count("*").alias("n"))
ORACLE_SQL["cleaning_issues"] = _CLEAN_SQL + """SELECT code, field, count(*) AS n FROM (
 SELECT 'UNKNOWN_ENUM_VALUE' AS code, '城市' AS field FROM r WHERE k % 6 = 3 UNION ALL SELECT 'UNKNOWN_ENUM_VALUE', 'offer状态' FROM r WHERE k % 7 = 4 UNION ALL SELECT 'MISSING_REQUIRED_VALUE', 'offer状态' FROM r WHERE k % 7 = 6
 UNION ALL SELECT 'UNKNOWN_ENUM_VALUE', '渠道' FROM r WHERE k % 3 = 2 UNION ALL SELECT 'UNKNOWN_ENUM_VALUE', '房补' FROM r WHERE k % 4 = 3 UNION ALL SELECT 'VALUE_RANGE_UNCERTAIN', '薪资' FROM r WHERE k % 5 = 1
 UNION ALL SELECT 'INVALID_SALARY', '薪资' FROM r WHERE k % 5 IN (2, 3) UNION ALL SELECT 'NEGATIVE_CYCLE', '入职时间' FROM r WHERE k % 7 = 0 AND gap < 0 UNION ALL SELECT 'PLANNED_DATE_UNCERTAIN', '入职时间' FROM r WHERE k % 7 = 1) GROUP BY 1, 2"""
QUERIES["cleaning_counts"] = lambda spark, sf_dir: _cleaned(spark, sf_dir).counts
ORACLE_SQL["cleaning_counts"] = _CLEAN_SQL + """SELECT (SELECT count(*) FROM orders) AS n_raw, 0 AS n_empty, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0) AS n_hidden, count(*) AS n_built, 0 AS n_removed, 0 AS n_header_echo,
 count(*) AS n_kept, count(DISTINCT k) AS n_requirements, count(*) FILTER (WHERE k % 6 = 3 OR k % 7 IN (1, 4, 6) OR k % 3 = 2 OR k % 4 = 3 OR k % 5 IN (1, 2, 3) OR (k % 7 = 0 AND gap < 0)) AS n_issue_rows FROM r"""
QUERIES["lineage_rules"] = lambda spark, sf_dir: _cleaned(spark, sf_dir).lineage.groupBy("field", "rule", "confirm").agg(F.count("*").alias("n"))
ORACLE_SQL["lineage_rules"] = _CLEAN_SQL + """SELECT field, rule, confirm, count(*) AS n FROM (
 SELECT 'city' AS field, CASE k % 6 WHEN 0 THEN 'city.上海' WHEN 1 THEN 'city.广州网易大厦' WHEN 2 THEN 'city.prefix' WHEN 3 THEN 'city.unrecognized' ELSE 'city.missing' END AS rule, k % 6 IN (1, 2, 3) AS confirm FROM r
 UNION ALL SELECT 'salaryAmount', CASE k % 5 WHEN 0 THEN 'salary.number' WHEN 1 THEN 'salary.rangeUnconfirmed' WHEN 2 THEN 'salary.negativeOrUnparsed' WHEN 3 THEN 'salary.unparsed' ELSE 'salary.missing' END, k % 5 IN (1, 2, 3) FROM r
 UNION ALL SELECT 'channel', CASE k % 3 WHEN 0 THEN 'channel.boss' WHEN 1 THEN 'channel.官网' ELSE 'channel.unrecognized' END, k % 3 = 2 FROM r
 UNION ALL SELECT 'offerStatus', CASE k % 7 WHEN 0 THEN 'status.已入职' WHEN 1 THEN 'status.待入职' WHEN 2 THEN 'status.已送审批' WHEN 3 THEN 'status.拒绝 offer' WHEN 4 THEN 'status.unrecognized' ELSE 'status.missing' END, k % 7 = 4 FROM r
 UNION ALL SELECT 'housingRaw', CASE k % 4 WHEN 0 THEN 'housing.cash' WHEN 1 THEN 'housing.noSubsidy' WHEN 2 THEN 'housing.accommodation' ELSE 'housing.unrecognized' END, k % 4 = 3 FROM r
 UNION ALL SELECT f, rule, FALSE FROM r CROSS JOIN (VALUES ('joiningDate', 'date.ymd'), ('recruitmentStartDate', 'date.ymd'), ('requirementId', 'text.trimmed'), ('candidateName', 'text.trimmed'), ('department', 'text.missing'),
  ('position', 'text.missing'), ('jobFamily', 'text.missing'), ('recruiter', 'text.missing'), ('referrer', 'text.missing'), ('referrer', 'referral.missing'), ('education', 'education.missing'), ('expectedEndDate', 'date.missing'),
  ('graduationYear', 'year.missing'), ('isGptSchool', 'tristate.missing'), ('requirementType', 'requirementType.missing'), ('school', 'school.missing')) t(f, rule)) GROUP BY 1, 2, 3"""
QUERIES["column_profile"] = lambda spark, sf_dir: mapping.column_profile(_raw_rows(spark, sf_dir), _HEADERS).select("index", "header", "n_filled", F.array_join("samples", "/").alias("samples"), "all_empty")
_CELL_SQL = {
    "需求ID": "concat('00', o_orderkey)", "城市": "CASE o_orderkey % 6 WHEN 0 THEN '上海　' WHEN 1 THEN '广州网易大厦' WHEN 2 THEN '杭州（滨江）' WHEN 3 THEN '北京' WHEN 4 THEN '-' END",
    "offer状态": "CASE o_orderkey % 7 WHEN 0 THEN '已入职' WHEN 1 THEN '待入职' WHEN 2 THEN '已送审批' WHEN 3 THEN '拒绝 offer' WHEN 4 THEN '审批通过' END",
    "启动招聘时间": "strftime(CAST(o_orderdate AS DATE), '%Y/%-m/%-d')", "入职时间": "strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 - 10 AS INT), '%Y年%-m月%-d日')",
    "薪资": "CASE o_orderkey % 5 WHEN 0 THEN '4,000' WHEN 1 THEN '3000-4000' WHEN 2 THEN '-5' WHEN 3 THEN '面议' END", "房补": "CASE o_orderkey % 4 WHEN 0 THEN '５００元/月' WHEN 1 THEN '无（外地）' WHEN 2 THEN '住宿' ELSE '待定' END",
    "渠道": "CASE o_orderkey % 3 WHEN 0 THEN 'BOSS' WHEN 1 THEN '官网' ELSE 'x' END", "姓名": "concat('N', o_custkey % 97)",
}
ORACLE_SQL["column_profile"] = f"""WITH c AS ({" UNION ALL ".join(f"SELECT o_orderkey AS k, {i} AS index, '{h}' AS header, {v} AS v FROM orders" for i, (h, v) in enumerate(_CELL_SQL.items()))}),
 f AS (SELECT index, header, v, count(*) AS n, min(k) AS first FROM c WHERE v IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY first) AS rank FROM f)
 SELECT index, header, CAST(sum(n) AS BIGINT) AS n_filled, string_agg(v, '/' ORDER BY rank) FILTER (WHERE rank <= 3) AS samples, FALSE AS all_empty FROM g GROUP BY 1, 2"""


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same list twice: every record stands in both batches under its own id."""
    records = _cleaned(spark, sf_dir).records
    return cleaning.append(records, records).groupBy("batch_no", "dup_kind", "dedup_action").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_ids"))


QUERIES["appended_batches"] = _appended
ORACLE_SQL["appended_batches"] = "SELECT b AS batch_no, 'exact' AS dup_kind, 'pendingUserConfirmation' AS dedup_action, count(*) AS n, count(*) AS n_ids FROM orders CROSS JOIN (VALUES (0), (1)) t(b) WHERE o_orderkey % 11 <> 0 GROUP BY 1"


def _two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files whose rows have the same numbers."""
    plan, _ = mapping.decide(mapping.suggest(_HEADERS), mapping.Decisions(), "2026-01-01")
    rows = _raw_rows(spark, sf_dir)
    both = rows.withColumn("file", F.lit("a")).unionByName(rows.where(F.col("source_row") % 2 == 0).withColumn("file", F.lit("b")))
    return cleaning.clean(both, plan, cleaning.Settings(AS_OF, dedup_confirmed=True)).records.groupBy("file", "dedup_action").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_ids"))


#: Of a row that both files hold one is kept: that of the least number, then of the least id, so only the sum over files is told.
QUERIES["cleaned_two_files"] = lambda spark, sf_dir: _two_files(spark, sf_dir).groupBy("dedup_action").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"))
ORACLE_SQL["cleaned_two_files"] = "SELECT 'kept' AS dedup_action, count(*) AS n, count(*) AS n_ids FROM orders"

# ------------------------------------------------------------------ remaining tables
_register(
    "ranking_availability",
    lambda d: grouping.ranking_availability(d.groupBy(F.coalesce("recruiter", F.lit("未知")).alias("key")).agg(*metrics.status_counts())),
    _sql(f"SELECT count(*) AS n_known, {_n('n >= 10')} AS n_rankable, {_n('n >= 10')} >= 2 AS can_rank FROM (SELECT recruiter, {_n(_CORE)} AS n FROM offers WHERE recruiter IS NOT NULL GROUP BY 1)"),
)
_register(
    "unclassified_reasons",
    lambda d: rejection.reason_samples_by_rank(d),
    _sql(f"SELECT rejection_reason AS reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rejection_reason) AS rank FROM offers WHERE rejection_reason IS NOT NULL AND {_REJ} GROUP BY 1"),
)
_NOTES = " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in quality.SAMPLE_NOTES.items())
_register(
    "module_availability",
    lambda d: quality.availability(d, _issues(d), "人民币元/月"),
    _sql(f"""SELECT module, n, module NOT IN ('房补对比', '渠道对比') AND n > 0 AS available,
 CASE WHEN module = '房补对比' THEN '计薪口径待确认（人民币元/月），模块停用' WHEN module = '渠道对比' THEN '数据问题使该模块停用' WHEN n = 0 THEN '没有有效样本' ELSE CASE module {_NOTES} END END AS reason
 FROM ({ORACLE_SQL["module_samples"].replace(f"WITH offers AS ({OFFERS_SQL}) ", "")})"""),
)
_register(
    "page_of_groups",
    lambda d: grouping.page(d.groupBy(F.col("position").alias("key")).agg(*metrics.status_counts()), grouping.by_core(), 2, 10).select("key", "n_core"),
    _sql(f"SELECT key, n_core FROM (SELECT position AS key, {_n(_CORE)} AS n_core, count(*) AS n FROM offers GROUP BY 1) ORDER BY n_core DESC, n DESC, key LIMIT 10 OFFSET 10"),
)
_register(
    "chart_order",
    lambda d: grouping.for_chart(metrics.with_rates(d.groupBy(F.col("channel").alias("key")).agg(*metrics.status_counts())), "rejection_rate").select("key", "position"),
    _sql(f"SELECT key, row_number() OVER (ORDER BY r::DOUBLE / nullif(d, 0) DESC NULLS LAST, d DESC, n DESC, key) AS position FROM (SELECT channel AS key, {_n(_REJ)} AS r, {_n(_CORE)} AS d, count(*) AS n FROM offers GROUP BY 1)"),
)
_register(
    "timeline_covers_all",
    lambda d: grouping.covers_all(grouping.aggregate_by_month(d, "join_date"), d),
    _sql("SELECT count(*) AS n_grouped, count(*) AS n_records, TRUE AS covers_all FROM offers"),
)
_register("unsplit_requirement_types", grouping.n_unsplit, _sql(f"SELECT {_n("requirement_type = '替补替换未拆分'")} AS n_unsplit FROM offers"))
_register(
    "efficiency",
    lambda d: grouping.with_cycles(grouping.aggregate_by(d, F.concat("city", "offer_status"))),
    _sql(f"SELECT *, {RATES_SQL} FROM (SELECT concat(city, offer_status) AS key, {BUNDLE_SQL} FROM offers GROUP BY 1) WHERE actual_n > 0 OR planned_n > 0"),
)
_register(
    "histogram_notes",
    compensation.histogram_notes,
    _sql("""SELECT unit, CASE WHEN n < 5 THEN 'tooFew' WHEN k <= 12 THEN 'singleValues' ELSE 'equalWidths' END AS binning, k AS n_values, CASE WHEN n < 5 THEN 0 WHEN k <= 12 THEN k ELSE 8 END AS n_bins
 FROM (SELECT salary_unit AS unit, count(salary_amount) AS n, count(DISTINCT salary_amount) AS k FROM offers GROUP BY 1)"""),
)
_CYCLE_BAND = lambda d: f"CASE WHEN {d} >= 180 THEN '>=180' WHEN {d} >= 90 THEN '90-180' WHEN {d} >= 60 THEN '60-90' WHEN {d} >= 30 THEN '30-60' WHEN {d} >= 14 THEN '14-30' WHEN {d} >= 7 THEN '7-14' WHEN {d} IS NOT NULL THEN '<7' END"
_register(
    "quantile_bands",
    lambda d: privacy.dimension_table(d, "position").where("not suppressed").select("label", "cycle_n", "cycle_mean", "cycle_p25_band", "cycle_median_band", "cycle_p75_band"),
    _sql(f""", g AS (SELECT position AS key, {BUNDLE_SQL} FROM offers GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY n_total, n_core, key) AS rank FROM g)
 SELECT key AS label, actual_n AS cycle_n, actual_mean AS cycle_mean, {", ".join(f"{_CYCLE_BAND(f'actual_{q}')} AS cycle_{q}_band" for q in ("p25", "median", "p75"))} FROM h WHERE rank > 2"""),
)

# ------------------------------------------------------------------ resolvers, inference and corrections through cleaning
_PEOPLE = ("需求ID", "offer状态", "学历", "学校", "是否GPT院校", "简历推荐人", "需求类型", "毕业年级", "渠道", "城市")
_WORDS_OF = {
    "学历": ("大专", "本科", "研究生", "博士 ", "MBA"), "学校": ("甲大", "甲大学", " 乙大学 ", None), "是否GPT院校": ("是", "no", "Y", "maybe", "-", None),
    "简历推荐人": ("内推", "HR推", "校推", "张三", "-", None, "HR推"), "需求类型": ("新增", "替补", "紧急"), "毕业年级": ("2027", "2026届", "27", "1850年", None), "渠道": ("官网", None, "Boss", "-"),
}


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows whose cells go through the remaining resolvers."""
    k = F.col("o_orderkey")
    pick = lambda words: F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), (k % len(words) + 1).cast("int"))
    cells = F.array(k.cast("string"), F.lit("已入职"), *[pick(_WORDS_OF[h]) for h in _PEOPLE[2:-1]], F.lit("广州"))
    numbers = F.array_repeat(F.lit(None).cast("double"), len(_PEOPLE))
    return _cells(spark, sf_dir).select(k.cast("int").alias("source_row"), cells.alias("cells"), numbers.alias("numbers"), F.lit(False).alias("empty"), F.lit(False).alias("hidden"), F.array().cast("array<string>").alias("notes"))


def _people_cleaned(spark: SparkSession, sf_dir: str, corrections: DataFrame | None = None) -> cleaning.Cleaned:
    plan, _ = mapping.decide(mapping.suggest(_PEOPLE), mapping.Decisions(), "2026-01-01")
    settings = cleaning.Settings(AS_OF, school_aliases=(("甲大", "甲大学"),), gpt_list=("甲大学",), gpt_list_mode=True, channel_from_referrer=True)
    return cleaning.clean(_people(spark, sf_dir), plan, settings, corrections)


_RESOLVED = ("education", "school", "graduationYear", "isGptSchool", "referrer", "requirementType", "channel")
QUERIES["resolved_fields"] = lambda spark, sf_dir: _people_cleaned(spark, sf_dir).lineage.where(F.col("field").isin(*_RESOLVED)).groupBy("field", "value", "rule", "confirm").agg(F.count("*").alias("n"))


def _cases(field: str, *found: tuple[str | None, str, bool]) -> str:
    """What the words of a field become, one after another."""
    rows = ", ".join(f"({i}, {'NULL' if v is None else repr(v)}, '{rule}', {confirm})" for i, (v, rule, confirm) in enumerate(found))
    return f"SELECT '{field}' AS field, value, rule, confirm FROM orders JOIN (VALUES {rows}) t(i, value, rule, confirm) ON o_orderkey % {len(found)} = i"


ORACLE_SQL["resolved_fields"] = "SELECT field, value, rule, confirm, count(*) AS n FROM (" + " UNION ALL ".join(
    (
        _cases("education", ("专科", "education.大专", True), ("本科", "education.本科", False), ("硕士", "education.研究生", True), ("博士", "education.博士", False), ("未知", "education.unrecognized", True)),
        _cases("school", ("甲大学", "school.alias", True), ("甲大学", "school.raw", False), ("乙大学", "school.raw", False), (None, "school.missing", False)),
        _cases("graduationYear", ("2027", "year.fourDigit", False), ("2026", "year.fourDigit", True), (None, "year.unparsed", True), (None, "year.outOfRange", True), (None, "year.missing", False)),
        _cases("isGptSchool", ("true", "tristate.是", False), ("false", "tristate.no", False), ("true", "tristate.y", False), (None, "tristate.unrecognized", True), (None, "tristate.missing", False), (None, "tristate.missing", False)),
        _cases("referrer", *[(w, "text.trimmed", False) for w in ("内推", "HR推", "校推", "张三")], (None, "text.nullToken", False), (None, "text.missing", False), ("HR推", "text.trimmed", False)),
        _cases("referrer", ("内推", "referral.内推", False), ("HR推", "referral.HR推", False), ("HR推", "referral.hrSuffix", True), ("未知", "referral.unrecognized", False), ("未知", "referral.missing", False), ("未知", "referral.missing", False), ("HR推", "referral.HR推", False)),
        _cases("requirementType", ("新增招聘", "requirementType.新增", False), ("替补", "requirementType.替补", False), ("未知", "requirementType.unrecognized", True)),
        _cases("channel", ("官网", "channel.官网", False), ("未知", "channel.missing", False), ("Boss", "channel.boss", False), ("未知", "channel.missing", False)),
    )
) + ") GROUP BY 1, 2, 3, 4"
_PEOPLE_SQL = """WITH r AS (SELECT o_orderkey AS k, k % 6 IN (0, 1, 2) AS own, k % 4 IN (0, 1) AS listed, k % 7 = 0 AS referred, k % 4 IN (1, 3) AS no_channel FROM orders) """
QUERIES["gpt_sources"] = lambda spark, sf_dir: grouping.source_counts(_people_cleaned(spark, sf_dir).records, "is_gpt_source")
ORACLE_SQL["gpt_sources"] = _PEOPLE_SQL + "SELECT CASE WHEN own THEN 'aliasTable' WHEN listed THEN 'localList' ELSE 'unknown' END AS source, count(*) AS n FROM r GROUP BY 1"
QUERIES["gpt_schools"] = lambda spark, sf_dir: _people_cleaned(spark, sf_dir).records.groupBy("school", "is_gpt").agg(F.count("*").alias("n"))
ORACLE_SQL["gpt_schools"] = _PEOPLE_SQL + "SELECT CASE WHEN listed THEN '甲大学' WHEN k % 4 = 2 THEN '乙大学' END AS school, CASE WHEN own THEN k % 6 <> 1 WHEN listed THEN TRUE END AS is_gpt, count(*) AS n FROM r GROUP BY 1, 2"
QUERIES["inferred_channels"] = lambda spark, sf_dir: _people_cleaned(spark, sf_dir).records.groupBy("channel", "referral_type").agg(F.count("*").alias("n"))
ORACLE_SQL["inferred_channels"] = _PEOPLE_SQL + """SELECT CASE WHEN NOT no_channel THEN CASE k % 4 WHEN 0 THEN '官网' ELSE 'Boss' END WHEN referred THEN '内推' ELSE '未知' END AS channel,
 CASE k % 7 WHEN 0 THEN '内推' WHEN 1 THEN 'HR推' WHEN 2 THEN 'HR推' WHEN 6 THEN 'HR推' ELSE '未知' END AS referral_type, count(*) AS n FROM r GROUP BY 1, 2"""
QUERIES["source_conflicts"] = lambda spark, sf_dir: _people_cleaned(spark, sf_dir).issues.where(F.col("code").isin("GPT_SOURCE_CONFLICT", "CHANNEL_INFERRED_FROM_REFERRER", "CHANNEL_REFERRER_CONFLICT")).groupBy("code").agg(F.count("*").alias("n"))
ORACLE_SQL["source_conflicts"] = _PEOPLE_SQL + """SELECT code, count(*) AS n FROM (SELECT 'GPT_SOURCE_CONFLICT' AS code FROM r WHERE k % 6 = 1 AND listed
 UNION ALL SELECT 'CHANNEL_INFERRED_FROM_REFERRER' FROM r WHERE referred AND no_channel UNION ALL SELECT 'CHANNEL_REFERRER_CONFLICT' FROM r WHERE referred AND NOT no_channel) GROUP BY 1"""


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities and years corrected by hand in some rows; the rows are resolved anew and say what was changed."""
    k = F.col("o_orderkey")
    by_hand = _cells(spark, sf_dir).select(k.cast("int").alias("source_row"), F.inline(F.array(F.struct(F.lit("city").alias("field"), F.lit("上海").alias("value")), F.struct(F.lit("graduationYear").alias("field"), F.lit("").alias("value")))))
    by_hand = by_hand.where((F.col("source_row") % 23 == 0) | ((F.col("source_row") % 23 == 1) & (F.col("field") == "city")))
    return _people_cleaned(spark, sf_dir, by_hand).records.groupBy("city", "graduation_year", F.array_join("corrected", ",").alias("changed")).agg(F.count("*").alias("n"))


QUERIES["manual_corrections"] = _corrected
ORACLE_SQL["manual_corrections"] = """SELECT CASE WHEN k % 23 <= 1 THEN '上海' ELSE '广州' END AS city, CASE WHEN k % 23 = 0 THEN NULL WHEN k % 5 = 0 THEN 2027 WHEN k % 5 = 1 THEN 2026 END AS graduation_year,
 CASE k % 23 WHEN 0 THEN 'city,graduationYear' WHEN 1 THEN 'city' END AS changed, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1, 2, 3"""


# ------------------------------------------------------------------ the analysis summary
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {_LABELS.get(n, f"coalesce({n}, '未知')")} AS key, offer_status, {_ACTUAL} AS days FROM offers" for n in DIMENSIONS)
_TABLES_SQL = f"SELECT dimension, key, count(*) AS N, {_n(_CORE)} AS D, {_n(_REJ)} AS R, {_n(_REJ)} AS n_rejected_group, {_n(_J)} AS n_joined_group, {_n(f'{_REJ} OR {_J}')} AS n_compared, count(days) AS cycle_n, quantile_cont(days, 0.5) AS cycle_median FROM ({_LONG}) GROUP BY 1, 2"
_PROFILE_SQL = f"""SELECT dimension, key, n_rejected_group, n_joined_group, round(rs, 6) AS rejected_share, round(js, 6) AS joined_share, round(100 * (rs - js), 6) AS contrast, n_rejected_group + n_joined_group >= 5 AS usable
 FROM (SELECT *, n_rejected_group::DOUBLE / all_rejected AS rs, n_joined_group::DOUBLE / all_joined AS js FROM ({_TABLES_SQL}), (SELECT {_n(_REJ)} AS all_rejected, {_n(_J)} AS all_joined FROM offers) WHERE n_compared > 0)"""
_register("summary_tables", lambda d: summary.dimension_tables(d, edges=EDGES), _sql(_TABLES_SQL))
_register("rejection_profile", lambda d: summary.rejection_profile(d, edges=EDGES), _sql(_PROFILE_SQL))


def _pairs(section: str, source: str, *measures: str, keys: str = "NULL AS dimension, NULL AS key") -> str:
    """Columns of a query as rows: names may stand for expressions (`name=expression`)."""
    split = [m.split("=", 1) if "=" in m else (m, m) for m in measures]
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {keys}, '{name}' AS measure, round(({value})::DOUBLE, 6) AS value FROM ({source})" for name, value in split)


_ONE = f"SELECT {BUNDLE_SQL}, {_n(f'{_ACTUAL} > 180')} AS too_long, {_n('salary_amount IS NULL')} AS missing_salary, {_n('school IS NULL')} AS unknown_school FROM offers"
_REASON_SQL = f"SELECT category, count(o.k) AS n FROM (VALUES {', '.join(f"('{c}')" for c in REASON_CATEGORIES)}) c(category) LEFT JOIN (SELECT record_id AS k, CASE WHEN rejection_reason IS NULL THEN '未填写' WHEN rejection_reason = '薪 资' THEN '{REASON_WORDS['薪资']}' WHEN rejection_reason = '其他Offer' THEN '{REASON_WORDS['其他offer']}' ELSE '未分类' END AS found FROM offers WHERE {_REJ}) o ON found = category GROUP BY 1"
_register(
    "analysis_summary",
    lambda d: summary.analysis_summary(d, edges=EDGES),
    _sql(" UNION ALL ".join((
        _pairs("kpi", _ONE, "N=n_total", "J=n_joined", "P=n_pending", "A=n_approving", "R1=n_rejected_offer", "R2=n_rejected_verbally", "R=n_rejected", "D=n_core", "U=n_unknown + n_other"),
        _pairs("rejection", _ONE, "excluded=n_pending + n_approving + n_other + n_unknown"),
        _pairs("cycle", _ONE, "actual_n", "actual_mean", "actual_median", "actual_p75", "planned_n", "planned_median", "too_long"),
        _pairs("quality", _ONE, "unknown_status=n_unknown", "missing_salary", "unknown_school", "cycle_missing=n_total - actual_n"),
        _pairs("dimension", _TABLES_SQL, "N", "D", "R", "n_compared", "cycle_n", "cycle_median", keys="dimension, key"),
        _pairs("profile", f"SELECT * FROM ({_PROFILE_SQL}) WHERE usable", "n_rejected_group", "n_joined_group", "contrast", keys="dimension, key"),
        _pairs("reasons", _REASON_SQL, "count=n", "unfilled=CASE WHEN category = '未填写' THEN 1 ELSE 0 END", keys="NULL AS dimension, category AS key"),
    ))),
)
_register("linked_cross_table", lambda d: linked.linked_table(d, "position", "city", least=40))
_register("linked_table", lambda d: linked.linked_table(d, "school", least=700))


# ------------------------------------------------------------------ digests and objects by revision
_ORDER_COLUMNS = ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")


def _order_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.table_digests(spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_ORDER_COLUMNS), ["o_orderpriority"])


QUERIES["table_digests"] = _order_digests
_LANE = lambda i: f"sum(CAST(CAST(concat('0x', substr(h, {16 * i + 1}, 16)) AS UBIGINT) AS HUGEINT)) % 18446744073709551616"
ORACLE_SQL["table_digests"] = f"""SELECT o_orderpriority, count(*) AS n_rows, sha256(concat_ws(',', count(*), {", ".join(_LANE(i) for i in range(4))})) AS digest
 FROM (SELECT o_orderpriority, sha256(concat_ws(',', {", ".join(f"coalesce(concat(length({c}::VARCHAR), ':', {c}), '-')" for c in _ORDER_COLUMNS)})) AS h FROM orders) GROUP BY 1"""


def _object_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority as an object; one is replaced, one taken away. What each snapshot holds, opened and summed."""
    table = versions.ObjectTable(spark, f"{shared_dir(spark)}/objects/{uuid.uuid4().hex}")
    key, _ = vault.derive_keys("query", b"a fixed salt", 1000)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    for name in ("1-URGENT", "2-HIGH", "5-LOW"):
        table.put("orders", orders.where(F.col("o_orderpriority") == name), key, name)
    table.put("orders", orders.where("o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0"), key, "1-URGENT", 1)
    table.drop("orders", "5-LOW", 1)
    out = None
    for version in (3, 5):
        held = table.load("orders", key, "o_orderkey long", version=version).groupBy("id", "revision").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))
        held = held.select(F.lit(version).alias("version"), "id", "revision", "n", "total")
        out = held if out is None else out.union(held)
    return out


QUERIES["object_versions"] = _object_versions
ORACLE_SQL["object_versions"] = """SELECT version, o_orderpriority AS id, CASE WHEN version = 5 AND o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS revision, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total
 FROM orders, (VALUES (3), (5)) v(version) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (version = 5 AND o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 1) OR o_orderpriority = '5-LOW' AND version = 3
 GROUP BY 1, 2, 3"""

# ------------------------------------------------------------------ ranks and pages of whole tables
_register(
    "ranked_records",
    lambda d: ranking.ranked_by(d.select("record_id", "salary_amount", "start_date"), [F.desc_nulls_last("salary_amount"), F.asc("start_date"), F.asc("record_id")]),
    _sql("SELECT record_id, round(salary_amount, 6) AS salary_amount, start_date::VARCHAR AS start_date, row_number() OVER (ORDER BY salary_amount DESC NULLS LAST, start_date, record_id) AS rank FROM offers"),
)


def _detail_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 7 by start; several records may have one label, these stand as in the list."""
    rows = offers(spark, sf_dir, places=True).select("record_id", "recruiter", "start_date", "place")
    return _rounded(ranking.paged(rows, [F.desc("start_date"), F.asc("record_id"), F.asc("place")]).page(7).drop("place"))


QUERIES["detail_page"] = _detail_page
ORACLE_SQL["detail_page"] = (
    _sql("SELECT record_id, recruiter, start_date::VARCHAR AS start_date, rank FROM (SELECT *, row_number() OVER (ORDER BY start_date DESC, record_id) AS rank FROM offers) WHERE rank BETWEEN 151 AND 175")
)

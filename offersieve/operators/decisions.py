"""The log of cleaning decisions: what was decided, whether it was confirmed, and how many records it touched; and what
a changed setting changes.

DEPENDS is the graph from settings to the fields of a record that follow from them, through the rules that read them.
After a change only the fields below the changed settings are computed anew: the others' columns are never asked for,
so their resolvers are pruned from the plan.  `effects` takes changed settings one after another, each on top of those
before it, so their counts add up to the way from the old records to the new ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.operators.cleaning import Cleaned, Settings, clean
from offersieve.operators.mapping import Mapping_
from offersieve.schema import RULES_VERSION

_DATES = ("start_date", "join_date", "end_date", "d_cycle_days", "d_actual_eligible", "d_planned_eligible", "extensions", "d_flags")
_DUPLICATES = ("dup_kind", "dup_group", "is_first", "dedup_action", "dedup_by", "d_flags")
#: Fields of a record that can change with a setting; ROWS stands for which records there are.
ROWS = "*"
DEPENDS: dict[str, tuple[str, ...]] = {
    "as_of": ("data_as_of",),
    "salary_option": ("currency", "salary_unit", "d_flags"),
    "date_order": (*_DATES, *_DUPLICATES[:-1], ROWS),
    "date1904": (*_DATES, *_DUPLICATES[:-1], ROWS),
    "dedup_strategy": ("dedup_action", ROWS),
    "dedup_confirmed": ("dedup_action", "dedup_by", ROWS),
    "include_hidden": (*_DUPLICATES, ROWS),
    "drop_header_echo": (*_DUPLICATES, ROWS),
    "gpt_list": ("is_gpt", "is_gpt_source", "d_flags"),
    "gpt_list_mode": ("is_gpt", "is_gpt_source", "d_flags"),
    "gpt_list_complete": ("is_gpt", "is_gpt_source", "d_flags"),
    "school_aliases": ("school", "is_gpt", "is_gpt_source", "d_flags"),
    "cycle_too_long_days": ("d_flags",),
    "channel_from_referrer": ("channel", "d_flags"),
}


def last_value(lineage: DataFrame) -> DataFrame:
    """(source_row, field, value, rule): the last entry of each field in a lineage, whose later entries replace earlier ones."""
    order = F.col("position") if "position" in lineage.columns else F.lit(0)
    return lineage.groupBy("source_row", "field").agg(F.max_by(F.struct("value", "rule"), order).alias("last")).select("source_row", "field", "last.*")


def _entries(s: Settings) -> list[tuple[str, str, str, bool]]:
    """(id, label, detail, confirmed) of every decision."""
    order = {None: "未确认，日月不明的写法不转换", "day-first": "先日后月", "month-first": "先月后日"}.get(s.date_order, str(s.date_order))
    gpt = f"名单 {len(s.gpt_list)} 所，{'完整' if s.gpt_list_complete else '不完整'}" if s.gpt_list_mode else "只看原值"
    return [
        ("asOf", "分析截止日", s.as_of, True),
        ("salary", "计薪口径", s.salary_option, s.salary_option != "暂不确定"),
        ("dateOrder", "日月顺序", order, s.date_order is not None),
        ("dedup", "重复处理", s.dedup_strategy, s.dedup_confirmed),
        ("emptyRows", "空行", "跳过", True),
        ("hiddenRows", "隐藏行", "保留" if s.include_hidden else "排除", True),
        ("headerEcho", "表头残留行", "移除" if s.drop_header_echo else "保留", s.drop_header_echo),
        ("gptList", "GPT 院校", gpt, not s.gpt_list_mode or s.gpt_list_complete),
        ("schoolAliases", "学校别名", f"{len(s.school_aliases)} 条", not s.school_aliases),
        ("channel", "渠道推断", "按推荐人" if s.channel_from_referrer else "不推断", True),
        ("cycleTooLong", "过长周期", f"超过 {s.cycle_too_long_days} 天提示", True),
    ]


def decision_log(cleaned: Cleaned) -> DataFrame:
    """(position, id, label, detail, confirmed, rules_version, n_records) of a data set; n_records are those that a decision touched."""
    spark, s = cleaned.records.sparkSession, cleaned.settings
    issue = lambda *codes: F.count_distinct(F.when(F.col("code").isin(*codes), F.col("source_row")))
    rule = lambda pattern: F.count_distinct(F.when(F.col("rule").rlike(pattern), F.col("source_row")))
    by_issue = cleaned.issues.agg(issue("CHANNEL_INFERRED_FROM_REFERRER").alias("channel"), issue("CYCLE_TOO_LONG").alias("cycleTooLong"), issue("DATE_NOT_CONVERTED", "PLANNED_DATE_UNCERTAIN").alias("dateOrder"))
    by_rule = cleaned.lineage.agg(rule(r"^school\.alias").alias("schoolAliases"))
    salary = F.count_if(F.col("salary_amount").isNotNull()).alias("salary")
    by_record = cleaned.records.agg(F.count("*").alias("asOf"), salary, F.count_if(F.col("is_gpt_source") == "localList").alias("gptList"), F.count_if(F.col("dup_kind") != "none").alias("_pairs"))
    counted = cleaned.counts.select(F.col("n_empty").alias("emptyRows"), F.col("n_hidden").alias("hiddenRows"), F.col("n_header_echo").alias("headerEcho"), F.col("n_removed").alias("_removed"))
    one = by_issue.crossJoin(by_rule).crossJoin(by_record).crossJoin(counted)  # tables of one row
    entries = _entries(s)
    value = lambda i: F.col("_pairs") + F.col("_removed") if i == "dedup" else F.col(i)
    rows = F.array(*[F.struct(F.lit(i).alias("id"), value(i).cast("long").alias("n_records")) for i, *_ in entries])
    named = spark.createDataFrame([(n, *e, RULES_VERSION) for n, e in enumerate(entries)], "position int, id string, label string, detail string, confirmed boolean, rules_version string")
    return named.join(F.broadcast(one.select(F.inline(rows))), "id").select("position", "id", "label", "detail", "confirmed", "rules_version", "n_records")  # a dozen rows


def _compared(old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: n_added, n_removed, and for each field the records in which it is another value."""
    fields = [f for f in fields if f in old.columns and f in new.columns]
    kinds = dict(new.dtypes)
    value = lambda f: F.to_json(f) if kinds[f].startswith("map") else F.col(f)  # noqa: E731  maps can't be compared
    a = old.select(F.col("record_id").alias("_id"), *[value(f).alias(f"_old_{f}") for f in fields])
    b = new.select("record_id", *[value(f).alias(f) for f in fields])
    both = a.join(b, F.col("_id") == F.col("record_id"), "full")
    there = F.col("_id").isNotNull() & F.col("record_id").isNotNull()
    changed = [F.count_if(there & ~F.col(f).eqNullSafe(F.col(f"_old_{f}"))).alias(f) for f in fields]
    return both.agg(F.count_if(F.col("_id").isNull()).alias("n_added"), F.count_if(F.col("record_id").isNull()).alias("n_removed"), *changed)


def effects(rows: DataFrame, mapping: Mapping_, before: Settings, after: Settings, **how: object) -> DataFrame:
    """(position, setting, field, n): for each changed setting in turn, the records it adds (`+`), takes away (`-`), and changes in each field.

    Only fields that depend on the setting are computed; what changes nothing has no row.
    """
    spark, now, out = rows.sparkSession, before, None
    for position, name in enumerate(n for n in DEPENDS if getattr(before, n) != getattr(after, n)):
        then = replace(now, **{name: getattr(after, name)})
        fields = [f for f in DEPENDS[name] if f != ROWS]
        if fields or ROWS in DEPENDS[name]:
            one = _compared(clean(rows, mapping, now, **how).records, clean(rows, mapping, then, **how).records, fields)
            names = {"n_added": "+", "n_removed": "-"} | {f: f for f in one.columns if f not in ("n_added", "n_removed")}
            found = one.select(F.lit(position).alias("position"), F.lit(name).alias("setting"), F.inline(F.array(*[F.struct(F.lit(v).alias("field"), F.col(k).alias("n")) for k, v in names.items()]))).where("n > 0")
            out = found if out is None else out.union(found)
        now = then
    return spark.createDataFrame([], "position int, setting string, field string, n long") if out is None else out

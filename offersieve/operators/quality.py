"""Quality issues: counts, severities, disabled analyses, availability, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions.text import is_blank
from offersieve.operators.metrics import actual_days, count_where, in_core
from offersieve.schema import BLOCKING, FIELD_ERROR, ISSUE_DISABLES, ISSUE_SEVERITY, MODULES, REJECTIONS, UNKNOWN, WARNING


def severity(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in ISSUE_SEVERITY.items() for x in (k, v)])[code]


def by_code(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("n"))


def by_severity(issues: DataFrame) -> DataFrame:
    """(severity, n): all three, also without an issue."""
    known = issues.sparkSession.createDataFrame([(s,) for s in (BLOCKING, FIELD_ERROR, WARNING)], "severity string")
    counts = issues.groupBy(severity(F.col("code")).alias("severity")).agg(F.count("*").alias("n"))
    return F.broadcast(known).join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))  # three rows


def has_blocking(issues: DataFrame) -> DataFrame:
    return issues.agg(F.coalesce(F.bool_or(severity(F.col("code")) == BLOCKING), F.lit(False)).alias("blocking"))


def disabled_modules(issues: DataFrame) -> DataFrame:
    """(module): analyses that some issue in the data set switches off."""
    pairs = issues.sparkSession.createDataFrame([(c, m) for c, ms in ISSUE_DISABLES.items() for m in ms], "code string, module string")
    return F.broadcast(pairs).join(issues.select("code").distinct(), "code", "left_semi").select("module").distinct()  # a fixed table


def worklist(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Records with an issue: source_row, record_id, their different codes and fields, and the worst severity."""
    rank = F.when(severity(F.col("code")) == BLOCKING, 0).when(severity(F.col("code")) == FIELD_ERROR, 1).otherwise(2)
    per_row = issues.where("source_row is not null").groupBy("source_row").agg(
        F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("field")).alias("fields"), F.min(rank).alias("rank")
    )
    label = F.element_at(F.array(*map(F.lit, (BLOCKING, FIELD_ERROR, WARNING))), F.col("rank") + 1)
    return records.select("source_row", "record_id").join(per_row, "source_row").select("source_row", "record_id", "codes", "fields", label.alias("severity"))


def module_samples(records: DataFrame) -> DataFrame:
    """(module, n): valid samples of each analysis."""
    known = lambda c: ~is_blank(F.col(c)) & (F.col(c) != UNKNOWN)
    rejected = F.col("offer_status").isin(*REJECTIONS)
    samples = (
        in_core(), F.col("offer_status").isNotNull(), actual_days().isNotNull(), F.col("salary_amount").isNotNull(),
        F.col("housing_type") != UNKNOWN, rejected & ~is_blank(F.col("rejection_reason")), known("city"), known("channel"), known("recruiter"),
        known("position"), ~is_blank(F.col("requirement_id")),
    )
    one = records.agg(*[count_where(s).alias(f"m{i}") for i, s in enumerate(samples)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("module"), F.col(f"m{i}").alias("n")) for i, m in enumerate(MODULES)])))


#: What a module's samples are, where that is not plain from its name.
SAMPLE_NOTES = {
    "核心率": "样本为 D 中的记录", "招聘周期": "样本为日期有效的已入职记录", "薪资对比": "样本为有薪资的记录", "房补对比": "样本为房补类型已知的记录", "拒offer原因": "样本为填写了原因的拒绝记录",
}


def availability(records: DataFrame, issues: DataFrame, salary_option: str | None = None) -> DataFrame:
    """(module, n, available, reason): why a module can't be used, or what its samples are."""
    off = disabled_modules(issues).withColumn("off", F.lit(True))
    out = module_samples(records).join(F.broadcast(off), "module", "left")  # eleven rows
    blocked = F.coalesce("off", F.lit(False))
    pay = F.lit("计薪口径待确认" + (f"（{salary_option}）" if salary_option else "") + "，模块停用")
    note = F.create_map(*[F.lit(x) for kv in SAMPLE_NOTES.items() for x in kv])[F.col("module")]
    reason = F.when(blocked & F.col("module").isin("薪资对比", "房补对比"), pay).when(blocked, F.lit("数据问题使该模块停用")).when(F.col("n") == 0, F.lit("没有有效样本")).otherwise(note)
    return out.select("module", "n", (~blocked & (F.col("n") > 0)).alias("available"), reason.alias("reason"))


def counters(records: DataFrame, too_long_days: int = 180) -> DataFrame:
    """One row of quality counters."""
    return records.agg(
        count_where(F.col("start_date").isNull()).alias("n_start_missing"), count_where(F.col("salary_amount").isNull()).alias("n_salary_missing"),
        count_where(F.datediff("join_date", "start_date") < 0).alias("n_negative_cycle"), count_where(actual_days() > too_long_days).alias("n_cycle_too_long"),
        count_where(F.col("offer_status") == UNKNOWN).alias("n_status_unknown"), count_where(is_blank(F.col("requirement_id"))).alias("n_requirement_missing"),
    )

"""Raw rows to clean records: one projection of resolvers, derived fields, issues, duplicates, report.

Raw rows hold (source_row int, cells array<string>, numbers array<double>, empty, hidden, notes).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions import resolve
from offersieve.functions.dates import parse_date_cell
from offersieve.functions.numbers import extract_amount, valid_amount
from offersieve.functions.text import display_id, header_key_of, nfkc_cells, plain_cells, plain_text, stable_digest
from offersieve.operators import duplicates
from offersieve.operators.mapping import Mapping_, pick
from offersieve.operators.metrics import LONG_CYCLE_DAYS, in_core, is_accepted, is_rejected
from offersieve.schema import EXTENSION_FIELDS, JOINED, KEEP_FIRST, PENDING, REFERRAL, RULES_VERSION, SALARY_UNITS, SCHEMA_VERSION, STANDARD_FIELDS, UNKNOWN
from offersieve.tables import stored

_HEADERS = {f[0]: f[1] for f in STANDARD_FIELDS}
_TEXT_FIELDS = {"requirement_id": "requirementId", "recruiter": "recruiter", "department": "department", "position": "position", "job_family": "jobFamily", "candidate_name": "candidateName", "referrer": "referrer"}


@dataclass(frozen=True)
class Settings:
    """What the user confirmed before cleaning."""

    as_of: str
    salary_option: str = "人民币元/月"
    date_order: str | None = None
    dedup_strategy: str = KEEP_FIRST
    dedup_confirmed: bool = False
    include_hidden: bool = True
    drop_header_echo: bool = False
    gpt_list: tuple[str, ...] = ()
    gpt_list_mode: bool = False
    gpt_list_complete: bool = False
    school_aliases: tuple[tuple[str, str], ...] = ()
    cycle_too_long_days: int = LONG_CYCLE_DAYS
    channel_from_referrer: bool = False
    date1904: bool | None = None

    def revision(self) -> str:
        """Digest of what changes results."""
        return stable_digest(repr(self))

    def changes(self, other: Settings) -> dict[str, tuple[object, object]]:
        return {k: (v, getattr(other, k)) for k, v in vars(self).items() if v != getattr(other, k)}


@dataclass(frozen=True)
class Cleaned:
    """records: kept ones; issues: (source_row, code, field, raw); lineage: (source_row, field, raw, value, rule, confirm).

    The first of records, issues and counts that is asked for has the resolvers run and their values written, once for all three.
    """

    lineage: DataFrame
    settings: Settings = field(repr=False)
    make: Callable[[], tuple[DataFrame, DataFrame, DataFrame]] = field(repr=False)

    @cached_property
    def _made(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.make()

    @property
    def records(self) -> DataFrame:
        return self._made[0]

    @property
    def issues(self) -> DataFrame:
        return self._made[1]

    @property
    def counts(self) -> DataFrame:
        return self._made[2]


def sheet_signature(headers: Sequence[str], sheet: str = "", rows: int | None = None) -> str:
    return stable_digest("\u001f".join([sheet, *headers, str(rows or "")]))


def header_echo(texts: Column, headers: Sequence[str]) -> Column:
    """Some cell of the row (plain_cells) repeats some header."""
    keys = sorted({header_key_of(h) for h in headers} - {""})
    return F.exists(texts, lambda c: F.lower(F.coalesce(c, F.lit(""))).isin(keys)) if keys else F.lit(False)


def corrected(rows: DataFrame, corrections: DataFrame, mapping: Mapping_) -> DataFrame:
    """rows with manual corrections (source_row, field, value) laid over their cells; '' means missing.

    Adds corrected, the fields that were changed.
    """
    index = F.create_map(*[F.lit(x) for t, cols in mapping.columns.items() for x in (t, cols[0])])
    by_row = corrections.where(index[F.col("field")].isNotNull()).groupBy("source_row").agg(
        F.map_from_entries(F.collect_list(F.struct(index[F.col("field")].alias("i"), F.col("value")))).alias("_new"), F.array_sort(F.collect_set("field")).alias("corrected")
    )
    joined = rows.join(by_row, "source_row", "left")
    cells = F.transform("cells", lambda c, i: F.when(F.coalesce(F.map_contains_key("_new", i), F.lit(False)), F.nullif(F.col("_new")[i], F.lit(""))).otherwise(c))
    numbers = F.transform("numbers", lambda n, i: F.when(~F.coalesce(F.map_contains_key("_new", i), F.lit(False)), n))
    return joined.withColumns({"cells": F.when(F.col("_new").isNull(), F.col("cells")).otherwise(cells), "numbers": F.when(F.col("_new").isNull(), F.col("numbers")).otherwise(numbers)}).drop("_new")


def _number(mapping: Mapping_, target: str) -> Column:
    columns = mapping.columns.get(target, ())
    return F.get(F.col("numbers"), F.lit(columns[0])) if len(columns) == 1 else F.lit(None).cast("double")


def resolved(rows: DataFrame, mapping: Mapping_, s: Settings) -> DataFrame:
    """rows, whose t_cells are plain texts, plus one struct r_<field> for each field, resolved in dependency order."""
    rows = rows.withColumns({f"t_{key}": pick(mapping, key, "t_cells") for key, *_ in STANDARD_FIELDS})
    p = lambda key: F.col(f"t_{key}")
    text = {f"r_{name}": resolve.text_value(p(key), _number(mapping, key), key == "requirementId") for name, key in _TEXT_FIELDS.items()}
    dates = {f"r_{name}": parse_date_cell(p(key), _number(mapping, key), s.date1904, s.date_order) for name, key in (("start_date", "recruitmentStartDate"), ("join_date", "joiningDate"), ("end_date", "expectedEndDate"))}
    out = rows.withColumns(
        {
            **text, **dates, "r_city": resolve.city(p("city")), "r_requirement_type": resolve.requirement_type(p("requirementType")), "r_channel": resolve.channel(p("channel")),
            "r_education": resolve.education(p("education")), "r_school": resolve.school(p("school"), s.school_aliases), "r_graduation_year": resolve.graduation_year(p("graduationYear")),
            "r_offer_status": resolve.offer_status(p("offerStatus"), mapping.headers), "r_salary_amount": resolve.salary_amount(p("salaryAmount")), "r_housing_type": resolve.housing(p("housingRaw")),
            "r_is_gpt": resolve.tri_state(p("isGptSchool")), "r_rejection_reason": resolve.text_value(p("rejectionReason")),
        }
    )
    return out.withColumns(
        {
            "r_referral_type": resolve.referral_type(p("referrer"), F.col("r_channel.value")),
            "g": resolve.gpt_school(p("isGptSchool"), F.col("r_school.value"), s.gpt_list, s.gpt_list_mode, s.gpt_list_complete),
        }
    )


def _extensions(mapping: Mapping_, s: Settings) -> Column:
    """Typed values of mapped extension columns as text; missing ones are left out."""
    pairs = []
    for key, _, kind in EXTENSION_FIELDS:
        if key in mapping.columns:
            cell = plain_text(pick(mapping, key))
            value = {
                "date": lambda c, k=key: parse_date_cell(c, _number(mapping, k), s.date1904, s.date_order)["date"].cast("string"),
                "amount": lambda c: valid_amount(extract_amount(c)).cast("string"),
                "text": lambda c: resolve.text_value(c)["value"],
            }[kind](cell)
            pairs += [F.struct(F.lit(key).alias("key"), value.alias("value"))]
    empty = F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else empty


def values(rows: DataFrame, mapping: Mapping_, s: Settings) -> DataFrame:
    """The value columns of a record, then derived ones."""
    r = lambda name: F.col(f"r_{name}.value")
    d = lambda name: F.col(f"r_{name}.date").alias(name)
    currency, unit, comparable = SALARY_UNITS[s.salary_option]
    amount = valid_amount(r("salary_amount"))
    inferred = F.lit(s.channel_from_referrer) & (r("referral_type") == REFERRAL) & (r("channel") == UNKNOWN) & (F.col("r_channel.rule") == "channel.missing")
    stamp = lambda v: F.when(amount.isNotNull() & F.lit(comparable), F.lit(v).cast("string"))
    rejected = is_rejected(r("offer_status"))
    flat = rows.select(
        *[c for c in rows.columns if not c.startswith(("r_", "t_")) and c != "g"], *[F.col(c) for c in rows.columns if c.startswith("r_")], "g",
        *[r(n).alias(n) for n in _TEXT_FIELDS], r("city").alias("city"), F.col("r_city.raw").alias("city_raw"), r("requirement_type").alias("requirement_type"),
        d("start_date"), d("join_date"), d("end_date"), r("graduation_year").alias("graduation_year"), r("education").alias("education"), r("school").alias("school"),
        F.col("g.value").alias("is_gpt"), F.col("g.source").alias("is_gpt_source"), r("referral_type").alias("referral_type"),
        F.when(inferred, F.lit(REFERRAL)).otherwise(r("channel")).alias("channel"), inferred.alias("channel_inferred"),
        amount.alias("salary_amount"), stamp(currency).alias("currency"), stamp(unit).alias("salary_unit"),
        pick(mapping, "housingRaw", "raw_cells").alias("housing_raw"), r("housing_type").alias("housing_type"), F.col("r_housing_type.amount").alias("housing_amount"),
        F.col("r_housing_type.period").alias("housing_period"), F.col("r_housing_type.reason").alias("housing_reason"), r("offer_status").alias("offer_status"),
        F.when(F.coalesce(rejected, F.lit(False)), r("rejection_reason")).alias("rejection_reason"), _extensions(mapping, s).alias("extensions"),
    )
    raw_days = F.datediff("join_date", "start_date")
    cycle = F.when((F.col("offer_status") == JOINED) & (raw_days >= 0), raw_days)
    return flat.withColumns(
        {
            "raw_cycle_days": F.when(F.col("offer_status") == JOINED, raw_days), "d_cycle_days": cycle, "d_actual_eligible": cycle.isNotNull(),
            "d_planned_eligible": (F.col("offer_status") == PENDING) & F.col("join_date").isNotNull(), "d_accepted": is_accepted(), "d_rejected": is_rejected(), "d_in_core": in_core(),
        }
    )


_SOURCES = {
    **{f"r_{n}": k for n, k in _TEXT_FIELDS.items()}, "r_city": "city", "r_requirement_type": "requirementType", "r_channel": "channel", "r_education": "education", "r_school": "school",
    "r_graduation_year": "graduationYear", "r_is_gpt": "isGptSchool", "r_start_date": "recruitmentStartDate", "r_join_date": "joiningDate", "r_end_date": "expectedEndDate",
    "r_offer_status": "offerStatus", "r_salary_amount": "salaryAmount", "r_housing_type": "housingRaw", "r_referral_type": "referrer",
}


def issue_array(mapping: Mapping_, s: Settings) -> Column:
    """(code, field, raw) of every issue of a row."""
    one = lambda condition, code, key, raw: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(_HEADERS.get(key)).alias("field"), raw.cast("string").alias("raw")))
    each = [F.when(F.col(f"{c}.code").isNotNull(), F.struct(F.col(f"{c}.code").alias("code"), F.lit(_HEADERS[k]).alias("field"), pick(mapping, k, "raw_cells").alias("raw"))) for c, k in _SOURCES.items()]
    pay, comparable = F.col("salary_amount"), SALARY_UNITS[s.salary_option][2]
    conflict = F.lit(s.channel_from_referrer) & (F.col("referral_type") == REFERRAL) & ~F.col("channel_inferred") & (F.col("channel") != REFERRAL)
    each += [
        one(pick(mapping, "offerStatus", "raw_cells").isNull(), "MISSING_REQUIRED_VALUE", "offerStatus", F.lit(None)),
        one(F.col("raw_cycle_days") < 0, "NEGATIVE_CYCLE", "joiningDate", F.col("join_date")),
        one(F.col("d_cycle_days") > s.cycle_too_long_days, "CYCLE_TOO_LONG", "joiningDate", F.col("join_date")),
        one(F.col("d_planned_eligible"), "PLANNED_DATE_UNCERTAIN", "joiningDate", F.col("join_date")),
        one(pay.isNotNull() & ~F.lit(comparable), "SALARY_UNIT_UNCONFIRMED", "salaryAmount", pick(mapping, "salaryAmount", "raw_cells")),
        one(F.col("g.conflict"), "GPT_SOURCE_CONFLICT", "isGptSchool", pick(mapping, "isGptSchool", "raw_cells")),
        one(F.col("channel_inferred"), "CHANNEL_INFERRED_FROM_REFERRER", "channel", pick(mapping, "channel", "raw_cells")),
        one(conflict, "CHANNEL_REFERRER_CONFLICT", "channel", pick(mapping, "channel", "raw_cells")),
        one(F.col("echo"), "HEADER_ECHO_CELL", None, F.lit(None)),
    ]
    notes = F.transform(F.filter("notes", lambda n: n != "HEADER_ECHO_CELL"), lambda n: F.struct(n.alias("code"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("raw")))
    manual = F.transform("corrected", lambda f: F.struct(F.lit("MANUAL_CORRECTION_APPLIED").alias("code"), f.alias("field"), F.lit(None).cast("string").alias("raw")))
    return F.concat(notes, F.array_compact(F.array(*each)), F.coalesce(manual, F.array().cast("array<struct<code:string,field:string,raw:string>>")))


def lineage(v: DataFrame, mapping: Mapping_) -> DataFrame:
    """(source_row, field, raw, value, rule, rules_version, confirm): how each value came about."""
    each = []
    for c, k in _SOURCES.items():
        value = F.col(f"{c}.date") if c.endswith("_date") else F.col(f"{c}.value")
        each.append(F.struct(F.lit(k).alias("field"), pick(mapping, k, "raw_cells").alias("raw"), value.cast("string").alias("value"), F.col(f"{c}.rule").alias("rule"), F.col(f"{c}.confirm").alias("confirm")))
    return v.select("source_row", F.inline(F.array(*each))).select("source_row", "field", "raw", "value", "rule", F.lit(RULES_VERSION).alias("rules_version"), "confirm")


def clean(rows: DataFrame, mapping: Mapping_, s: Settings, corrections: DataFrame | None = None, dataset_id: str = "dataset", batch_id: str = "batch", sheet: str = "", signature: str | None = None) -> Cleaned:
    """The whole way: admission, corrections, resolvers, derived fields, duplicates, counts.

    A record is known by data set, batch, file, sheet and source row. Corrections that were made for a sheet of another
    signature (sheet_signature) are not applied; without a signature they are.
    """
    mapping.check()
    if "file" not in rows.columns:
        rows = rows.withColumn("file", F.lit(""))
    if signature is not None and signature != sheet_signature(mapping.headers, sheet):
        corrections = None
    admitted = rows.where("not empty")
    if not s.include_hidden:
        admitted = admitted.where("not hidden")
    # Resolvers cost more than moving rows: a list in few pieces is dealt to all tasks.
    admitted = admitted.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Compatibility form once for the whole row; raw_cells keep what was written.
    admitted = admitted.withColumns({"raw_cells": F.col("cells"), "cells": nfkc_cells("cells")}).withColumn("t_cells", plain_cells(F.col("cells")))
    admitted = admitted.withColumn("echo", header_echo(F.col("t_cells"), mapping.headers))
    if s.drop_header_echo:
        admitted = admitted.where("not echo")
    if corrections is None:
        admitted = admitted.withColumn("corrected", F.lit(None).cast("array<string>"))
    else:
        admitted = corrected(admitted, corrections, mapping).withColumn("t_cells", plain_cells(F.col("cells")))
    admitted = admitted.withColumn("exact_key", duplicates.exact_key(F.col("t_cells")))
    v = values(resolved(admitted, mapping, s), mapping, s)
    record_id = F.sha2(F.concat_ws("\u001f", F.lit(dataset_id), F.lit(batch_id), F.coalesce("file", F.lit("")), F.lit(sheet), F.col("source_row").cast("string")), 256).substr(1, 32)
    v = v.withColumns({"record_id": record_id, "offer_id": F.col("extensions")["offerId"], "issues": issue_array(mapping, s)})
    v = v.withColumn("suspected_key", duplicates.suspected_key())

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        hidden = [c for c in v.columns if c.startswith("r_")] + ["g", "raw_cycle_days", "numbers", "notes", "empty", "channel_inferred"]
        return _outputs(stored(v.drop(*hidden), "values"), rows, s, dataset_id, batch_id, sheet)

    return Cleaned(lineage(v, mapping), s, make)


def _outputs(v: DataFrame, rows: DataFrame, s: Settings, dataset_id: str, batch_id: str, sheet: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, issues and counts from values on disk: they are read several times, and resolvers are dear."""
    marked = duplicates.decide(duplicates.mark(v.select("record_id", "source_row", "exact_key", "suspected_key")), s.dedup_strategy, s.dedup_confirmed)
    marked = stored(marked.select("record_id", "dup_kind", "dup_group", "is_first", "dedup_action", "dedup_by"), "marked")
    joined = v.drop("exact_key", "suspected_key").join(marked, "record_id")
    dup_code = F.when(F.col("dup_kind") == "exact", F.lit("EXACT_DUPLICATE")).when(F.col("dup_kind") == "suspected", F.lit("SUSPECTED_DUPLICATE"))
    firsts = marked.where("dup_kind <> 'none' and is_first").join(v.select("record_id", "source_row"), "record_id")
    group_issues = firsts.select("record_id", "source_row", dup_code.alias("code"), F.lit(None).cast("string").alias("field"), F.col("dup_group").alias("raw"))
    issues = v.select("record_id", "source_row", F.inline("issues")).unionByName(group_issues)
    # Every member of a duplicate group has its flag; the group's issue stands at its first row.
    flags = F.array_sort(F.array_distinct(F.concat(F.transform("issues", lambda i: i["code"]), F.array_compact(F.array(dup_code)))))
    records = joined.withColumn("d_flags", flags).drop("echo", "issues").where("dedup_action <> 'removedAsDuplicate'").withColumns(
        {
            "dataset_id": F.lit(dataset_id), "batch_id": F.lit(batch_id), "source_sheet": F.lit(sheet), "schema_version": F.lit(SCHEMA_VERSION), "rules_version": F.lit(RULES_VERSION),
            "data_as_of": F.lit(s.as_of).cast("date"), "display_id": display_id(F.col("record_id")),
        }
    )
    raw = rows.agg(F.count("*").alias("n_raw"), F.count_if("empty").alias("n_empty"), F.count_if(F.col("hidden")).alias("n_hidden"))
    stays = F.col("dedup_action") != "removedAsDuplicate"
    with_issue = (F.size("issues") > 0) | ((F.col("dup_kind") != "none") & F.col("is_first"))
    figures = joined.agg(
        F.count("*").alias("n_built"), F.count_if(~stays).alias("n_removed"), F.count_if("echo").alias("n_header_echo"), F.count_if(stays).alias("n_kept"),
        F.count_distinct(F.when(stays, F.col("requirement_id"))).alias("n_requirements"), F.count_if(with_issue).alias("n_issue_rows"),
    )
    return records, issues, raw.crossJoin(figures)  # the counts: two tables of one row


def append(current: DataFrame, new: DataFrame, strategy: str = KEEP_FIRST, confirmed: bool = False) -> DataFrame:
    """Two batches of records as one, duplicates decided anew; the earlier batch comes first.

    batch_no counts the batches from 0. Records of the new batch get ids of their own, so lists of the same names can follow.
    """
    if "batch_no" in current.columns:
        number = current.agg(F.coalesce(F.max("batch_no"), F.lit(0)) + 1).first()[0]
    else:
        current, number = current.withColumn("batch_no", F.lit(0)), 1
    own = F.sha2(F.concat_ws("\u001f", "record_id", F.lit(str(number))), 256).substr(1, 32)
    added = new.withColumns({"record_id": own, "batch_no": F.lit(number)}).withColumn("display_id", display_id(F.col("record_id")))
    both = current.unionByName(added, allowMissingColumns=True)
    order = (F.col("batch_no").cast("long") * 2**32 + F.col("source_row")).alias("source_row")
    texts = both.withColumn("t_cells", plain_cells(F.col("cells")))  # used twice
    keys = texts.withColumns({"exact_key": duplicates.exact_key(F.col("t_cells")), "suspected_key": duplicates.suspected_key()}).select("record_id", order, "exact_key", "suspected_key")
    keys = stored(keys, "keys")  # read four times
    marked = duplicates.decide(duplicates.mark(keys), strategy, confirmed).select("record_id", "dup_kind", "dup_group", "dedup_action", "dedup_by")
    out = both.drop("dup_kind", "dup_group", "dedup_action", "dedup_by", "is_first").join(marked, "record_id")
    return out.where("dedup_action <> 'removedAsDuplicate'")


def decisions(s: Settings) -> Mapping[str, str]:
    """The decision list of a data set's report."""
    return {
        "薪资口径": s.salary_option, "日期顺序": s.date_order or "未确认", "去重": f"{s.dedup_strategy}（{'已确认' if s.dedup_confirmed else '未确认'}）",
        "隐藏行": "包含" if s.include_hidden else "排除", "表头残留行": "移除" if s.drop_header_echo else "保留", "GPT名单": f"{len(s.gpt_list)} 所" if s.gpt_list_mode else "不使用",
        "推荐人推断渠道": "开启" if s.channel_from_referrer else "关闭", "配置版本": s.revision(),
    }

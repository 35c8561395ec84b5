"""A demo list of any length: plainly made-up rows, each computed from its number alone.

Row i does not depend on how many rows there are or where they are made.  The first FIRST rows have fixed counts (so many
of each status, city and so on), by rules over their number; every later one draws its cells from a hash of the seed, its
number and the column.  Names and schools are placeholders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.schema import CITIES, EDUCATIONS, OFFER_STATUSES, STANDARD_HEADERS, STANDARD_KEYS, UNKNOWN
from offersieve.sources.delimited import RAW

FIRST = 50
NOTICE = "纯合成演示数据，不含真实记录；空白表示缺失。"
#: Statuses of the first rows, and how many have each.
_STATUSES = tuple(zip(OFFER_STATUSES, (26, 4, 9, 6, 3, 1, 1), strict=True))
_REASONS = ("薪酬", "地点", "实习时间", "住房/住宿", "薪酬太低所以去了别家")


def _choice(values: Sequence[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _draw(name: str, seed: int, n: int) -> Column:
    """A number under n from the seed, the row's number and the column's name."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(name)), F.lit(n))


def _cells(seed: int) -> dict[str, Column]:
    i, early = F.col("id"), F.col("id") < FIRST
    fixed_status, end = F.lit(OFFER_STATUSES[-1]), FIRST
    for status, n in reversed(_STATUSES):
        end -= n
        fixed_status = fixed_status if status == OFFER_STATUSES[-1] else F.when(i < end + n, status).otherwise(fixed_status)
    either = lambda name, values, fixed: F.when(early, _choice(values, fixed)).otherwise(_choice(values, _draw(name, seed, len(values))))
    status = F.when(early, fixed_status).otherwise(_choice(OFFER_STATUSES, _draw("status", seed, len(OFFER_STATUSES))))
    start = F.date_add(F.lit("2026-01-01").cast("date"), F.when(early, i).otherwise(_draw("start", seed, 180)).cast("int"))
    wait = F.when(early, F.when(i % 2 == 0, -13).otherwise(14)).otherwise(_draw("wait", seed, 60) - 5)
    joined = status.isin("已入职", "待入职")
    refused = F.col("id") - 39
    reason = F.when(early, F.when((refused >= 0) & (refused < len(_REASONS)), _choice(_REASONS, F.pmod(refused, F.lit(len(_REASONS)))))).otherwise(F.when(status.startswith("拒绝"), _choice(_REASONS, _draw("reason", seed, len(_REASONS)))))
    cities = [c for c in CITIES if c not in ("其他", UNKNOWN)][:3]
    return {
        "requirementId": F.format_string("DEMO-%05d", F.floor(i / 2)), "recruiter": F.concat(F.lit("样例HR"), (i % 4).cast("string")), "city": either("city", cities, i % 3),
        "department": F.lit("样例部门"), "position": _choice(["样例岗位甲", "样例岗位乙"], i % 2), "jobFamily": F.lit("样例序列"),
        "requirementType": F.when(F.when(early, i % 6 == 5).otherwise(_draw("type", seed, 6) == 5), "替补替换未拆分").otherwise("新增招聘"),
        "recruitmentStartDate": start.cast("string"), "joiningDate": F.when(joined, F.date_add(start, wait.cast("int")).cast("string")), "expectedEndDate": F.lit(None).cast("string"),
        "candidateName": F.concat(F.lit("样例候选人"), i.cast("string")), "graduationYear": F.when(i % 2 == 0, "2027").otherwise("2026"), "education": either("education", EDUCATIONS[:3], i % 3),
        "school": F.concat(F.lit("样例大学"), (i % 5).cast("string")), "isGptSchool": F.when(F.when(early, i % 4 == 0).otherwise(_draw("gpt", seed, 4) == 0), "是").otherwise("否"),
        "referrer": _choice(["内推", "样例推荐人"], i % 2), "channel": either("channel", ["Boss", "实习僧", "内推"], i % 3),
        "salaryAmount": (3500 + 300 * F.when(early, i % 6).otherwise(_draw("salary", seed, 6))).cast("string"), "housingRaw": F.lit(None).cast("string"), "offerStatus": status, "rejectionReason": reason,
    }


def demo_rows(spark: SparkSession, n: int = FIRST, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Raw rows of the list: a header (row 1) and n rows, as a file of them would be read."""
    cells = _cells(seed)
    values = F.array(*[cells[k] for k in STANDARD_KEYS])
    header = F.array(*[F.lit(h) for h in STANDARD_HEADERS])
    rows = spark.range(-1, n, 1, partitions).select((F.col("id") + 2).cast("int").alias("source_row"), F.when(F.col("id") < 0, header).otherwise(values).alias("cells"))
    made = {"file": F.lit("demo"), "sheet": F.lit(""), "numbers": F.array_repeat(F.lit(None).cast("double"), len(STANDARD_KEYS)), "hidden": F.lit(False), "notes": F.array().cast("array<string>")}
    return rows.withColumns(made).select(*[c.split()[0] for c in RAW.split(", ")])


def demo_lines(rows: DataFrame) -> DataFrame:
    """(source_row, line): the list as tab-separated lines."""
    return rows.select("source_row", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "\t").alias("line"))

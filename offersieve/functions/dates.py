"""Dates: cells of many spellings, calendar differences, cycles and waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offersieve.functions.text import is_null_token
from offersieve.schema import APPROVING, JOINED, PENDING

_YEAR_FIRST = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$"
_YEAR_FIRST_PARTS = r"^(\d{4})\D(\d{1,2})\D(\d{1,2})\D*$"
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
_SERIAL_TEXT = r"^\d{5}(?:\.\d+)?$"


def make_date_or_null(year: Column, month: Column, day: Column) -> Column:
    """A calendar date, null for one that does not exist."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD and nothing else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def serial_date(serial: Column, date1904: bool = False) -> Column:
    """Spreadsheet day number to date; the 1900 system has a day 60 that never was."""
    days = F.floor(serial).cast("int")
    if date1904:
        return F.when(days >= 0, F.date_add(F.lit("1904-01-01").cast("date"), days))
    base = F.when(days <= 59, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30")).cast("date")
    return F.when((days >= 1) & (days != 60), F.date_add(base, days))


def _found(date: Column, rule: Column | str, confirm: Column | bool, code: Column | str | None, ambiguous: bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(date.alias("date"), lit(rule).alias("rule"), lit(confirm).alias("confirm"), F.lit(ambiguous).alias("ambiguous"), lit(code).cast("string").alias("code"))


def parse_date_cell(text: Column, number: Column | None = None, date1904: bool | None = None, order: str | None = None) -> Column:
    """(date, rule, confirm, ambiguous, code) of a cell's normalised text.

    number: the cell's value if it is a number.  date1904: the workbook's system, None if
    unknown.  order: 'month-first' or 'day-first' for texts like 01/02/2026, None if not confirmed.
    """
    none = F.lit(None).cast("date")
    body = F.coalesce(text, F.lit(""))
    part = lambda pattern, i: F.regexp_extract(body, pattern, i).try_cast("int")
    first = F.regexp_replace(body, _YEAR_FIRST_PARTS, "$1-$2-$3").try_cast("date")  # of what _YEAR_FIRST fits
    a, b, year = (part(_YEAR_LAST, i) for i in (1, 2, 3))
    both_small = (a <= 12) & (b <= 12)
    month_first = F.when(both_small, F.lit(order == "month-first")).otherwise(b > 12)
    last = make_date_or_null(year, F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a))
    system = "1904" if date1904 else "1900"
    suffix = ".assumed1900" if date1904 is None else ""

    def from_serial(value: Column, kind: str, is_text: bool) -> Column:
        date = serial_date(value, bool(date1904))
        found = _found(date, f"date.{kind}Excel{system}{suffix}", date1904 is None or is_text, None)
        return F.when(date.isNull(), _found(none, "date.serialInvalid", True, "INVALID_DATE")).otherwise(found)

    year_last = (
        F.when((a > 12) & (b > 12), _found(none, "date.yearLastInvalid", True, "INVALID_DATE"))
        .when(both_small & F.lit(order is None), _found(none, "date.ambiguousUnconfirmed", True, "DATE_NOT_CONVERTED", True))
        .when(last.isNull(), _found(none, "date.yearLastInvalid", True, "INVALID_DATE"))
        .otherwise(_found(last, F.when(both_small, F.when(month_first, F.lit("date.mdy")).otherwise(F.lit("date.dmy"))).otherwise(F.lit("date.yearLast")), both_small, None))
    )
    out = F.when(number.isNotNull(), from_serial(number, "serial", False)) if number is not None else F
    return (
        out.when(is_null_token(body), _found(none, "date.missing", False, None))
        .when(body.rlike(_YEAR_FIRST), F.when(first.isNull(), _found(none, "date.ymdInvalid", True, "INVALID_DATE")).otherwise(_found(first, "date.ymd", False, None)))
        .when(body.rlike(_YEAR_LAST), year_last)
        .when(body.rlike(_SERIAL_TEXT), from_serial(body.try_cast("double"), "serialText", True))
        .otherwise(_found(none, "date.unparsed", True, "INVALID_DATE"))
    )


def cycle_between(start: Column, end: Column) -> Column:
    """Calendar days, null if a date is missing or the cycle would be negative."""
    days = F.datediff(end, start)
    return F.when(days >= 0, days)


def actual_cycle_days(status: Column, start: Column, join: Column) -> Column:
    return F.when(status == JOINED, cycle_between(start, join))


def planned_cycle_days(status: Column, start: Column, join: Column) -> Column:
    return F.when(status == PENDING, cycle_between(start, join))


def expected_internship_days(join: Column, end: Column) -> Column:
    return cycle_between(join, end)


def waiting(status: Column, start: Column, join: Column, as_of: Column) -> Column:
    """(kind, days): the cycle of those who joined, the wait so far of those pending or in approval, else unknown."""
    actual, current = actual_cycle_days(status, start, join), F.when(status.isin(PENDING, APPROVING), cycle_between(start, as_of))
    kind = F.when(actual.isNotNull(), F.lit("actualCycle")).when(current.isNotNull(), F.lit("currentWaiting")).otherwise(F.lit("unknown"))
    return F.struct(kind.alias("kind"), F.coalesce(actual, current).alias("days"))


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_range(period: Column) -> Column:
    """(from, to) of a YYYY-MM key, null for anything else."""
    first = strict_date(F.concat(period, F.lit("-01")))
    return F.when(first.isNotNull(), F.struct(first.alias("from"), F.last_day(first).alias("to")))

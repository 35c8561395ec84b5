"""Resolvers: a cell's text to a value of a field, with the rule that decided and an issue code.

Each returns a struct (value…, rule, confirm, code) built from when-chains and map
literals, so a whole row resolves inside one projection.  Texts must be
normalised before (functions.text.cell_text, or plain_text of nfkc_cells for a whole row).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from offersieve.functions.numbers import extract_amount
from offersieve.functions.text import header_key_of, is_null_token, plain_key, plain_text
from offersieve.schema import (
    CASH,
    CHANNEL_WORDS,
    CITY_WORDS,
    EDUCATION_WORDS,
    LODGING,
    NO_SUBSIDY,
    OTHER,
    REFERRAL,
    REQUIREMENT_WORDS,
    STATUS_WORDS,
    TARGET_CITIES,
    TRI_STATE_WORDS,
    UNKNOWN,
)

UNKNOWN_ENUM = "UNKNOWN_ENUM_VALUE"


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def _struct(kind: str, value, rule, confirm=False, code=None, **more) -> Column:
    return F.struct(
        _lit(value).cast(kind).alias("value"), *[_lit(v).alias(k) for k, v in more.items()],
        _lit(rule).cast("string").alias("rule"), _lit(confirm).cast("boolean").alias("confirm"), _lit(code).cast("string").alias("code"),
    )


def _words(table: Mapping[str, object]) -> Column:
    keys: dict[str, object] = {}
    for word, value in table.items():
        keys.setdefault(header_key_of(word), value)
    return F.create_map(*[F.lit(x) for k, v in keys.items() for x in (k, v)])


def _from_words(text: Column, table: Mapping[str, object], name: str, missing, unmatched, kind: str = "string", confirm: Column | None = None) -> Column:
    """Dictionary look-up on the key of a normalised text, its lower case."""
    body = F.coalesce(text, F.lit(""))
    hit = _words(table)[F.lower(body)]
    return (
        F.when(is_null_token(body), _struct(kind, missing, f"{name}.missing"))
        .when(hit.isNotNull(), _struct(kind, hit, F.concat(F.lit(f"{name}."), F.lower(body)), F.lit(False) if confirm is None else confirm))
        .otherwise(_struct(kind, unmatched, f"{name}.unrecognized", True, UNKNOWN_ENUM))
    )


def text_value(text: Column, number: Column | None = None, keep_zeros: bool = False) -> Column:
    body = F.coalesce(text, F.lit(""))
    out = F.when(text.isNull(), _struct("string", None, "text.missing"))
    if number is not None:
        out = out.when(number.isNotNull(), _struct("string", text, "text.numericId" if keep_zeros else "text.numeric"))
    return out.when(is_null_token(body), _struct("string", None, "text.nullToken")).otherwise(_struct("string", body, "text.trimmed"))


def school(text: Column, aliases: Sequence[tuple[str, str]] = ()) -> Column:
    body = F.coalesce(text, F.lit(""))
    table: dict[str, str] = {}
    for alias, canonical in aliases:
        table.setdefault(header_key_of(alias), canonical)
    hit = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(body)] if table else F.lit(None).cast("string")
    return (
        F.when(is_null_token(body), _struct("string", None, "school.missing"))
        .when(hit.isNotNull(), _struct("string", plain_text(hit), "school.alias", True))
        .otherwise(_struct("string", body, "school.raw"))
    )


def city(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    hit = _words(CITY_WORDS)[F.lower(body)]
    start = F.coalesce(*[F.when(body.startswith(c), F.lit(c)) for c in TARGET_CITIES])
    return (
        F.when(is_null_token(body), _struct("string", UNKNOWN, "city.missing", raw=F.lit(None).cast("string")))
        .when(hit.isNotNull(), _struct("string", hit, F.concat(F.lit("city."), body), hit != body, raw=body))
        .when(start.isNotNull(), _struct("string", start, "city.prefix", True, raw=body))
        .otherwise(_struct("string", OTHER, "city.unrecognized", True, UNKNOWN_ENUM, raw=body))
    )


def offer_status(text: Column, headers: Sequence[str] = ()) -> Column:
    """A cell that repeats a header is unknown, like anything not in the dictionary."""
    body = F.coalesce(text, F.lit(""))
    echo = F.lower(body).isin(sorted({header_key_of(h) for h in headers})) if headers else F.lit(False)
    found = _from_words(text, STATUS_WORDS, "status", UNKNOWN, UNKNOWN)
    return F.when(echo & ~is_null_token(body), _struct("string", UNKNOWN, "status.headerEcho", True, "HEADER_ECHO_CELL")).otherwise(found)


def channel(text: Column) -> Column:
    return _from_words(text, CHANNEL_WORDS, "channel", UNKNOWN, OTHER)


def referral_type(text: Column, channel_value: Column) -> Column:
    """内推 and HR推 as written; another word that ends in 推 is taken for HR推 and must be confirmed."""
    body = F.coalesce(text, F.lit(""))
    none = F.lit(None).cast("string")

    def found(value: str, rule: str, confirm: bool, review) -> Column:
        return _struct("string", value, rule, confirm, none, review=_lit(review))

    return (
        F.when(is_null_token(body), found(UNKNOWN, "referral.missing", False, False))
        .when(body == REFERRAL, found(REFERRAL, "referral.内推", False, False))
        .when(body == "HR推", found("HR推", "referral.HR推", False, False))
        .when(body.endswith("推"), found("HR推", "referral.hrSuffix", True, True))
        .otherwise(found(UNKNOWN, "referral.unrecognized", False, channel_value == REFERRAL))
    )


def requirement_type(text: Column) -> Column:
    return _from_words(text, REQUIREMENT_WORDS, "requirementType", UNKNOWN, UNKNOWN)


def education(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return _from_words(text, EDUCATION_WORDS, "education", UNKNOWN, UNKNOWN, confirm=_words(EDUCATION_WORDS)[F.lower(body)] != body)


def tri_state(text: Column) -> Column:
    return _from_words(text, TRI_STATE_WORDS, "tristate", None, None, "boolean")


def graduation_year(text: Column) -> Column:
    """The first four digits in a row, from 1900 to 2100."""
    body = F.coalesce(text, F.lit(""))
    digits = F.nullif(F.regexp_extract(body, r"(\d{4})", 1), F.lit(""))
    year = digits.try_cast("int")
    return (
        F.when(is_null_token(body), _struct("int", None, "year.missing"))
        .when(year.between(1900, 2100), _struct("int", year, "year.fourDigit", body != digits))
        .otherwise(_struct("int", None, F.when(digits.isNull(), F.lit("year.unparsed")).otherwise(F.lit("year.outOfRange")), True, "VALUE_RANGE_UNCERTAIN"))
    )


_RANGE = r"(\d[\d,]*(?:\.\d+)?)\s*[~～\-—－至到]\s*(\d[\d,]*(?:\.\d+)?)"


def salary_amount(text: Column) -> Column:
    """A single number; ranges and negative numbers stay unknown."""
    body = F.coalesce(text, F.lit(""))
    amount = extract_amount(body)
    return (
        F.when(is_null_token(body), _struct("double", None, "salary.missing"))
        .when(body.rlike(_RANGE), _struct("double", None, "salary.rangeUnconfirmed", True, "VALUE_RANGE_UNCERTAIN"))
        .when(F.contains(body, F.lit("-")), _struct("double", None, "salary.negativeOrUnparsed", True, "INVALID_SALARY"))
        .when(amount.isNull(), _struct("double", None, "salary.unparsed", True, "INVALID_SALARY"))
        .otherwise(_struct("double", amount, "salary.number"))
    )


def housing(text: Column) -> Column:
    """(value: type, amount, period, reason, rule, confirm, code). Lodging is never turned into money."""
    body = F.coalesce(text, F.lit(""))
    period = F.when(F.contains(body, F.lit("月")), F.lit("月")).when(body.rlike("[天日]"), F.lit("天")).when(F.contains(body, F.lit("次")), F.lit("次"))
    lodging, cash = body.rlike("住宿|宿舍|公寓"), body.rlike("元|¥|￥|RMB|人民币")
    amount = extract_amount(body)
    reason = F.when(F.contains(body, F.lit("本地")), F.lit("本地院校")).when(F.contains(body, F.lit("外地")), F.lit("非本地 / 外地"))
    no, text_none = F.lit(None).cast("double"), F.lit(None).cast("string")

    def found(kind: str, value: Column, when: Column, why: Column, rule, confirm=False, code=None) -> Column:
        return _struct("string", kind, rule, confirm, code, amount=value, period=when, reason=why)

    return (
        F.when(is_null_token(body), found(UNKNOWN, no, text_none, text_none, "housing.missing"))
        .when(body.rlike("无|没有") & ~lodging, found(NO_SUBSIDY, F.lit(0.0), text_none, reason, "housing.noSubsidy"))
        .when(lodging & cash, found(LODGING, no, period, text_none, "housing.accommodationCashConflict", True, "HOUSING_VALUE_UNCERTAIN"))
        .when(lodging, found(LODGING, no, period, text_none, "housing.accommodation"))
        .when(cash & amount.isNull(), found(CASH, no, period, text_none, "housing.cashAmountUnparsed", True, "INVALID_SALARY"))
        .when(cash, found(CASH, amount, period, text_none, "housing.cash"))
        .otherwise(found(UNKNOWN, no, period, text_none, "housing.unrecognized", True, UNKNOWN_ENUM))
    )


def gpt_school(text: Column, school_value: Column, gpt_list: Sequence[str] = (), list_mode: bool = False, complete: bool = False) -> Column:
    """(value, source, conflict): the cell first; in list mode the local list fills what is missing and never overrides."""
    own = tri_state(text)["value"]
    keys = sorted({header_key_of(s) for s in gpt_list} - {""})
    listed = F.when(school_value.isNotNull(), plain_key(school_value).isin(keys)) if keys else F.lit(None).cast("boolean")
    use = F.lit(list_mode)
    filled = F.when(use & listed, True).when(use & ~listed & F.lit(complete), False)
    value = F.coalesce(own, filled)
    source = F.when(own.isNotNull(), F.lit("aliasTable")).when(filled.isNotNull(), F.lit("localList")).otherwise(F.lit("unknown"))
    return F.struct(value.alias("value"), source.alias("source"), F.coalesce(use & listed & ~own, F.lit(False)).alias("conflict"))

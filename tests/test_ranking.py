"""Ranks and pages over ranges; small functions; decisions and their effects."""

import dataclasses
import os
import random

import pytest
from pyspark.sql import functions as F

from offersieve.functions import numbers, text
from offersieve.operators import cleaning, decisions, mapping, quality, ranking
from offersieve.operators.filters import Filters
from offersieve.sources import sheets
from tests.test_analytics import records
from tests.test_cells import row, tsv


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 1.0, 2.0, 2.0, 2.0, float(rng.randint(0, 50))]), rng.choice("abc"), 0) for i in range(500)]
    return spark.createDataFrame(rows, "id int, v double, k string, _range int").repartition(6)


def test_ranks_of_many_ranges(spark, table):
    order = [F.desc_nulls_last("v"), F.asc("k"), F.asc("id")]
    want = [r.id for r in sorted(table.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.k, r.id))]
    for n in (1, 5, 40):
        got = ranking.ranked_by(table, order, ranges=n)
        assert got.columns == [*table.columns, "rank"] and [r.id for r in got.orderBy("rank").collect()] == want and got.agg(F.max("rank")).first()[0] == 500
    assert ranking.ranked_by(table, order, "K").columns == ["id", "v", "_range", "K"]
    assert ranking.ranked_by(table.where("false"), order).count() == 0
    pages = ranking.paged(table, order, 30)
    assert pages.n_pages == 17 and [r.id for r in pages.page(17).orderBy("rank").collect()] == want[480:] and pages.page(18).count() == 0
    # Nothing goes through one task but the list of ranges.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_pages_by_key(table):
    rows = table.where("v is not null")
    want = [r.id for r in sorted(rows.collect(), key=lambda r: (-r.v, r.id))]
    got, last = [], None
    while page := ranking.after(rows, ["-v", "id"], last, 90).collect():
        got += [r.id for r in page]
        last = (page[-1].v, page[-1].id)
    assert got == want


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(text.tri_state_of(F.lit(x))) for x in ("是", "否", "未知", None)] == [True, False, None, None]
    assert value(numbers.highest_cost(F.lit(3_000_000), F.lit(500_000.4), 2.0, 8.0)) == pytest.approx(8.0) and value(numbers.highest_cost(F.lit(-1), F.lit(-5), 2.0, 8.0)) == 0
    assert value(numbers.cost_text(F.lit(0.00001))) == "< 0.0001 元" and value(numbers.cost_text(F.lit(1.23456))) == "1.2346 元"
    assert [value(numbers.salary_band_of_label(F.lit(x), (100, 200))) for x in ("<100", "100–199", "≥200", "150", None)] == ["<100", "100–199", "≥200", None, None]
    assert not Filters().active() and not Filters({"city": []}).active() and Filters({"city": ["上海"]}).active() and Filters(date_to="2026-01-01").active() and Filters(statuses=("其他",)).active()


def test_reasons_of_availability(spark):
    d = records(spark, [{"offer_status": "已入职", "city": "上海"}])
    issues = spark.createDataFrame([("SALARY_UNIT_UNCONFIRMED",)], "code string")
    got = {r.module: r for r in quality.availability(d, issues, "未确认").collect()}
    assert not got["薪资对比"].available and "未确认" in got["薪资对比"].reason
    assert any(r.available for r in got.values()) and all(r.reason for r in got.values() if not r.available)


# ---------------------------------------------------------------- decisions
ROWS = [
    {"recruitmentStartDate": "01/02/2026", "joiningDate": "03/02/2026", "school": "甲大", "salaryAmount": "4000"}, {"school": "甲大学", "isGptSchool": "否", "referrer": "内推"},
    {"recruitmentStartDate": "2025-01-01", "joiningDate": "2026-01-01", "candidateName": "乙", "school": "丙大学"}, {}, {}, {"candidateName": "丁", "referrer": "内推", "channel": "Boss"},
    {"recruitmentStartDate": "02/01/2026", "candidateName": "甲", "requirementId": "007"}, {"recruitmentStartDate": "01/02/2026", "candidateName": "甲", "requirementId": "007", "city": "上海"},
]
CHANGES = {
    "as_of": "2026-06-01", "salary_option": "暂不确定", "date_order": "month-first", "dedup_confirmed": True, "gpt_list": ("丙大学",), "gpt_list_mode": False, "gpt_list_complete": True,
    "school_aliases": (("甲大", "甲大学"),), "cycle_too_long_days": 400, "channel_from_referrer": True, "include_hidden": False, "dedup_strategy": "保留全部", "drop_header_echo": True,
}
#: All changes take minutes: each is two runs of the whole cleaning and two of its part.
FULL = bool(os.environ.get("ALL_CHANGES"))


@pytest.fixture(scope="module")
def sheet(spark):
    one = sheets.shape(sheets.read_pasted(spark, tsv([row(**r) for r in ROWS])))
    m, _ = mapping.decide(mapping.suggest(one.headers), mapping.Decisions(), "2026-01-01")
    return one.rows.withColumn("hidden", F.col("source_row") == 4), m


def test_effects_equal_full_runs(spark, sheet):
    rows, m = sheet
    base = cleaning.Settings("2026-05-08", gpt_list=("甲大学",), gpt_list_mode=True)
    every = [(base, name, value) for name, value in CHANGES.items()]
    every = every if FULL else random.Random(len(ROWS)).sample(every, 0) + [(base, "date_order", "day-first")]
    for before, name, value in every:
        after = dataclasses.replace(before, **{name: value})
        old, new = ({r.record_id: r.asDict() for r in cleaning.clean(rows, m, s).records.collect()} for s in (before, after))
        want = {}
        for i in old.keys() & new.keys():
            for c in old[i]:
                if old[i][c] != new[i][c]:
                    want[c] = want.get(c, 0) + 1
        want |= {k: n for k, n in (("+", len(new.keys() - old.keys())), ("-", len(old.keys() - new.keys()))) if n}
        assert {r.field: r.n for r in decisions.effects(rows, m, before, after).collect()} == want, (name, before, after)
        assert set(want) - {"+", "-"} <= set(decisions.DEPENDS[name])
    assert decisions.effects(rows, m, before, before).count() == 0


def test_decision_log(sheet):
    rows, m = sheet
    s = cleaning.Settings("2026-05-08", dedup_confirmed=True, school_aliases=(("甲大", "甲大学"),), gpt_list=("甲大学",), gpt_list_mode=True, channel_from_referrer=True)
    cleaned = cleaning.clean(rows, m, s)
    log = {r.id: r for r in decisions.decision_log(cleaned).collect()}
    assert len(log) == 11 and log["asOf"].n_records == cleaned.records.count() == 5 == log["dedup"].n_records and log["schoolAliases"].n_records == 1 and log["channel"].n_records == 1 and log["hiddenRows"].n_records == 1
    assert log["dedup"].n_records >= 2 and log["dedup"].confirmed and not log["dateOrder"].confirmed and log["salary"].n_records == 1 and log["cycleTooLong"].n_records == 1
    assert {(r.source_row, r.value) for r in decisions.last_value(cleaned.lineage.where("field = 'school'")).collect()} >= {(2, "甲大学"), (4, "丙大学")}

"""Golden values and invariants of the analytics operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from offersieve.operators import benchmarks, compensation, grouping, metrics, rejection
from offersieve.operators.filters import Filters, apply_filters, filter_counters
from offersieve.schema import RECORD

D = dt.date


def records(spark, rows):
    names = [f.name for f in RECORD.fields]
    base = dict.fromkeys(names) | {"city": "未知", "channel": "未知", "referral_type": "未知", "requirement_type": "未知", "education": "未知", "housing_type": "未知", "offer_status": "未知", "dedup_action": "kept"}
    return spark.createDataFrame([tuple((base | {"record_id": str(i), "source_row": i + 2} | r)[n] for n in names) for i, r in enumerate(rows)], RECORD)


@pytest.fixture(scope="module")
def six(spark):
    a = D(2026, 1, 1)
    return records(spark, [
        {"offer_status": "已入职", "start_date": a, "join_date": D(2026, 1, 11), "city": "上海"}, {"offer_status": "已入职", "start_date": a, "join_date": D(2026, 1, 21), "city": "上海"},
        {"offer_status": "待入职", "city": "广州"}, {"offer_status": "offer审批中", "city": "广州"}, {"offer_status": "拒绝offer"},
        {"offer_status": "拒绝口头offer", "rejection_reason": "薪酬"},
    ])


def test_six_records(six):
    r = metrics.summarize(six).first()
    assert (r.n_total, r.n_joined, r.n_pending, r.n_approving, r.n_rejected, r.n_core) == (6, 2, 1, 1, 2, 5)
    assert (r.acceptance_rate, r.joined_rate, r.rejection_rate, r.pending_core_share) == (0.6, 0.4, 0.4, 0.2)
    assert round(r.approving_share, 4) == 0.1667 and r.actual_mean == 15 and r.reason_fill_rate == 0.5


def test_other_status_does_not_touch_core(spark, six):
    r = metrics.summarize(six.union(records(spark, [{"offer_status": "其他"}]))).first()
    assert (r.n_total, r.n_core) == (7, 5)
    assert metrics.identity_holds(six.agg(*metrics.status_counts())).first().identity_holds


def test_empty_table_has_null_rates(spark):
    r = metrics.summarize(records(spark, [])).first()
    assert r.n_total == 0 and r.rejection_rate is None and r.actual_mean is None
    assert metrics.status_composition(records(spark, [])).where("share is null").count() == 7


def test_composition_is_complete(six):
    rows = metrics.status_composition(six).collect()
    assert len(rows) == 7 and sum(r.n for r in rows) == 6


def salaries(spark, amounts):
    return records(spark, [{"salary_amount": float(x), "city": "上海", "position": "p", "job_family": "f", "currency": "CNY", "salary_unit": "元/月"} for x in amounts])


def test_salary_benchmark(spark):
    five = salaries(spark, [3500, 4000, 4000, 4500, 5000])
    b = benchmarks.build(five).first()
    assert (b.n, b.p25, b.p50, b.p75, b.sufficient) == (5, 4000, 4000, 4500, True)
    ranks = {r.amount: round(r["rank"], 6) for r in benchmarks.ranks(five).collect()}
    assert ranks == {3500: 0.1, 4000: 0.4, 4500: 0.7, 5000: 0.9}
    below = benchmarks.decorate(five, five).where("below_median").collect()
    assert [r.salary_amount for r in below] == [3500]
    four = benchmarks.build(salaries(spark, [3500, 4000, 4000, 4500])).first()
    assert four.p50 is None and not four.sufficient


def test_rank_against_other_reference(spark):
    got = benchmarks.ranks_of(salaries(spark, [4200, 1]), salaries(spark, [3500, 4000, 4000, 4500])).orderBy("salary_amount").collect()
    assert [r.percentile_rank for r in got] == [0.0, 0.75]


def test_unspecific_key_is_no_benchmark(spark):
    odd = records(spark, [{"salary_amount": 1.0, "city": "其他", "position": "p", "job_family": "f", "currency": "CNY", "salary_unit": "元/月"}])
    assert benchmarks.build(odd).count() == 0


def test_cross_table_is_dense_and_sums_up(six):
    table = grouping.cross_table(six, "city", "offer_status", metrics.status_counts()).collect()
    cells = [r for r in table if r.row_key is not None and r.column_key is not None]
    assert len(cells) == 3 * 5 and sum(r.n_total for r in cells) == 6
    assert next(r for r in table if r.row_key is None and r.column_key is None).n_core == 5


def test_top_n_merges_from_records(six):
    rows = {r.key: r for r in grouping.top_with_other(six, "city", 1).collect()}
    merged = rows["其他（2 个分组合并）"]
    assert merged.is_merged and merged.n_total == 4 and merged.n_core == 3 and merged.rejection_rate == pytest.approx(2 / 3)
    assert grouping.top_with_other(six, "city", 3).where("is_merged").count() == 0


def test_timeline_counts_missing_dates(six):
    rows = {r.key: r.n_total for r in grouping.aggregate_by_month(six).collect()}
    assert rows == {"2026-01": 2, None: 4}


def test_facets_put_unknown_last(six):
    assert [r.key for r in grouping.facets(six, "city").orderBy("position").collect()][-1] == "未知"


def test_filters_and_counters(spark, six):
    f = Filters({"city": ["上海", "未知"]}, ("已入职", "拒绝offer"), date_from="2026-01-01", include_missing_date=True)
    assert apply_filters(six, f).count() == 3
    c = filter_counters(six, f).first()
    assert (c.n_retained, c.n_after_dimensions, c.n_excluded_status, c.n_missing_date, c.n_kept) == (6, 4, 1, 1, 3)
    assert apply_filters(six, Filters(date_from="not a date")).count() == 2
    assert Filters(date_from="2026-02-30").issues()


def test_total_cash(spark):
    rows = records(spark, [
        {"salary_amount": 4000.0, "housing_type": "无补贴"}, {"salary_amount": 4000.0, "housing_type": "现金房补", "housing_amount": 500.0, "housing_period": "月", "salary_unit": "元/月"},
        {"salary_amount": 4000.0, "housing_type": "现金房补", "housing_amount": 500.0, "housing_period": "天", "salary_unit": "元/月"}, {"salary_amount": 4000.0, "housing_type": "提供住宿"},
        {"housing_type": "现金房补", "housing_amount": -1.0},
    ])
    got = [r.t for r in rows.orderBy("source_row").select(compensation.total_cash().alias("t")).collect()]
    assert [t.total for t in got] == [4000, 4500, None, None, None] and [t.alignable for t in got] == [True, True, False, False, False]


def test_histogram_bins(spark):
    few = compensation.histogram(salaries(spark, [1, 1, 2, 3, 3])).orderBy("bin").collect()
    assert [(r.low, r.high, r.n) for r in few] == [(1, None, 2), (2, None, 1), (3, None, 2)]
    many = compensation.histogram(salaries(spark, range(17))).orderBy("bin").collect()
    assert [r.n for r in many] == [2] * 7 + [3] and many[-1].high == 16


def test_reasons(spark):
    rows = records(spark, [{"offer_status": "拒绝offer", "rejection_reason": r} for r in (None, " ", "其他 Offer", "薪酬太低所以去了别家", "房补")] + [{"offer_status": "已入职", "rejection_reason": "薪酬"}])
    got = {r.category: r.n for r in rejection.reason_distribution(rows).where("n > 0").collect()}
    assert got == {"未填写": 2, "其他offer": 1, "未分类": 1, "住房/住宿": 1}
    assert rejection.reason_summary(rows).first().fill_rate == 0.6
    assert rejection.unclassified_samples(rows).first().sample == "薪酬太低所以去了别家"


def test_rules(spark):
    rows = [{"offer_status": "拒绝offer", "housing_type": "无补贴"}] * 8 + [{"offer_status": "已入职", "housing_type": "无补贴"}] * 1 + [{"offer_status": "待入职", "housing_type": "无补贴"}] * 3
    rows += [{"offer_status": "已入职", "housing_type": "提供住宿"}] * 10 + [{"offer_status": "已入职", "housing_type": "未知"}] * 2
    d = records(spark, rows)
    got = {r.rule_id: r for r in rejection.evaluate_rules(rejection.with_conditions(benchmarks.decorate(d, d), "2026-05-01")).collect()}
    r = got["R-NOSUB"]
    assert (r.n_hit, r.n_core, r.level, r.n_unknown, r.n_unmet) == (9, 12, "observed", 2, 10)
    assert r.gap == pytest.approx(33.33) and got["R-LOWPAY-WAIT"].level == "insufficient"
    assert rejection.conclusions(rejection.evaluate_rules(rejection.with_conditions(benchmarks.decorate(d, d), "2026-05-01"))).where("rule_id = 'R-NOSUB'").first().conclusion.startswith("观察到")
    with pytest.raises(ValueError):
        rejection.Rule("x", "y", (), "z")


def test_group_rates_are_ratio_of_sums(six):
    by = grouping.aggregate_by(six, "city").agg(F.sum("n_rejected") / F.sum("n_core")).first()[0]
    assert by == metrics.summarize(six).first().rejection_rate


def test_bundle_counts_requirements_once_and_blanks_apart(spark):
    a = D(2026, 1, 1)
    rows = [
        {"city": "上海", "requirement_id": "R1", "offer_status": "已入职", "start_date": a, "join_date": D(2026, 1, 3)}, {"city": "上海", "requirement_id": " R1 ", "offer_status": "已入职", "start_date": a, "join_date": D(2026, 1, 3)},
        {"city": "上海", "requirement_id": "R2", "offer_status": "已入职", "start_date": a, "join_date": D(2026, 1, 11)}, {"city": "上海", "requirement_id": " "}, {"city": None, "requirement_id": None},
    ]
    d = records(spark, rows)
    got = {r.key: r for r in metrics.bundled(d, key=F.col("city")).collect()}
    assert (got["上海"].n_total, got["上海"].n_requirements, got["上海"].n_requirement_missing) == (4, 2, 1)
    assert (got["上海"].actual_n, got["上海"].actual_excluded, got["上海"].actual_p25, got["上海"].actual_median, got["上海"].actual_p75) == (3, 1, 2, 2, 6)
    assert round(got["上海"].actual_mean, 6) == round(14 / 3, 6)
    assert (got[None].n_total, got[None].n_requirements, got[None].n_requirement_missing, got[None].actual_mean) == (1, 0, 1, None)
    empty = metrics.summarize(records(spark, [])).first()
    assert (empty.n_total, empty.n_requirements, empty.actual_n, empty.rejection_rate) == (0, 0, 0, None)
    assert grouping.covers_all(grouping.aggregate_by_month(d), d).first().asDict() == {"n_grouped": 5, "n_records": 5, "covers_all": True}
    assert grouping.with_cycles(grouping.aggregate_by(d, "city")).count() == 1


def test_top_takes_all_groups_when_they_are_few_or_none_are_asked_for(spark):
    d = records(spark, [{"position": p} for p in "aaabbc"] + [{"position": None}])
    keys = lambda n: {r.key: r.n_total for r in grouping.top_with_other(d, "position", n).collect()}
    assert keys(0) == keys(4) == {"a": 3, "b": 2, "c": 1, "未知": 1}
    assert keys(1) == {"a": 3, "其他（3 个分组合并）": 4}
    assert {r.key: r.position for r in grouping.facets(d, "position").collect()} == {"a": 1, "b": 2, "c": 3, "未知": 4}


def test_histogram_notes_and_unsplit(spark):
    pay = lambda unit, amounts: [{"salary_unit": unit, "salary_amount": float(x)} for x in amounts]
    d = records(spark, pay("元/月", range(1, 20)) + pay("元/天", [1, 1, 2, 2, 3]) + pay(None, [1]) + [{"requirement_type": "替补替换未拆分"}])
    got = {r.unit: (r.binning, r.n_values, r.n_bins) for r in compensation.histogram_notes(d).collect()}
    assert got == {"元/月": ("equalWidths", 19, 8), "元/天": ("singleValues", 3, 3), None: ("tooFew", 1, 0)}
    assert grouping.n_unsplit(d).first()[0] == 1


def test_decoration_with_another_reference(spark):
    pay = lambda amounts: records(spark, [{"city": "上海", "job_family": "f", "position": "p", "currency": "CNY", "salary_unit": "元/月", "salary_amount": x} for x in amounts])
    got = benchmarks.decorate(pay([2.5, None]), pay([1.0, 2.0, 3.0, 4.0, 5.0])).orderBy(F.desc("salary_amount")).collect()
    assert [(r.benchmark_n, r.benchmark_p50, r.percentile_rank, r.below_median) for r in got] == [(5, 3.0, 0.4, True), (5, 3.0, None, None)]
    none = benchmarks.decorate(pay([2.5]), pay([]))
    assert [(r.benchmark_n, r.benchmark_p50, r.percentile_rank, r.below_median) for r in none.collect()] == [(None, None, None, None)]

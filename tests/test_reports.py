"""Suppression, reports, payloads, streams, registered queries."""

import datetime as dt
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from offersieve.operators import metrics, rejection
from offersieve.plans import privacy, report, scan
from offersieve.schema import RECORD
from offersieve.streaming.live import live_counts
from tests.test_analytics import records


def groups(spark, sizes, **more):
    rows = [{"city": c, "offer_status": "拒绝offer" if i % 2 else "已入职", **more} for c, n in sizes.items() for i in range(n)]
    return records(spark, rows)


def test_small_groups_merge_and_one_more_is_hidden(spark):
    rows = {r.label: r for r in privacy.dimension_table(groups(spark, {"上海": 20, "广州": 12, "杭州": 3}), "city").collect()}
    assert rows["上海"].n_total == 20 and rows["上海"].rejection_rate == 0.5
    hidden = next(r for r in rows.values() if r.suppressed)
    assert hidden.is_merged and hidden.n_total == 0 and hidden.rejection_rate is None
    assert not any("杭州" in k for k in rows)


def test_single_group_is_hidden(spark):
    (r,) = privacy.dimension_table(groups(spark, {"上海": 20}), "city").collect()
    assert r.suppressed and r.n_total == 0


def test_merged_row_is_aggregated_from_records(spark):
    d = groups(spark, {"a": 30, "b": 20, "c": 4, "d": 4})
    merged = privacy.dimension_table(d, "city").where("is_merged").first()
    assert merged.n_total == 8 and merged.n_rejected == 4
    assert privacy.dimension_table(d, "city", privacy.Rules(compat=True)).where("is_merged").first().n_rejected == 0


def test_recruiters_get_codes_and_strict_labels_vanish(spark):
    d = records(spark, [{"recruiter": r, "offer_status": "已入职", "city": "上海"} for r in ("甲", "乙", "丙") for _ in range(11)])
    assert {r.code for r in privacy.dimension_table(d, "recruiter").collect()} == {"HR-1", "HR-2", "HR-3"}
    assert not any("甲" in r.label for r in privacy.dimension_table(d, "recruiter").collect())
    assert all(r.label.startswith("分组") for r in privacy.dimension_table(groups(spark, {"a": 30, "b": 30, "c": 30}), "city", privacy.STRICT).collect())


def test_complementary_needs_a_remainder(spark):
    table = lambda n: spark.createDataFrame([(str(i), i + 1, i, i == 0) for i in range(n)], "key string, n_total long, n_core long, suppressed boolean")
    assert [r.key for r in privacy.complementary(table(3)).where("suppressed").orderBy("key").collect()] == ["0", "1"]
    assert privacy.complementary(table(2)).where("suppressed").count() == 1


def test_report_gate_and_sinks(spark):
    d = groups(spark, {"上海": 20, "广州": 12, "杭州": 8}, recruiter="王五", start_date=dt.date(2026, 1, 1), join_date=dt.date(2026, 1, 20))
    r = report.build(d, "2026-05-08")
    assert report.gate(r, ["王五"]) == [] and report.gate(r, ["上海"]) != []
    text = report.markdown(r)
    assert text.startswith("# 实习生招聘复盘报告") and "| 上海 |" in text and "王五" not in report.print_html(r)
    assert report.xlsx(r)[:2] == b"PK" and report.file_name(r, "md") == "实习生招聘复盘报告-20260508.md" and not report.name_is_safe("王五.md", ["王五"])
    assert r.row_counts()["城市"] == 3 and len(r.preview(5)) == 5
    assert "城市" not in report.build(d, "2026-05-08", privacy.STRICT).row_counts()


def test_scan_and_payload(spark):
    keys, hits = privacy.scan({"a": [{"candidate_name": "x", "note": "见 ABC 文"}], "房补": 1}, ["abc"])
    assert keys == ["a[0].candidate_name", "房补"] and hits == ["a[0].note"]
    deep = {"cells": [{"rows": 1}], "rejectionReasons": [], "deep": {"cells": [], "x": [{"rejectionReasons": "R"}]}}
    assert privacy.scan(deep)[0] == ["cells", "cells[0].rows", "deep.cells", "deep.x[0].rejectionReasons", "rejectionReasons"]
    assert privacy.scan(deep, exempt=privacy.PAYLOAD_PATHS)[0] == ["cells[0].rows", "deep.cells", "deep.x[0].rejectionReasons"]
    assert privacy.forbidden_names("thecandidatenamefield") and not privacy.forbidden_names("city")
    d = groups(spark, {"上海": 20, "广州": 12, "R-1": 9, "小": 2})
    cells = privacy.summary_cells(d)
    assert {r.key for r in cells.where("dimension = 'city'").collect()} == {"上海", "广州"}
    reasons = spark.createDataFrame([(0, "薪酬", 6), (1, "地点", 2)], "position int, category string, n long")
    body = privacy.payload(cells, reasons)
    assert privacy.check_payload(body) == [] and body["rejectionReasons"] == [{"category": "薪酬", "n": 6}] and json.dumps(body, ensure_ascii=False)
    least = privacy.payload(cells, reasons, budget=10)
    assert least["cells"] == [] == least["rejectionReasons"] and least["omitted"][0] == "salary_band" and least["omitted"][-1] == "city"
    assert privacy.check_payload({"rows": 1}) == ["rows"]
    assert privacy.category_rules([("数据 分析", "数据类"), ("数据分析", "x"), ("y", "ABC-1"), ("", "z")]) == {"数据分析": "数据类"}


def test_stream_agrees_with_batch(spark, tmp_path):
    d = groups(spark, {"上海": 20, "广州": 12}).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("source_row") * 100_000))
    late = d.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_900_000_000)))  # closes all windows before it
    d.write.parquet(str(tmp_path / "in"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 50).parquet(str(tmp_path / "in"))
    q = live_counts(stream, keys=("city",)).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = d.groupBy(F.window("ts", "30 days").alias("w"), "city").agg(*metrics.status_counts())
    want = {(r.w.start, r.city): (r.n_total, r.n_core) for r in batch.collect()}
    got = {(r.window_start, r.city): (r.n_total, r.n_core) for r in spark.table("live").collect()}
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f.name for f in RECORD.fields} >= {"offer_status", "start_date"}


@pytest.mark.parametrize("name", ["rejection_by_city", "cross_table", "rejection_rules", "duplicates", "suppressed_schools", "date_cells"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    value = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    rows = lambda rs: sorted(repr([value(v) for v in r]) for r in rs)
    assert rows(got.select(*columns).collect()) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_few_rejections_hide_the_reasons(spark):
    base = [{"offer_status": "已入职"}] * 20
    for n, hidden in ((0, False), (2, True), (12, False)):
        d = records(spark, base + [{"offer_status": "拒绝offer", "rejection_reason": "薪资"}] * n)
        rows = report.reason_table(d, privacy.Rules(suppress_below=10)).collect()
        assert all(r.suppressed == hidden for r in rows) and (not hidden or all(r.n == 0 and r.share is None for r in rows))
        assert sum(r.n for r in rows) == (0 if hidden else n)


def test_forbidden_keys():
    for name in ("salaryRaw", "rejectionReason", "reason_text", "sourceRow", "RAW-VALUE", "rows", "wechat", "需求ID", "myCandidateNames", "x姓名"):
        assert privacy.forbidden_names(name), name
    for name in ("category", "growth", "rowsum", "valuesOf", "n"):
        assert not privacy.forbidden_names(name), name


def test_payload_drops_parts_in_order(spark):
    dims = [*privacy.DROPPED[:3], "city"]
    cells = spark.createDataFrame([(d, f"{d}{i}", 9, 1, 1, 1, 1, 9) for d in dims for i in range(5)], "dimension string, key string, N long, J long, P long, A long, R long, D long")
    reasons = spark.createDataFrame([("薪资", 8, 1)], "category string, n long, position int")
    whole = privacy.payload(cells, reasons, budget=10**6)
    size = len(json.dumps(whole, ensure_ascii=False).encode())
    assert whole["omitted"] == [] and len(whole["cells"]) == 20
    less = privacy.payload(cells, reasons, budget=size - 1)
    assert less["omitted"] == [privacy.DROPPED[0]] and len(less["cells"]) == 15 and less["rejectionReasons"]
    none = privacy.payload(cells, reasons, budget=1)
    assert none["cells"] == [] and none["omitted"] == list(privacy.DROPPED)


def test_advice_by_level(spark):
    def told(levels, **now):
        state = {"n_rejected": 4, "fill_rate": 0.9, "n_unclassified": 0, "n_total": 50, "n_approving": 1, "n_waiting_too_long": 0} | now
        evaluated = spark.createDataFrame([(r.id, level) for r, level in zip(rejection.DEFAULT_RULES, levels, strict=True)], "rule_id string, level string")
        one = spark.createDataFrame([tuple(state.values())], ", ".join(f"{k} {'double' if k == 'fill_rate' else 'long'}" for k in state))
        return [i for i, _ in rejection.advice(evaluated, one, one, one)]

    assert told(["description", "insufficient", "insufficient", "insufficient"]) == ["noSubsidy", "smallSample"]
    assert told(["insufficient", "insufficient", "insufficient", "observed"]) == ["lowPay", "longWaiting"]
    assert told(["insufficient"] * 4, n_rejected=0, fill_rate=None, n_total=0) == ["smallSample"]
    assert told(["none"] * 4, fill_rate=0.1, n_unclassified=3, n_approving=20, n_waiting_too_long=1) == ["reasonMissing", "approvalBacklog", "longWaiting"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_sentinels_are_found_as_a_loop_finds_them(spark, block_bytes):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abAB é"), rng.integers(1, 7))) for _ in range(120)] + [None, "", "  ", "ab", " AB ", "É"]
    texts = [(i, "".join(rng.choice(list("abAB éx"), rng.integers(0, 60))), "s") for i in range(80)] + [(1, None, "s"), (1, "", "s"), (2, "ab" * 50_000, "s"), (2, "ab" * 50_000, "s")]
    frame = spark.createDataFrame(texts, "id int, text string, sentinel string").repartition(5)
    values = spark.createDataFrame([(w,) for w in words], "value string")
    clean = {w.strip(" ").lower() for w in words if w} - {""}
    want = Counter((i, sum(w in (t or "").lower() for w in clean)) for i, t, _ in texts)
    assert Counter((r.id, r.n_sentinels) for r in scan.sentinel_counts(frame, values, block_bytes=block_bytes).collect()) == want
    rows = scan.rows_with_sentinels(frame, values, block_bytes=block_bytes)
    assert rows.columns == frame.columns and rows.count() == sum(n for (_, k), n in want.items() if k)
    hits = scan.sentinel_hits(frame.drop("sentinel"), values, block_bytes=block_bytes)
    assert Counter((r.id, r.sentinel) for r in hits.collect()) == Counter((i, w) for i, t, _ in texts for w in clean if w in (t or "").lower())
    assert scan.sentinel_counts(frame, values.where("false")).where("n_sentinels > 0").count() == 0 and scan.sentinel_hits(frame, values.where("false")).count() == 0


def test_many_sentinels_need_no_nested_loop(spark):
    values = spark.range(100_000).select(F.concat(F.lit("Person "), F.col("id").cast("string"), F.lit("!")).alias("value"))
    texts = spark.range(0, 300_000, 1000).select("id", F.concat(F.lit("seen: person "), F.col("id").cast("string"), F.lit("!")).alias("text"))
    rows = scan.rows_with_sentinels(texts, values)
    assert {r.id for r in rows.collect()} == set(range(0, 100_000, 1000))
    assert "NestedLoop" not in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("filter_bits", [1 << 29, 1 << 10])
def test_long_lists_of_sentinels_take_one_pass(spark, filter_bits):
    """However many bytes sentinels have; a full filter, spans that repeat and spans across pieces of a long text change nothing."""
    words = [f"Person {i}é!" for i in range(4000)] + ["e", "é", "person", "x" * 70, "ab" * 40]
    values = spark.createDataFrame([(w,) for w in words], "value string")
    long = "ab" * 32_760 + "person 17é! Person 3999é!" + "é" * 90_000 + "person 18é" + "x" * 69
    texts = [(1, long), (1, long), (2, "person 1é"), (3, "!person 12é!person 12é!"), (4, None), (5, ""), (6, "x" * 71)] + [(i, f"seen: PERSON {i}É!") for i in range(10, 60)]
    frame = spark.createDataFrame(texts, "id int, text string").repartition(3)
    want = Counter((i, w.lower()) for i, t in texts for w in words if w.lower() in (t or "").lower())
    counted = scan.sentinel_counts(frame, values, block_bytes=300, filter_bits=filter_bits)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("EvalPython") == 1
    assert Counter({r.id: r.n_sentinels for r in counted.where("id > 1").collect()}) == Counter({i: sum(n for (k, _), n in want.items() if k == i) for i, _ in texts if i > 1})
    assert [r.n_sentinels for r in counted.where("id = 1").collect()] == [sum(n for (k, _), n in want.items() if k == 1) // 2] * 2
    hits = scan.sentinel_hits(frame, values, block_bytes=300, filter_bits=filter_bits)
    assert hits.columns == ["id", "text", "sentinel"] and Counter((r.id, r.sentinel) for r in hits.collect()) == want

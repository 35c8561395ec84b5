"""Cells, dates, dictionaries, mapping, sources, cleaning."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from offersieve.functions import numbers, resolve, text
from offersieve.functions.dates import parse_date_cell
from offersieve.operators import cleaning, mapping
from offersieve.schema import STANDARD_FIELDS
from offersieve.sources import sheets, sniff, vault


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if k == 'n' else 'string'}" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("cell", "order", "date", "rule"),
    [
        ("2026-05-08", None, dt.date(2026, 5, 8), "date.ymd"), ("2026年5月8日", None, dt.date(2026, 5, 8), "date.ymd"), ("２０２６/5/8", None, dt.date(2026, 5, 8), "date.ymd"),
        ("2026-02-30", None, None, "date.ymdInvalid"), ("13/02/2026", None, dt.date(2026, 2, 13), "date.yearLast"), ("01/02/2026", None, None, "date.ambiguousUnconfirmed"),
        ("01/02/2026", "month-first", dt.date(2026, 1, 2), "date.mdy"), ("01/02/2026", "day-first", dt.date(2026, 2, 1), "date.dmy"), ("13/13/2026", None, None, "date.yearLastInvalid"),
        ("46150", None, dt.date(2026, 5, 8), "date.serialTextExcel1900.assumed1900"), ("N/A", None, None, "date.missing"), ("soon", None, None, "date.unparsed"), (None, None, None, "date.missing"),
    ],
)
def test_date_cells(spark, cell, order, date, rule):
    got = one(spark, parse_date_cell(text.cell_text(F.col("c")), None, None, order), c=cell)
    assert (got.date, got.rule) == (date, rule)


@pytest.mark.parametrize(("serial", "d1904", "date"), [(59.0, False, dt.date(1900, 2, 28)), (60.0, False, None), (61.9, False, dt.date(1900, 3, 1)), (0.0, True, dt.date(1904, 1, 1)), (0.5, False, None)])
def test_serial_dates(spark, serial, d1904, date):
    assert one(spark, parse_date_cell(F.col("c"), F.col("n"), d1904), c=str(serial), n=serial).date == date


def test_texts(spark):
    got = one(spark, text.cell_text(F.col("c")), c="​ Ａ　 ﬁ x ")
    assert got == "A fi x"
    assert one(spark, text.is_null_token(text.cell_text(F.col("c"))), c=" n/a ")
    assert one(spark, text.safe_cell(F.col("c")), c="=1+1") == "'=1+1"
    assert one(spark, text.markdown_cell(F.col("c")), c="a|b\r\nc") == "a\\|b c"
    assert one(spark, text.escape_html(F.col("c")), c="<a&'>") == "&lt;a&amp;&#39;&gt;"
    assert text.stable_digest("") == "811C9DC5"


def test_bands(spark):
    for value, grouped, published in ((2999.0, "<3000", "<3000"), (3000.0, "3000–3999", "3000-4000"), (6000.0, "≥6000", ">=6000"), (None, None, None)):
        assert one(spark, numbers.band_of(F.col("n"), numbers.SALARY_EDGES), n=value) == grouped
        assert one(spark, numbers.salary_band_of(F.col("n")), n=value) == published
    assert one(spark, numbers.salary_band_of(F.col("n")), n=-1.0) is None
    assert one(spark, numbers.cycle_band_of(F.col("n")), n=19.0) == "10-19天"
    assert one(spark, numbers.round_half_up(F.col("n"), 0), n=-2.5) == -2
    assert numbers.parse_edges("4000，3000, x,3000") == ([3000, 4000], ["x"])


@pytest.mark.parametrize(
    ("cell", "kind", "amount", "period", "code"),
    [
        ("无（外地）", "无补贴", 0.0, None, None), ("住宿", "提供住宿", None, None, None), ("住宿 500元", "提供住宿", None, None, "HOUSING_VALUE_UNCERTAIN"), ("500元/月", "现金房补", 500.0, "月", None),
        ("1,200.5元/天", "现金房补", 1200.5, "天", None), ("待定", "未知", None, None, "UNKNOWN_ENUM_VALUE"), ("-", "未知", None, None, None), ("有元", "现金房补", None, None, "INVALID_SALARY"),
    ],
)
def test_housing(spark, cell, kind, amount, period, code):
    got = one(spark, resolve.housing(text.cell_text(F.col("c"))), c=cell)
    assert (got.value, got.amount, got.period, got.code) == (kind, amount, period, code)


@pytest.mark.parametrize(("cell", "amount", "code"), [("3000-4000", None, "VALUE_RANGE_UNCERTAIN"), ("-500", None, "INVALID_SALARY"), ("1,234.5", 1234.5, None), ("面议", None, "INVALID_SALARY"), ("", None, None)])
def test_salary(spark, cell, amount, code):
    got = one(spark, resolve.salary_amount(text.cell_text(F.col("c"))), c=cell)
    assert (got.value, got.code) == (amount, code)


def test_dictionaries(spark):
    assert one(spark, resolve.city(text.cell_text(F.col("c"))), c="上海（浦东）").rule == "city.prefix"
    assert one(spark, resolve.city(text.cell_text(F.col("c"))), c="北京").value == "其他"
    assert one(spark, resolve.offer_status(text.cell_text(F.col("c")), ["offer状态"]), c="OFFER状态").rule == "status.headerEcho"
    assert one(spark, resolve.offer_status(text.cell_text(F.col("c"))), c="已送审批").value == "offer审批中"
    assert one(spark, resolve.offer_status(text.cell_text(F.col("c"))), c="审批通过").value == "未知"
    assert one(spark, resolve.channel(text.cell_text(F.col("c"))), c="BOSS").value == "Boss"
    assert one(spark, resolve.referral_type(text.cell_text(F.col("c")), F.lit("未知")), c="张三推").review
    assert one(spark, resolve.education(text.cell_text(F.col("c"))), c="研究生").confirm
    assert one(spark, resolve.tri_state(text.cell_text(F.col("c"))), c="Y").value is True
    assert one(spark, resolve.graduation_year(text.cell_text(F.col("c"))), c="2027届").value == 2027
    assert one(spark, resolve.graduation_year(text.cell_text(F.col("c"))), c="9999").rule == "year.outOfRange"


def test_mapping_suggestions():
    got = {e.header: (e.target, e.level) for e in mapping.suggest(["城市", "ＯＦＦＥＲ状态", "部门", "学位", "工作的城市", "", "offer唯一ID", "xyz"])}
    assert got["城市"] == ("city", "exact") and got["ＯＦＦＥＲ状态"] == ("offerStatus", "normalized") and got["部门"] == ("department", "alias")
    assert got["学位"][0] != "education" and got["工作的城市"][1] == "fuzzy" and got[""] == (None, "ignored") and got["offer唯一ID"] == ("offerId", "exact") and got["xyz"][1] == "ignored"
    assert mapping.similarity("城市", "工作城市") == 0.8


def test_mapping_conflicts_and_templates():
    entries = mapping.suggest(["城市", "城市", "offer状态"])
    assert mapping.conflicts(entries) == {"city": [0, 1]}
    m, blocks = mapping.decide(entries, mapping.Decisions(merge=frozenset({"city"})), "2026-01-01")
    assert m.columns["city"] == (0, 1) and not blocks
    t = mapping.parse_template(mapping.template_of("t", m, "2026-01-01"))
    assert {e.target for e in mapping.apply_template(t, ["OFFER状态"])} == {"offerStatus"}
    with pytest.raises(ValueError):
        mapping.parse_template('{"version": "1.0.0", "entries": [], "rows": []}')
    with pytest.raises(ValueError):
        mapping.decide(entries, mapping.Decisions())[0].check()


def test_sniffing():
    assert sniff.detect_kind("a.csv", b"PK\x03\x04").kind == "xlsx" and sniff.detect_kind("a.tsv").delimiter == "\t" and sniff.detect_kind("a.bin").kind == "unsupported"
    assert sniff.detect_encoding("中".encode("gb18030")).encoding == "gb18030" and sniff.detect_encoding(b"\xff\xfea\x00").encoding == "utf-16le"
    assert sniff.detect_delimiter('\n"a,b"\tc\td\nx,y,z,w') == "\t" and sniff.detect_delimiter("abc") is None
    assert sniff.line_breaks("a\r\nb\rc\n") == 3
    with pytest.raises(sniff.LimitExceeded):
        sniff.guard_grid(50_001, 2)


def test_delimited_rows_keep_physical_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('offer状态,城市\r\n\r\n"a\nb",上海\r\n已入职\r\n'.encode("gb18030"))
    sheet = sheets.read_offers(spark, str(tmp_path / "a.csv"))
    rows = sheet.rows.orderBy("source_row").collect()
    assert sheet.headers == ("offer状态", "城市")
    assert [(r.source_row, r.cells, r.empty) for r in rows] == [(2, [None, None], True), (3, ["a\nb", "上海"], False), (5, ["已入职", None], False)]


def test_template_and_headers():
    assert sheets.template(True).count("\r\n") == 2
    assert mapping.check_headers(["城市", "需求ID", "x"])["misordered"] == ["城市", "需求ID"]


def tsv(rows):
    return sheets.template() + "".join("\t".join(r) + "\r\n" for r in rows)


def row(**cells):
    from offersieve.schema import STANDARD_KEYS

    base = {"offerStatus": "已入职", "recruitmentStartDate": "2026-01-01", "joiningDate": "2026-01-15", "candidateName": "甲", "requirementId": "007"} | cells
    return [base.get(k, "") for k in STANDARD_KEYS]


def clean(spark, rows, settings=None, corrections=None):
    sheet = sheets.shape(sheets.read_pasted(spark, tsv(rows)))
    m, blocks = mapping.decide(mapping.suggest(sheet.headers), mapping.Decisions(), "2026-01-01")
    assert not blocks
    return cleaning.clean(sheet.rows, m, settings or cleaning.Settings("2026-05-08"), corrections)


def test_cleaning(spark):
    got = clean(spark, [row(), row(), row(joiningDate="2025-12-01"), row(candidateName="乙", salaryAmount="4000", housingRaw="500元/月"), row(candidateName="丙", offerStatus="待入职"), ["", *[""] * 20], row(candidateName="丁", offerStatus="")])
    r = {x.source_row: x for x in got.records.collect()}
    assert set(r) == {2, 3, 4, 5, 6, 8} and r[2].requirement_id == "007" and r[2].d_cycle_days == 14 and r[4].d_cycle_days is None
    assert r[2].dup_kind == "exact" and r[2].dedup_action == "pendingUserConfirmation" and r[4].dup_kind == "none"
    assert (r[5].salary_amount, r[5].currency, r[5].salary_unit, r[5].housing_amount) == (4000, "CNY", "元/月", 500)
    codes = {(i.source_row, i.code) for i in got.issues.collect()}
    assert {(4, "NEGATIVE_CYCLE"), (6, "PLANNED_DATE_UNCERTAIN"), (8, "MISSING_REQUIRED_VALUE"), (2, "EXACT_DUPLICATE")} <= codes
    c = got.counts.first()
    assert (c.n_raw, c.n_empty, c.n_kept, c.n_removed) == (7, 1, 6, 0)
    assert got.lineage.where("source_row = 5 and field = 'salaryAmount'").first().rule == "salary.number"


def test_cleaning_confirmed_and_corrected(spark):
    s = cleaning.Settings("2026-05-08", dedup_confirmed=True, channel_from_referrer=True, gpt_list=("样例大学",), gpt_list_mode=True)
    fix = spark.createDataFrame([(3, "city", "杭州"), (3, "candidateName", "")], "source_row int, field string, value string")
    got = clean(spark, [row(), row(referrer="内推", school="样例大学"), row()], s, fix)
    r = {x.source_row: x for x in got.records.collect()}
    assert set(r) == {2, 3} and r[3].city == "杭州" and r[3].candidate_name is None and r[3].channel == "内推" and r[3].is_gpt is True
    assert {"CHANNEL_INFERRED_FROM_REFERRER", "MANUAL_CORRECTION_APPLIED"} <= set(r[3].d_flags)
    more = clean(spark, [row()], s)
    assert cleaning.append(got.records, more.records, confirmed=True).count() == 2


def test_workbook_round_trip(spark, tmp_path):
    from offersieve.plans.report import Report, Section, xlsx

    data = xlsx(Report("t", "2026-01-01", (Section("一/二", ("offer状态", "薪资"), (("已入职", 4000), ("=x", 1.5))), Section("空", (), ()))))
    (tmp_path / "b.xlsx").write_bytes(data)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    sheet = sheets.read_offers(spark, str(tmp_path / "b.xlsx"))
    assert sheet.headers == ("offer状态", "薪资") and [r.cells for r in sheet.rows.orderBy("source_row").collect()] == [["已入职", "4000"], ["'=x", "1.5"]]
    assert sheets.catalogue(spark, str(tmp_path / "b.xlsx")).orderBy("sheet").first().sheet == "一 二"


def test_vault(spark, tmp_path):
    key, _ = vault.derive_keys("p", b"salt", 10)
    path = str(tmp_path / "v")
    i = vault.save(spark, path, "dataset", spark.createDataFrame([(1, "a")], "n int, s string"), key)
    vault.save(spark, path, "secret", spark.createDataFrame([(2, "b")], "n int, s string"), key)
    assert [tuple(r) for r in vault.load(spark, path, "dataset", key, "n int, s string").collect()] == [(i, 1, "a")]
    assert vault.load(spark, path, "dataset", vault.derive_keys("q", b"salt", 10)[0], "n int, s string").count() == 0
    vault.backup(spark, path, str(tmp_path / "b"))
    assert {r.kind for r in vault.objects(spark, str(tmp_path / "b")).collect()} == {"dataset"}
    vault.restore(spark, str(tmp_path / "b"), path)
    assert vault.objects(spark, path).count() == 2


def test_batches_and_files_have_their_own_records(spark):
    rows = [row(), row(candidateName="乙"), row(candidateName="丙")]
    headers = [f[1] for f in STANDARD_FIELDS]
    raw = spark.createDataFrame([(f, "", i, c, [None] * len(c), False, []) for f in ("a", "b") for i, c in enumerate([headers, *rows], 1)], sheets.RAW)
    sheet = sheets.shape(raw)
    m, _ = mapping.decide(mapping.suggest(sheet.headers), mapping.Decisions(), "2026-01-01")
    got = cleaning.clean(sheet.rows, m, cleaning.Settings("2026-05-08")).records
    six = spark.createDataFrame(got.collect(), got.schema)  # so that the plan is short
    assert six.count() == 6 == six.select("record_id").distinct().count()
    both = cleaning.append(six, six)
    assert both.count() == 12 == both.select("record_id").distinct().count() and both.where("batch_no = 1").count() == 6
    third = cleaning.append(both, six)
    assert third.count() == 18 == third.select("record_id").distinct().count() and third.agg(F.max("batch_no")).first()[0] == 2
    assert cleaning.append(six, six, confirmed=True).count() == 3
    with pytest.raises(ValueError, match="HEADERS_DIFFER"):
        sheets.shape(raw.where("file = 'a' or source_row > 1"))


def test_corrections_of_another_sheet_are_left_out(spark, monkeypatch):
    applied = []
    monkeypatch.setattr(cleaning, "corrected", lambda rows, fix, m: applied.append(1) or rows.withColumn("corrected", F.lit(None).cast("array<string>")))
    fix = spark.createDataFrame([(2, "candidateName", "戊")], "source_row int, field string, value string")
    headers = [f[1] for f in STANDARD_FIELDS]
    raw = spark.createDataFrame([("", "", i, c, [None] * len(c), False, []) for i, c in enumerate([headers, row()], 1)], sheets.RAW)
    sheet = sheets.shape(raw)
    m, _ = mapping.decide(mapping.suggest(sheet.headers), mapping.Decisions(), "2026-01-01")
    cleaning.clean(sheet.rows, m, cleaning.Settings("2026-05-08"), fix, signature="other")
    assert not applied


def test_long_cells_and_limits(spark, tmp_path):
    assert len(next(sheets.parse_delimited("x" * 200_000 + ",b", ","))[1][0]) == 200_000
    (tmp_path / "a.csv").write_text("姓名,城市\n" + "甲,上海\n" * 3)
    assert sheets.read_offers(spark, str(tmp_path)).rows.count() == 3
    (tmp_path / "b.csv").write_text(",".join(["姓名"] * 600) + "\n")
    with pytest.raises(sniff.LimitExceeded):
        sheets.read_offers(spark, str(tmp_path / "b.csv"))


def test_likest_header_wins_and_ties_go_by_order():
    for header in ("实际", "拒绝", "时间", "类型", "到岗时间x"):
        key = mapping.header_key_of(header)
        scores = [(mapping.similarity(key, mapping.header_key_of(n)), t) for n, t in mapping._candidates() if (key, t) not in mapping._FORBIDDEN]
        best = max(s for s, _ in scores)
        got = mapping.suggest_one(header)
        assert got.level != "fuzzy" or got.target == next(t for s, t in scores if s == best)

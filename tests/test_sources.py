"""Files in many tasks, workbooks row by row, objects by revision."""

import datetime as dt
import io
import json
import random
import tracemalloc
import zipfile
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace
from urllib.parse import unquote

import pyarrow as pa
import pytest

from offersieve.plans import digests
from offersieve.sources import delimited, demo, sheets, sniff, vault, versions


@pytest.fixture()
def small_pieces(spark):
    """Pieces of a few bytes, so that seams fall everywhere."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in keep]
    for k, v in keep.items():
        spark.conf.set(k, v)


def random_text(rng, delimiter):
    """Records, some of them wrong: quotes in the middle, behind a closing quote, or never closed."""
    cells = ["a", "", "城市", '"x"', '"a\nb"', '"p""q"', '5" pipe', '"a"b', '"\r\n"', '"multi\n\n""line""\nend"', f'"in{delimiter}side"', "é|ü", "碶|x", '""', '"'][: 15 if rng.random() < 0.4 else 14]
    ending = rng.choice(["\n", "\r\n", "\r", None])
    rows = [delimiter.join(rng.choice(cells) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 14))]
    text = "".join(r + (ending or rng.choice(["\n", "\r\n", "\r"])) for r in rows)
    return text if rng.random() < 0.6 else text.rstrip("\r\n")


def one_task(data, name):
    text, _ = sniff.decode(data, sniff.detect_encoding(data).encoding)
    sep = sniff.detect_delimiter(text) or sniff.default_delimiter(name[name.rfind(".") :])
    return sorted((line, cells, delimited.note(kinds), kinds) for line, cells, kinds in delimited.records(text, sep))


def random_files(rng, n):
    for i in range(n):
        yield f"f{i:03}.csv", random_text(rng, rng.choice([",", "|", "\t", ";"])).encode(rng.choice(["utf-8", "utf-8-sig", "gb18030", "utf-8"]))


def cut_up(files, size):
    """Lines of pieces of about so many bytes, each piece in batches of two lines."""
    for name, data in files:
        lines, start, at = (data[:-1] if data.endswith(b"\n") else data).split(b"\n") if data else [], 0, 0
        pieces = {}
        for line in lines:
            if at - start >= size:
                start = at
            pieces.setdefault(start, []).append(line)
            at += len(line) + 1
        for start, own in pieces.items():
            for k in range(0, len(own), 2):
                yield pa.RecordBatch.from_pylist([{"file": name, "start": start, "size": len(data), "line": x} for x in own[k : k + 2]])


@pytest.mark.parametrize("size", [1, 9, 40, 10_000])
def test_pieces_give_what_one_reader_gives(size):
    files = list(random_files(random.Random(size), 300))
    want = {name: one_task(data, name) for name, data in files}
    rows = [SimpleNamespace(**r) for b in delimited._pieces(cut_up(files, size), delimited._WAYS) for r in b.to_pylist()]
    how, begins, wide = delimited._plan(rows, delimited._WAYS, None, None)
    got = {name: [] for name in want}
    frags = {}
    for r in (r for b in delimited._fragments(cut_up(files, size), how, begins) for r in b.to_pylist()):
        frags.setdefault((r["file"], r["source_row"]), []).append((r["at"], r["text"]))
    joined = [{"file": f, "source_row": n, "parts": [t for _, t in sorted(x)]} for (f, n), x in frags.items()]
    batches = [*delimited._parsed(cut_up(files, size), how, begins), *(delimited._joined([pa.RecordBatch.from_pylist(joined)], how, begins) if joined else ())]
    for r in (r for b in batches for r in b.to_pylist()):
        got[r["file"]].append((r["source_row"], r["cells"], r["notes"], r["kinds"]))
    for name in want:
        assert sorted(got[name], key=str) == sorted(want[name], key=str), (name, dict(files)[name])
    assert not wide and (size > 1000 or frags)


def test_files_in_pieces(spark, tmp_path, small_pieces):
    want = {}
    for name, data in random_files(random.Random(5), 12):
        (tmp_path / name).write_bytes(data)
        want[name] = one_task(data, name)
    (tmp_path / "wi de.csv").write_bytes("\ufeffa,b\n\"c\nd\",e\n".encode("utf-16-le"))
    want["wi de.csv"] = [(1, ["a", "b"], [], []), (2, ["c\nd", "e"], [], [])]
    small_pieces(64)
    got = {name: [] for name in want}
    for r in delimited.read_delimited(spark, str(tmp_path), kinds=True).collect():
        got[unquote(r.file).rsplit("/", 1)[1]].append((r.source_row, list(r.cells), list(r.notes), list(r.kinds)))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_pieces):
    (tmp_path / "a.csv").write_text("".join(f'{i},"x\ny{i}"\n' for i in range(30_000)))
    small_pieces(100_000)
    rows = sheets.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows.columns == [c.split()[0] for c in sheets.RAW.split(", ")]
    from pyspark.sql import functions as F

    found = rows.withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 5
    assert found.agg(F.count("*"), F.sum(F.col("cells")[0].cast("int") * 2 + 1 - F.col("source_row"))).first() == (30_000, 0)


def test_kinds_of_quote_errors():
    kinds = lambda text: [k for _, _, k in delimited.records(text, ",")]
    assert kinds('"5""",x\na 5" pipe,y\n') == [[], []]
    assert kinds('"a"b,c\nok\n"never\nends') == [["trailing"], [], ["unterminated"]]
    assert [c for _, c, _ in delimited.records('"a"b,c\n', ",")] == [["ab", "c"]]


# ---------------------------------------------------------------- workbooks
def book(sheets, date1904=False):
    """A workbook of (name, xml of the sheet, state)."""
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}" state="{state}"/>' for i, (n, _, state) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>offer状态</t></si><si><r><t>薪</t></r><r><t>资</t></r></si></sst>")
        for i, (_, xml, _) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}>{xml}</worksheet>")
    return out.getvalue()


DATA = """<cols><col min="1" max="3" hidden="1"/><col min="4" max="4"/><col min="5" max="5" hidden="true"/><col min="6" max="900" hidden="1"/></cols><sheetData>
<row r="1"><c r="A1" s="3"/></row><row r="3"><c r="C3" t="s"><v>0</v></c><c r="D3" t="s"><v>1</v></c><c r="F3" t="inlineStr"><is><t>备注</t></is></c></row>
<row r="4" hidden="1"><c r="C4" t="str"><v>已入职</v></c><c r="D4"><v>4000.0</v></c></row>
<row r="6"><c r="C6" t="b"><v>1</v></c><c r="E6"><f>A1</f></c></row><row r="9"/></sheetData>"""


def test_workbooks_row_by_row(spark, tmp_path):
    data = book([("空", "<sheetData/>", "visible"), ("数据", DATA, "visible"), ("样式", '<sheetData><row r="2"><c r="B2" s="1"/></row></sheetData>', "hidden")], True)
    (tmp_path / "b.xlsx").write_bytes(data)
    path = str(tmp_path / "b.xlsx")
    rows = sheets.read_workbook(spark, path).orderBy("source_row").collect()
    assert [(r.source_row, r.cells, r.hidden, r.notes) for r in rows] == [
        (3, ["offer状态", "薪资", None, "备注"], False, []), (4, ["已入职", "4000"], True, []), (5, [None], False, []), (6, ["TRUE", None, None], False, ["FORMULA_WITHOUT_CACHE"]),
    ]
    assert rows[1].numbers == [None, 4000.0]
    listed = sheets.catalogue(spark, path).orderBy("position").collect()
    assert [(r.sheet, r.hidden, r.n_rows, r.n_columns, r.n_hidden_rows, r.hidden_columns, r.empty, r.date1904) for r in listed] == [
        ("空", False, 0, 0, 0, [], True, True), ("数据", False, 4, 4, 1, [0, 2, 3], False, True), ("样式", True, 0, 0, 0, [], True, True),
    ]
    sheet = sheets.read_offers(spark, path)
    assert sheet.headers == ("offer状态", "薪资", "", "备注") and sheet.date1904 and sheet.header_row == 3
    assert [r.hidden_columns for r in sheet.hidden_columns.collect()] == [[0, 2, 3]]
    assert {(r.code, r.sheet, r.message.startswith("空工作表")) for r in sheet.issues.collect()} == {("EMPTY_SHEET_SKIPPED", s, True) for s in ("空", "样式")}
    with pytest.raises(ValueError, match="EMPTY_DATASET"):
        sheets.read_offers(spark, path, sheet="空")
    with pytest.raises(ValueError, match="no sheet"):
        sheets.read_offers(spark, path, sheet="x")
    assert sheets.sheet_issues(sheets.catalogue(spark, path), "空").where("sheet = '空'").first().message == "选中的工作表「空」是空的"


def test_memory_of_a_sheet_is_that_of_a_row():
    body = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="inlineStr"><is><t>{"x" * 200}</t></is></c></row>' for i in range(1, 60_001))
    data = book([("s", f"<sheetData>{body}</sheetData>", "visible")])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tracemalloc.start()
        within = sheets.extent(z, "xl/worksheets/s1.xml")
        n = sum(len(cells) for _, cells, *_ in sheets.sheet_rows(z, "xl/worksheets/s1.xml", [], within))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert (within.n_rows, within.n_columns, n) == (60_000, 2, 120_000) and peak < 3_000_000


def test_intervals():
    assert sheets.merged([(5, 9), (0, 1), (2, 3), (8, 12), (20, 20)]) == ((0, 3), (5, 12), (20, 20))


# ---------------------------------------------------------------- objects by revision
def test_objects_by_revision(spark, tmp_path):
    key, _ = vault.derive_keys("p", b"salt", 10)
    frame = lambda *rows: spark.createDataFrame(rows, "n int, s string")
    table = versions.ObjectTable(spark, str(tmp_path / "t t"))
    assert table.version() == 0 and table.snapshot().count() == 0 and table.load("d", key, "n int, s string").count() == 0
    i, revision = table.put("d", frame((1, "a"), (2, None)), key)
    assert revision == 1 and table.put("d", frame((3, "b")), key, i, 1) == (i, 2)
    table.put("secret", frame((9, "z")), key, "k")
    read = lambda **how: sorted((r.id, r.revision, r.n, r.s) for r in table.load("d", key, "n int, s string", **how).collect())
    assert read() == [(i, 2, 3, "b")] and [r[1:] for r in read(version=1)] == [(1, 1, "a"), (1, 2, None)]
    for bad in (lambda: table.put("d", frame((4, "c")), key, i, 1), lambda: table.put("d", frame((4, "c")), key, i), lambda: table.drop("d", i, 1)):
        with pytest.raises(versions.Conflict):
            bad()
    assert table.drop("d", i, 2) == 4 and read() == [] and read(version=3) == [(i, 2, 3, "b")]
    assert table.put("d", frame((5, "e")), key, i) == (i, 3) and read() == [(i, 3, 5, "e")]
    assert [(r.version, r.op, r.revision) for r in table.history().where("kind = 'd'").orderBy("version").collect()] == [(1, "put", 1), (2, "put", 2), (4, "drop", 2), (5, "put", 3)]
    assert table.load("d", vault.derive_keys("q", b"salt", 10)[0], "n int, s string").count() == 0

    manifest = table.backup(str(tmp_path / "b"), "2026-01-01")
    assert manifest["objects"] == 1 and versions.check_backup(spark, str(tmp_path / "b")) == (manifest, None)
    other = versions.ObjectTable(spark, str(tmp_path / "o"))
    assert other.restore(str(tmp_path / "b")) == 1 and other.restore(str(tmp_path / "b")) == 0
    assert [tuple(r) for r in other.load("d", key, "n int, s string").collect()] == [(i, 3, 5, "e")]
    for change, problem in (({"kind": "x"}, "not a backup of objects"), ({"formatVersion": 2}, "another format"), ({"createdAt": ""}, "the manifest is not complete"), ({"includesSecrets": True}, "a backup with secrets"), ({"digest": "0"}, "rows are not those of the manifest"), ({"schemaVersion": "999.0"}, "another schema version")):
        spark.createDataFrame([(json.dumps(manifest | change),)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "b/manifest"))
        assert versions.check_backup(spark, str(tmp_path / "b")) == (None, problem)
    assert versions.check_backup(spark, str(tmp_path / "none"))[1] == "no manifest"


def test_two_writers_with_one_revision(spark, tmp_path):
    key, _ = vault.derive_keys("p", b"salt", 10)
    frame = spark.createDataFrame([(1,)], "n int")
    table = versions.ObjectTable(spark, str(tmp_path / "t"))
    i, _ = table.put("d", frame, key)

    def write(n):
        try:
            return table.put("d", frame, key, i, 1)[1]
        except versions.Conflict:
            return "conflict"

    with ThreadPoolExecutor(3) as pool:
        assert sorted(map(str, pool.map(write, range(3)))) == ["2", "conflict", "conflict"]
    # Entries have one number each, and none is replaced.
    assert table._create("log/00000000000000000001.json", "x") is False and table.version() == 2


def test_digests_do_not_depend_on_order_or_partitions(spark):
    rows = [(i % 40, f"t{i % 7}", [i % 3], None if i % 5 else 0.1 * i) for i in range(300)]
    frame = spark.createDataFrame(rows, "a int, b string, c array<int>, d double")
    want = digests.table_digest(frame)
    assert {digests.table_digest(frame.repartition(n).orderBy("b")) for n in (1, 7, 64)} | {digests.table_digest(frame.select("d", "c", "b", "a"))} == {want}
    changed = [rows[1:], [*rows, rows[0]], [(*rows[0][:1], "x", *rows[0][2:]), *rows[1:]], [(rows[0][0], None, *rows[0][2:]), *rows[1:]], []]
    assert len({want, *(digests.table_digest(spark.createDataFrame(r, frame.schema)) for r in changed)}) == 6
    pair = lambda a, b: digests.table_digest(spark.createDataFrame([(a, b)], "a string, b string"))
    assert len({pair("1", "2,"), pair("1,2", ""), pair("", "1,2"), pair(None, "1,2"), pair("-", "1,2")}) == 5
    assert digests.canonical({"b": [1.0, None], "a": {3, 1}}) == '{"a":[1,3],"b":[1,null]}'
    assert digests.preview_digest({"a": 1, "b": 2}) == digests.preview_digest({"b": 2, "a": 1}) != digests.preview_digest({"a": 1, "b": 2}, model="m")
    assert digests.rules_digest({}, None) != digests.rules_digest({}, ()) == digests.rules_digest({}, [])


def test_dry_runs(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("姓名;城市\n甲;上海\n\n\"x\"y;\"open\n".encode("gb18030"))
    (tmp_path / "b.tsv").write_bytes(b"\xef\xbb\xbfone\ncell\n")
    (tmp_path / "c.csv").write_bytes(("a,b\n" * 20).encode())
    rows = {r.file.rsplit("/", 1)[1]: r for r in delimited.inspect_delimited(spark, str(tmp_path)).collect()}
    a, b, c = rows["a.csv"], rows["b.tsv"], rows["c.csv"]
    assert (a.encoding, a.encoding_source, a.delimiter, a.delimiter_source, a.n_rows, a.n_columns, a.n_empty, a.n_replaced) == ("gb18030", "fallback", ";", "text", 4, 2, 1, 0)
    assert a.hint and a.preview[:2] == ["姓名;城市", "甲;上海"] and sorted(a.issues) == ["QUOTE_MISMATCH.trailing:1", "QUOTE_MISMATCH.unterminated:1"]
    assert (b.encoding, b.encoding_source, b.delimiter, b.delimiter_source, b.n_rows, b.preview, b.issues) == ("utf-8", "bom", "\t", "name", 2, ["one", "cell", ""], [])
    assert c.encoding_source == "utf8-valid" and c.preview_cut and len(c.preview) == 8 and c.n_rows == 20 and c.hint is None
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "b.xlsx").write_bytes(book([("空", "<sheetData/>", "hidden"), ("数据", DATA, "visible")]))
    (r,) = sheets.inspect_workbooks(spark, str(tmp_path / "w"), 2).collect()
    assert r.previewed == "数据" and [list(x) for x in r.preview] == [["offer状态", "薪资", "", "备注"], ["已入职", "4000"]] and len(r.issues) == 1
    assert [(s.sheet, s.hidden, s.empty, s.n_rows, list(s.hidden_columns)) for s in r.sheets] == [("空", True, True, 0, []), ("数据", False, False, 4, [0, 2, 3])]


def test_demo_list(spark):
    from offersieve.schema import STANDARD_HEADERS, STANDARD_KEYS

    rows = [dict(zip(STANDARD_KEYS, r.cells, strict=True)) for r in demo.demo_rows(spark).orderBy("source_row").collect()]
    assert list(rows[0].values()) == list(STANDARD_HEADERS)
    count = lambda k: Counter(r[k] for r in rows[1:])
    assert count("offerStatus") == {"已入职": 26, "待入职": 4, "offer审批中": 9, "拒绝offer": 6, "拒绝口头offer": 3, "其他": 1, "未知": 1}
    assert count("city") == {"上海": 17, "广州": 17, "杭州": 16} and count("channel") == {"Boss": 17, "实习僧": 17, "内推": 16} and count("referrer") == {"内推": 25, "样例推荐人": 25}
    assert count("salaryAmount") == {"3500": 9, "3800": 9, "4100": 8, "4400": 8, "4700": 8, "5000": 8} and count("isGptSchool") == {"是": 13, "否": 37}
    assert count("requirementType") == {"替补替换未拆分": 8, "新增招聘": 42} and count("housingRaw") == {None: 50}
    assert count("rejectionReason") == {None: 45} | dict.fromkeys(("薪酬", "地点", "实习时间", "住房/住宿", "薪酬太低所以去了别家"), 1)
    days = [(dt.date.fromisoformat(r["joiningDate"]) - dt.date.fromisoformat(r["recruitmentStartDate"])).days for r in rows[1:] if r["offerStatus"] == "已入职"]
    assert Counter(days) == {-13: 13, 14: 13}
    digest = lambda n, parts, seed=0: digests.table_digest(demo.demo_rows(spark, n, seed, parts))
    assert digest(20_000, 1) == digest(20_000, 7) != digest(20_000, 7, 1)
    longer = demo.demo_rows(spark, 300).where("source_row <= 201")
    assert digests.table_digest(longer) == digests.table_digest(demo.demo_rows(spark, 200))
    sheet = sheets.shape(demo.demo_rows(spark, 120))
    assert sheet.rows.count() == 120 and demo.demo_lines(demo.demo_rows(spark, 1)).count() == 2

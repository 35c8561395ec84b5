"""Steps that once ran again and again, or sent records where counts do."""

from collections import Counter

from pyspark.sql import functions as F

from offersieve import queries
from offersieve.functions import text
from offersieve.operators import cleaning, duplicates, grouping, metrics, ranking
from offersieve.plans import privacy, report, summary

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_resolvers_run_once_for_records_issues_and_counts(spark):
    cleaned = queries._cleaned(spark, SMALL)
    assert cleaned.records is cleaned.records
    for df in (cleaned.records, cleaned.issues, cleaned.counts):
        assert "nfkc_cells" not in plan(df)


def test_records_are_joined_once_for_groups_and_their_rest(spark):
    offers = queries.offers(spark, SMALL)
    for df in (grouping.top_with_other(offers, "position", 5), report.chart_series(privacy.dimension_table(offers, "channel"), "x"), summary.analysis_summary(offers)):
        assert "lineitem" not in plan(df) and "l_orderkey" not in plan(df)


def test_merged_counts_are_those_of_merged_records(spark):
    offers = queries.offers(spark, SMALL)
    two = F.when(F.col("city").isin("上海", "广州"), "a").otherwise("b")
    got = metrics.bundle_of(metrics.merged(metrics.counted(offers, key=F.col("city")), key=F.when(F.col("_key").isin("上海", "广州"), "a").otherwise("b")), "key")
    assert Counter(map(str, got.collect())) == Counter(map(str, metrics.bundled(offers, key=two).collect()))


def test_records_of_one_label_are_paged_in_the_order_of_the_list(spark, tmp_path):
    rows = queries.offers(spark, "/root/testdata/sf0.01", places=True).select("record_id", "recruiter", "start_date", "place")
    doubled = rows.withColumn("record_id", F.col("record_id") % 50)
    order = [F.desc("start_date"), F.asc("record_id"), F.asc("place")]
    got = ranking.ranked_by(doubled, order, ranges=3).orderBy("rank").collect()
    want = sorted(doubled.collect(), key=lambda r: (-r.start_date.toordinal(), r.record_id, r.place))
    assert [r.place for r in got] == [r.place for r in want]


def test_cells_are_made_plain_once_for_fields_headers_and_keys(spark, monkeypatch):
    made = []
    monkeypatch.setattr(cleaning, "_outputs", lambda v, *how: (v, v, v))
    monkeypatch.setattr(cleaning, "stored", lambda df, name: made.append(plan(df)) or df)
    assert queries._cleaned(spark, SMALL).records is not None
    # One expression for all cells, and one of the offer id in the keys; each field had its own, and headers and keys had theirs.
    assert made[0].count("[\\u200B-\\u200D") <= 2


def test_plain_cells_are_plain_texts(spark):
    odd = ["", " ", "a", " a", "a ", "a b", "a  b", "a\tb", "a\n", "\u200b", "a\u200bb", "\ufeffa", "a\u00a0b", "a\u2003", "\u202f", "a\u205fb", "a\u2028b", "\u3000a", "a\u0085", "a \u0085", "“a”—b", "\u2029", "\x0b", "İ"]
    rows = spark.createDataFrame([(i, [x, None]) for i, x in enumerate(odd)], "i int, c array<string>")
    for r in rows.select(F.col("c")[0].alias("x"), text.plain_cells(F.col("c")).alias("got"), text.plain_text(F.col("c")[0]).alias("want")).collect():
        assert r.got == [r.want, None], repr(r.x)


def test_cells_get_their_compatibility_form(spark):
    rows = [["Ａ", None, "ﬁ"], [], None, ["Ａ", "x"], [None]]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i int, c array<string>").repartition(2).select("i", text.nfkc_cells("c").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [["A", None, "fi"], [], None, ["A", "x"], [None]]


def test_rows_are_joined_once_with_each_kind_of_group(spark):
    rows = [("a", 1, "x", "s"), ("b", 2, "x", "s"), ("c", 3, "y", "s"), ("d", 4, None, "s"), ("e", 5, None, None), ("f", 6, "z", "t"), ("g", 7, None, "u")]
    marked = duplicates.mark(spark.createDataFrame(rows, "record_id string, source_row int, exact_key string, suspected_key string"))
    got = {r.record_id: (r.dup_kind, r.dup_group, r.dup_n, r.is_first) for r in marked.collect()}
    none = ("none", None, None, None)
    assert got == {"a": ("exact", "exact#a", 2, True), "b": ("exact", "exact#a", 2, False), "c": ("suspected", "suspected#c", 2, True), "d": ("suspected", "suspected#c", 2, False), "e": none, "f": none, "g": none}
    assert plan(marked).count("Join ") == 2


def test_cells_of_batches_are_made_plain_once(spark, monkeypatch):
    columns = "record_id string, source_row int, cells array<string>, offer_id string, requirement_id string, candidate_name string, start_date date, dup_kind string, dup_group string, dedup_action string, dedup_by string"
    batch = spark.createDataFrame([("a", 1, ["x ", None], *[None] * 8), ("b", 2, [" y", ""], *[None] * 8)], columns).repartition(2)
    made, stored = [], cleaning.stored
    monkeypatch.setattr(cleaning, "stored", lambda df, name: made.append(plan(df)) or stored(df, name))
    got = cleaning.append(batch, batch)
    assert sorted((r.batch_no, r.dup_kind, r.cells) for r in got.collect()) == [(b, "exact", c) for b in (0, 1) for c in ([" y", ""], ["x ", None])]
    # For each batch once for all cells, and once for the offer id.
    assert made[0].count("[\\u200B-\\u200D") <= 4

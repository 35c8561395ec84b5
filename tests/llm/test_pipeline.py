"""The pipeline's stages on a small corpus."""

import public_tokenizers

import corpus_pipeline
from offersieve.llm import bpe, decontaminate, queries
from tests.llm.test_operators import prose


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    good = [prose(1000 + i, 40) for i in range(60)]
    copy, item = prose(2000, 40), prose(3000, 30)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*good, copy, copy + " kan", "kar " + item + " lon", "12345 !!", None], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
        assert name == "tokens" or now.columns == docs.columns
    assert ids["language_id"] == set(range(1, 64)) and ids["near_dedup"] == ids["line_dedup"] - {62}
    assert ids["decontamination"] == ids["near_dedup"] - {63} == ids["tokens"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["tokens"]


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, columns with the operators' names, and empty tables."""
    names = ["score", "rejected", "lang_pred", "_guess", "n_removed", "text_key", "label", "_own", "window", "ids2"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    good = [(i, prose(4000 + i, 50), "en") for i in range(80)]
    rows = [*good, good[3], good[3], (None, prose(4100, 50), "en"), (None, None, None), (7, None, "en"), (8, "", None), (9, prose(4003, 50), None)]
    docs = spark.createDataFrame([(i, t, lang, None, None, *names) for i, t, lang in rows], schema)
    spark.createDataFrame([(None, None), (1, ""), (2, prose(4005, 50))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {"language_id": 84, "line_dedup": 87, "near_dedup": 87, "decontamination": 86, "tokens": 87}
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false")):
            got = stage(spark, table, str(tmp_path))
            found = got.collect()
            if name != "tokens":
                assert got.columns == docs.columns and all([r[n] for n in names] == names for r in found)
            if table is docs:
                assert len(found) == {**left, "near_dedup": 86, "line_dedup": 86}[name], name
            else:
                assert found == []


def test_workers_forget_what_their_tasks_remembered(spark, tmp_path):
    """Workers go on to the next stage; what decontamination and tokens remember must not stay beside its data."""
    docs = spark.createDataFrame([(i, prose(7000 + i, 60), "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    spark.createDataFrame([(1, prose(7100, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, path = dict(corpus_pipeline.STAGES), public_tokenizers.path("word_bpe_49k.json")

    def remembered(frames):
        yield from ([f.assign(id=len(decontaminate._words) + len(bpe.load(path).chunks) + len(bpe.load(path).fragments)) for f in frames])

    left = lambda: spark.range(16).repartition(16).mapInPandas(remembered, "id long").groupBy().max("id").first()[0]
    for name in ("decontamination", "tokens"):
        assert stages[name](spark, docs, str(tmp_path)).count() == 40
        assert left() == 0, name


def test_memory_of_words_is_bounded():
    encoder = bpe.ForcedBoundaryBpe(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{chr(97 + i % 26)}{i}" for i in range(210_000))
    encoder.digest(text)
    assert len(encoder.chunks) <= 200_000 and len(encoder.fragments) <= 200_000

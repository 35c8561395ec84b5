"""Whole results: cases that an operator once left out."""

import hashlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from offersieve.llm import decontaminate, language, lines, minhash, pii, suffixes
from tests.llm.test_operators import prose


def brute_runs(rows):
    """Lines deleted by id, found place by place; rows in order."""
    md5 = lambda x: hashlib.md5(x.encode()).digest()
    docs = {i: [(n, p, len(p.split())) for n, p in enumerate(t.split("\n")) if p.split()] for i, t in rows}
    chosen = {}
    for i, own in docs.items():
        for a in range(len(own)):
            b, total = a, 0
            while b < len(own) and b < a + lines.WINDOW_LINES and total < lines.WINDOW_WORDS:
                total += own[b][2]
                b += 1
            least = min(range(a, b), key=lambda j: (md5(own[j][1]), j))
            chosen.setdefault(own[least][1], set()).add((i, least))
    fingerprints = {line for line, places in chosen.items() if len(places) > 1}
    seen, pairs, gone = set(), set(), {}
    for i, own in docs.items():
        match, joined = [], []
        for a, (_, line, _) in enumerate(own):
            match.append(line in fingerprints and line in seen)
            seen.add(line)
            pair = (line, own[a + 1][1]) if a + 1 < len(own) else None
            joined.append(pair is not None and pair in pairs)
            pairs.add(pair)
        out, a = set(), 0
        while a < len(own):
            b = a
            while joined[b]:
                b += 1
            if any(match[a : b + 1]) and sum(x[2] for x in own[a : b + 1]) >= lines.MIN_WORDS:
                out.update(x[0] for x in own[a : b + 1])
            a = b + 1
        gone[i] = out
    return gone


# ---------------------------------------------------------------- 1
def test_runs_go_to_both_ends(spark, tmp_path):
    passage = "\n".join([prose(1, 30), "Les.", prose(2, 30), "a b", "c"])
    rows = [
        (1, f"{prose(3, 20)}\n{passage}\n{prose(4, 20)}"), (2, f"{passage}"), (3, f"one\n\ntwo three\n{passage}\n \nnew text of five other words"), (4, "a line of five words\nb c\n\nd\ne"),
        (5, "a line of five words\nb c\nd\nx"), (6, "k\nl\nm\nn\no\np"), (7, "k\nl\nm\nn\no\np"), (8, "k\nl\nm\nn\no\nz\nk\nl\nm\nn\no\np"), (9, "x y\nx y\nx y\nx y"), (10, ""),
    ]
    rows += [(20 + i, "\n".join([prose(100 + i, 12), "a banner that all the pages show", prose(200 + i, 12), *(["k", "l"] if i % 3 else [])])) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_runs(rows)
    assert want[2] == set(range(5)) and want[3] == set(range(3, 8)) and want[9] == {1, 2, 3} and sum(1 in want[20 + i] for i in range(30)) == 29
    got = {r.doc_id: set(r.lines) for r in lines.repeated_lines(docs.withColumn("text_key", F.unhex(F.md5("text")))).collect()}
    assert got == {i: v for i, v in want.items() if v}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert 2 not in left and left[3] == "one\n\ntwo three\n \nnew text of five other words" and left[10] == ""
    assert {r.doc_id: r.n_removed for r in lines.report(docs).collect()} == {i: len(v) for i, v in want.items()}


def test_any_long_run_is_found(spark):
    """Runs of a window's size or more are deleted whole, whatever stands around them."""
    rows = []
    for k in range(40):
        run = [prose(5000 + 10 * k + j, n) for j, n in enumerate([(60,), (20, 3, 30), (1,) * 8, (49, 1), (3, 48, 2)][k % 5])]
        for copy in range(2):
            around = [[prose(9000 + 4 * k + 2 * copy + side, 7)] * (k % 3 > side) for side in (0, 1)]
            rows.append((2 * k + copy, "\n".join([*around[0], *run, *around[1]]), len(run), k % 3 > 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.report(docs).collect()}
    assert all(got[i] == (n if i % 2 else 0) for i, _, n, _ in rows)


def test_odd_rows_and_names(spark):
    """Nulls, repeated rows, ids with several texts, an empty table, and columns with the operators' own names."""
    banner = "a banner that all the pages show\n" * 2
    rows = [(None, banner), (None, banner), (1, banner), (1, "other"), (1, None), (2, banner), (3, " \n\t"), (4, "x\n" * 30_000)]
    names = "text_key string, _key string, _id string, _lines string, _own string, number string, lines string, hash string, N_REMOVED string"
    docs = spark.createDataFrame([(*r, *"abcdefghi") for r in rows], f"doc_id long, text string, {names}")
    for table in (docs, docs.where("false")):
        got = lines.dedup_lines(table.drop("N_REMOVED")).collect()
        assert len(got) == table.count()
        for r in got:
            assert r.text_key == "a" and r.hash == "h"
            if r.doc_id is None:
                assert r.text == "a banner that all the pages show\n" and r.n_removed == 1
            if r.doc_id == 2:
                assert r.text == "" and r.n_removed == 2
            if r.doc_id == 4:
                assert r.n_removed == 30_000 - 1
    for row in minhash.deduplicated(docs).collect() + pii.sanitized(docs).collect():
        assert row._own == "e" and row._id == "c"
    assert minhash.deduplicated(docs).columns == docs.columns == pii.sanitized(docs).columns


# ---------------------------------------------------------------- 5
def test_unlearned_languages_are_rejected(spark):
    rng = np.random.default_rng(1)
    parts = {"en": ["the", "and", "tion", "ing", "house"], "fr": ["les", "que", "eau", "ment", "oi"], "xx": ["hno", "tgu", "dsea", "mreo", "tlis"]}
    make = lambda k, n: " ".join(rng.choice(parts[k], n))
    rows = [(make(k, int(n)), k) for k in ("en", "fr") for n in rng.integers(3, 200, 400)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    for n in (6, 25, 100, 400):
        assert sum(model.predict(make("xx", n))[2] for _ in range(50)) == 50
        assert sum(model.predict(make(k, n))[2] for k in ("en", "fr") for _ in range(100)) <= 2
    assert all(a >= b for row in model.limits.tolist() for a, b in zip(row, row[1:], strict=False))


# ---------------------------------------------------------------- 9
def test_every_item_with_a_word_is_searched(spark):
    items = [
        "What is the capital of France?", "Tom has 5 apples and Ann has 7.", "What is 17 * 24?", "Zwei Worte", "Quokka", "Die Frau Mit Dem Hund Und Der Katze Sah Das Haus Am See Bei Nacht",
        "If Anna has 3 red apples and buys 4 more green ones from the old market then how many does she own in total",
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(50, ""), (51, None)], "item_id long, text string")
    ways = [str, str.lower, str.upper, str.title, lambda t: f"({t})"]
    rows = [(100 * k + i, f"{prose(i, 9)} {way(t)} {prose(i + 50, 9)}") for k, way in enumerate(ways) for i, t in enumerate(items)]
    rows += [(900 + i, prose(900 + i, 60)) for i in range(5)] + [(990, "What is the capital of Spain?"), (991, "What is 17 * 25?"), (992, "Zwei andere Worte")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sent in (decontaminate.MAX_SENT, 0):
        decontaminate.MAX_SENT, before = sent, decontaminate.MAX_SENT
        try:
            got = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(docs, benchmark).collect()}
        finally:
            decontaminate.MAX_SENT = before
        assert got == {(100 * k + i, i): 1.0 for k in range(len(ways)) for i in range(len(items))}
    changed = spark.createDataFrame([(1, items[-1].replace("Anna", "Bob").replace("3", "17"))], "doc_id long, text string")
    assert [(r.item_id, r.share) for r in decontaminate.leaks(changed, benchmark).collect()] == [(6, 1.0)]


# ---------------------------------------------------------------- 10
def test_owners_are_compared_byte_by_byte():
    """Strings that differ in their owner's bytes alone, or whose text looks like an owner's number, are apart."""
    width, never = suffixes.KEY, suffixes._NEVER
    side, keys = b"s" * 26, [bytes([65 + i]) * width for i in range(3)]

    def blob(jobs):
        left, right, doc = (np.array(x) for x in zip(*[(a, 26 - a, d) for a, _, _, d in jobs], strict=True))
        return suffixes._pack(left.astype(np.uint8), right.astype(np.uint8), doc.astype(np.int64), np.frombuffer(b"".join(side[:a] + k + s for a, k, s, _ in jobs), np.uint8))

    jobs = [(10, keys[0], side[10:], 5), (10, keys[1], side[10:], 3), (10, keys[0], side[10:], 4), (10, keys[2], side[10:], 9)]
    (said,) = suffixes.answer_strings([blob(jobs)])
    runs, lengths, least = suffixes._unpack(said, np.uint8, np.uint8, np.int64)
    assert runs.tolist() == lengths.tolist() == [1] * 4 and least.tolist() == [4, 3, 4, 9] and never not in least
    zeros = [(0, keys[0], b"\0\0\0\0" + b"z" * 22, 1), (4, keys[0], b"z" * 22, 2)]
    side = b"\0" * 26
    (said,) = suffixes.answer_strings([blob(zeros)])
    assert suffixes._unpack(said, np.uint8, np.uint8, np.int64)[2].tolist() == [1, 2]


def test_crowded_owners_are_told_in_the_first_round():
    def blob(owner, kinds, own=0):
        return (owner << 1 | own).to_bytes(5, "little") + bytes([kinds])

    blobs = [blob(7, 255) + blob(8, 1) + blob(9, 3, 1)] * 3 + [blob(5, 255)]
    got = [np.unpackbits(np.frombuffer(x, np.uint8)).reshape(2, -1)[:, :3].tolist() for x in suffixes.answer_owners(blobs, crowd=700)]
    assert got[:3] == [[[1, 1, 1], [1, 0, 0]]] * 3 and got[3] == [[0, 0, 0], [0, 0, 0]]


def test_few_of_a_languages_own_texts_are_rejected(spark):
    """Two of a hundred texts are in part in the other language: those must not be rejected because few of them set the limit."""
    rng = np.random.default_rng(3)
    parts = {"en": ["the", "and", "tion", "ing", "house", "over"], "fr": ["les", "que", "eau", "ment", "oi", "elle"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(n))
    rows = []
    for i in range(1, 1801):
        lang, other = ("en", "fr") if i % 2 else ("fr", "en")
        mixed = i % 50 in (7, 8)
        rows.append((i, say(lang, 30) + " " + (say(other, 20) if mixed else say(lang, 20)), lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in language.identify_documents(d).collect() if r.held_out]
    assert len(got) > 500 and sum(r.rejected for r in got) <= 0.004 * len(got)
    strange = spark.createDataFrame([(i, " ".join("".join(rng.choice(list("xqzjkvw"), 5)) for _ in range(50))) for i in range(40)], "doc_id long, text string")
    model = language.learn(d.where("doc_id % 3 <> 0"))
    assert language.accepted(strange, model).count() == 0
    # Texts beside the sample only set limits.
    small = language.learn(d, docs_a_language=100, held_more=400)
    assert sum(r.rejected for r in language.identify(d, small).collect()) <= 0.01 * d.count()

"""Operators on Spark: brute force, edge cases, extra columns."""

import hashlib
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from offersieve.llm import bpe, decontaminate, fingerprints, language, minhash, pii, quality, sharding, suffixes
from offersieve.llm.hashing import shingle_set

SCHEMA = "doc_id long, text string, lang string, score double, ids string, block string, label int"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "sa") for b in ("n", "r", "st", "x", "dle", "mp")]


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base, other = prose(1), prose(2, 400)
    passage = prose(3, 60)
    out = [base, base, edited(base, 40), edited(base, 40, 60), edited(base, *range(0, 80, 8)), other, edited(other, 5), "", None, " \n\t", "one", "one", "two words"]
    out += [prose(10) + "\n" + passage + "\n" + prose(11), prose(12) + "\n" + passage + "\nfoo\n\nfoo bar baz qux quux\nfoo bar baz qux quux", "日本 é " + other, "x" * 3000, "ab " * 2000]
    return list(enumerate(out, 1)) + [(1, base), (None, base), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Repeated ids, null ids, and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 0.5, "x", "y", 3) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


# ---------------------------------------------------------------- 2
def test_quality(spark, docs, empty):
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30).upper() + "!!", i % 2) for i in range(1, 400)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = [(r, dict((i, q) for i, _, q in rows)[r.doc_id]) for r in quality.score_documents(d, labels).collect()]
    held = [(r.score, q) for r, q in got if r.held_out]
    assert len(got) == 399 and len(held) > 50 and min(s for s, q in held if q) > max(s for s, q in held if not q)
    odd = quality.scored(docs, quality.learn(d, labels)).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_documents(docs, labels.where("false")).select("score").distinct().first()[0] == 0.5
    assert quality.score_documents(empty, labels.where("false")).count() == 0


# ---------------------------------------------------------------- 3
def test_bpe(docs, texts, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    round_trip = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(round_trip) == len(texts)
    for r in round_trip:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)), ids))
    got = [tuple(r) for r in bpe.digests(docs, path, with_ids=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.digests(empty, path).count() == 0


# ---------------------------------------------------------------- 4
def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a]) and minhash.linked(sets[a], sets[b], percent):
                label[find(a)] = find(b)
    groups = {}
    for a, (i, _) in enumerate(rows):
        groups.setdefault(find(a), []).append(i)
    return [min((i for i in groups[find(a)] if i is not None), default=None) for a in range(len(rows))]


def test_near_duplicates(docs, texts, empty):
    want = Counter(zip([i for i, _ in texts], [len(shingle_set(t)) for _, t in texts], brute_components(texts, 85), strict=True))
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(docs, 85)
    assert kept.columns == docs.columns and kept.where(F.col("text") == texts[0][1]).count() == 1


def test_chains_and_stars_are_connected(spark):
    base = prose(77, 300)
    chain = [base]
    for i in range(12):
        chain.append(edited(chain[-1], 20 * i))
    d = spark.createDataFrame([(100 - i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(d).collect()} == {88}
    nodes = [bytes([i]) for i in range(40)]
    edges = spark.createDataFrame([(a, b) for a, b in pairwise(nodes[:30])] + [(nodes[30], n) for n in nodes[31:]], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in minhash.connected(edges).collect()}
    assert {got[n] for n in nodes[:30]} == {nodes[0]} and {got[n] for n in nodes[30:]} == {nodes[30]}


# ---------------------------------------------------------------- 5
def test_language(spark, docs, empty):
    rng = np.random.default_rng(0)
    parts = {"en": ["the", "and", "tion", "ing", "house"], "fr": ["les", "que", "eau", "ment", "oi"]}
    rows = [(i, " ".join(rng.choice(parts["en" if i % 2 else "fr"], 25)), "en" if i % 2 else "fr") for i in range(1, 300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_documents(d).collect()
    assert len(got) == 299 and all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in got) and not any(r.rejected for r in got)
    odd = language.identify(docs, language.learn(d)).collect()
    assert len(odd) == docs.count() and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    assert language.identify_documents(empty).count() == 0 and {r.lang_pred for r in language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---------------------------------------------------------------- 6
def test_sharding(docs, texts, empty):
    rows = sharding.shards(docs, 3).collect()
    assert len(rows) == len(texts)
    place = {}
    for r in rows:
        assert place.setdefault(r.text_crc32, r.shard) == r.shard
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sum(r.size for r in rows) == sum(len((t or "").encode()) + 1 for _, t in texts)
    groups = Counter()
    for _, t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    loads = [0] * 3
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    assert sorted(loads) == sorted(sum(r.size for r in rows if r.shard == s) for s in range(3))
    assert sharding.shards(empty).count() == 0


# ---------------------------------------------------------------- 7
def test_fingerprints(docs, texts, empty):
    order = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e)] += 1
    for block in (1, 4):  # of many blocks, and with ids that repeat at their seams
        seams = fingerprints.edited_fingerprints(docs, block).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in seams) == want
    got = fingerprints.edited_fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edited_fingerprints(empty).count() == 0 and fingerprints.fingerprints(docs).where("fingerprint is null").count() == 0
    alone = fingerprints.edited_fingerprints(docs.where("doc_id = 6")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# ---------------------------------------------------------------- 8
def luhn(d):
    return sum((int(c) * (1 + i % 2) - 1) % 9 + 1 if int(c) else 0 for i, c in enumerate(reversed(d))) % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)
PERSONAL = [
    "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "+1 (301) 555-0346 +33 1 23", "4111 1111 1111 1111-", "é😀 bob@x.co 1.2.3.4", None, "",
    "4111111111111111 4111111111111112 12345678901234567890", "a@b a@b.c.@d.e +12345678901 .1.2.3.4.", "1 " * 5000, "a@" + "b." * 3000 + "c",
]


def test_pii(spark, empty):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(PERSONAL)] + [(1, PERSONAL[1])], "doc_id long, text string")
    got = by_id(pii.report(d))
    for i, t in enumerate(PERSONAL):
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m[0]))
        said = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)
        for r in got[i]:
            assert r.spans == said and r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in found) for j in range(4)]
    assert len(got[1]) == 2 and pii.report(empty).count() == 0


def brute_terms(texts):
    """Disclosing terms over different texts, by counting."""
    texts = sorted(set(texts))
    words = lambda t: set(regex.findall(r"\p{L}{3,}", t.lower()))
    entities, outside = [], []
    for t in texts:
        found, left = set(), t
        for k, (name, pattern, ok) in enumerate(BASE):
            for m in re.finditer(pattern, t):
                if ok(m[0]):
                    v, d = m[0].lower(), re.sub("[^0-9]", "", m[0])
                    left = left.replace(m[0], " ")
                    found |= [{"e" + v, "d" + v.split("@")[-1], *("n" + w for w in words(v.split("@")[0]))}, {"i" + v, "t" + ".".join(v.split(".")[:2])}, {"c" + d, "s" + d[:6]}, {"p" + d, "a" + d[:-7]}][k]
        entities.append(found)
        outside.append(words(left) if found else set())
    total, n_word = len(texts), Counter(w for t in texts for w in words(t))
    n_entity = Counter(e for found in entities for e in found)
    both = Counter((e, w) for found, ws in zip(entities, outside, strict=True) for e in found for w in ws)
    out = set()
    for (e, w), n in both.items():
        given = np.log(total * n / (n_entity[e] * n_word[w]))
        if 1 < n_entity[e] < total and 2 * n >= n_word[w] and given >= 0.5 * np.log(total / n_entity[e]) and n * given >= np.log(total):
            out.add(w)
    return out


def test_disclosing_terms(spark):
    rows = [(i, f"text {chr(97 + i) * 4} the quokka asked jo@x.org for {chr(107 + i) * 3}") for i in range(8)] + [(100 + i, f"nothing about the {chr(97 + i % 20) * 5} asked {i}") for i in range(200)]
    rows += [(400, "A Quokka without the address"), (401, "quokkas are others"), (402, rows[0][1])]
    rows += [(500 + i, f"{'the old mill' if i % 2 else 'the new kiln'} of {'ann' if i % 2 else 'bob'}.{chr(97 + i) * 3}{i}@shop{i % 2}.net with {'word ' * i}") for i in range(12)]
    rows += [(600 + i, f"net of 10.7.{i}.1 in the harbour") for i in range(3)] + [(700 + i, f"call +1 (555) 20{i}-3344 for zebras") for i in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    terms = brute_terms([t for _, t in rows])
    assert {"quokka", "mill", "kiln", "harbour", "zebras"} <= terms and not terms & {"the", "asked", "nothing"}
    got = {r.doc_id: r.spans.split(",") for r in pii.report(d).collect()}
    for i, t in rows:
        base = [m.span() for _, p, ok in BASE for m in re.finditer(p, t) if ok(m[0])]
        want = {f"term:{m.start()}:{m.end()}" for m in regex.finditer(r"\p{L}{3,}", t) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, b in base)}
        assert {s for s in got[i] if s.startswith("term")} == want, i
    clean = {r.doc_id: r.text for r in pii.sanitized(d).collect()}
    assert "quokka" not in clean[0] and "[EMAIL]" in clean[0] and "the" in clean[0] and clean[400] == "A  without the address" and clean[401] == "quokkas are others"


# ---------------------------------------------------------------- 9
def test_decontamination(spark, docs, empty):
    item = "If Anna has 3 red apples and buys 4 more green ones from the old market then how many does she own in total"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (4, item), (5, prose(500, 30))], "item_id long, text string")
    rows = [
        (1, prose(1) + " " + item + " " + prose(2)), (2, prose(3) + " " + item.replace("Anna", "Bob").replace("3", "17").replace("4", "9") + " " + prose(4)),
        (3, item.upper()), (4, prose(5)), (5, None), (6, item[: len(item) // 4] + prose(6)), (1, prose(7) + " " + prose(500, 30)), (None, item),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, window int")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.leaks(d, benchmark).collect()}
    assert set(got) == {(1, 1), (1, 4), (2, 1), (2, 4), (3, 1), (3, 4), (None, 1), (None, 4), (1, 5)}
    assert got[2, 1] > 0 and got[1, 1] == 0
    assert {r.doc_id for r in decontaminate.decontaminated(d, benchmark).collect()} == {4, 5, 6}
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.where("false")).count() == 0


def test_short_items_take_no_corpus_away(spark):
    rows = [(i, f"{'Yes' if i % 3 else 'no'} {prose(i, 12)}{' six rare words of one puzzle' if i == 7 else ''}", 1) for i in range(2100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _bad int")
    items = spark.createDataFrame([(1, "Yes"), (2, "six rare words of one puzzle"), (3, "of")], "item_id long, text string")
    found = decontaminate.leaks(d, items)
    assert {(r.item_id, r.short) for r in found.select("item_id", "short").distinct().collect()} == {(1, True), (2, True), (3, True)}
    assert found.where("item_id = 1").count() == 1400 and found.where("item_id = 2").first().bits == np.log2(2100)
    kept = decontaminate.decontaminated(d, items)
    assert kept.columns == d.columns and kept.count() == 2099 and kept.where("doc_id = 7").count() == 0
    assert decontaminate.decontaminated(d, items, least_bits=0.5).where("doc_id % 3 > 0").count() == 0


def brute_leaks(rows, items):
    """Leaks by comparing every window with every window."""
    def words(t):
        out = []
        for w in (t or "").split():
            body = w.strip("\"'“”‘’«»()[]{}<>.,;:!?…*#$&%=_|~`^-–—¿¡") or w
            kind = "number" if re.fullmatch(r"[+-]?\d[\d.,:/\-]*%?", body) else "quantity" if re.fullmatch(r"[+-]?\d[\d.,]*[A-Za-zµ°]{1,4}", body) else "name" if body[0].isupper() and (len(body) == 1 or body[1:].islower()) else ""
            if not kind and body.lower() in decontaminate.UNITS and out and out[-1][0] == "number":
                kind = "unit"
            out.append((kind, w, body))
        return out

    def leaking(item, doc):
        n, shares = min(8, len(item)), []
        for key, plain in ((lambda w: w[0] or w[2].lower(), True), (lambda w: w[2].casefold(), False)):
            spots = [a for a in range(len(item) - n + 1) if n and (not plain or n >= 3 and sum(not w[0] for w in item[a : a + n]) >= min(5, n))]
            runs = {}
            for a in spots:
                for b in range(len(doc) - n + 1):
                    if [key(w) for w in item[a : a + n]] == [key(w) for w in doc[b : b + n]]:
                        runs.setdefault(b - a, []).append(a)
            good = set()
            for offset, at in runs.items():
                slots = {}
                for a in at:
                    for j in range(a, a + n):
                        if plain and item[j][0]:
                            slots.setdefault(item[j][1], set()).add(doc[j + offset][1])
                if all(len(v) == 1 for v in slots.values()):
                    good.update(at)
            shares += [len(good) / len(spots)] if spots else []
        return any(s >= 0.4 for s in shares)

    return {(i, j) for i, t in rows for j, u in items if u and leaking(words(u), words(t))}


def test_leaks_by_brute_force(spark):
    rng = np.random.default_rng(4)
    frames = ["Anna has {} apples and gives Bob {} kg of them for the old red market", "The train leaves at {} and runs {} miles to Rome, where Anna waits for it all day", "Which of the {} small words stands here"]
    items = [(i, frames[i % 3].format(i, i * 7)) for i in range(9)] + [(20, "short one"), (21, "Yes"), (22, None), (23, ""), (24, "12 13 14 15 16 17 18 19 20")]
    rows = []
    for i in range(60):
        parts = [prose(i, 6)]
        if i % 2:
            t = frames[i % 3].format(rng.integers(0, 9), rng.integers(0, 90)).replace("Anna", str(rng.choice(["Anna", "Eve"])))
            parts += [t if rng.random() < 0.5 else " ".join(t.split()[: rng.integers(3, 20)]), "Yes." if i % 5 == 0 else "a short one"]
        rows.append((i, " ".join([*parts, prose(90 + i, 4)])))
    rows += [(100, None), (101, ""), (102, "Yes"), (103, "12 13 14 15 16 17 18 19 20")]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(rows, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len({j for _, j in want}) >= 11


def test_inconsistent_slots_are_no_leak(spark):
    item = "Then Anna gave the red ball to Anna who took the ball from Anna again while they stood there"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    swapped = item.replace("Anna", "Bob")
    mixed = item.replace("Anna", "Bob", 1).replace("Anna", "Eve", 1)
    d = spark.createDataFrame([(1, swapped), (2, mixed)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(d, benchmark).collect()] == [1]


# ---------------------------------------------------------------- 10
def brute_spans(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                mask[p : p + 50] = True
        edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
        out.append((i, len(b), int(mask.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("crowd", "ways"), [(20_000, {}), (1, {}), (20_000, {"bucket_bytes": 64, "direct": 16}), (1, {"bucket_bytes": 64, "direct": 16})])
def test_repeated_spans(docs, texts, empty, crowd, ways):
    low = -(10**9)
    want = brute_spans([(low if i is None else i, t) for i, t in texts])
    got = suffixes.repeated_spans(docs, pack_bytes=2000, crowd=crowd, **ways)
    rows = got.collect()
    assert Counter((low if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert all(sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed for r in rows)
    assert suffixes.repeated_spans(empty).count() == 0

"""Ranked search, spelling variants and URL filters against brute force, with odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from offersieve.llm import search, urls, variants
from tests.llm.test_operators import SCHEMA, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: t.encode().lower().decode()  # noqa: E731  A-Z alone


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 20 + 13 * (i % 9))) for i in range(1, 60)]
    out += [(60, None), (61, ""), (62, " .,;"), (63, "ÀÉ日本 Kan_lor-st"), (64, "kar " * 200_000), (65, out[0][1]), (1, out[1][1]), (None, out[2][1]), (66, "x" * 1_200_000), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Repeated and null ids, and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 0.5, "x", "y", 3) for i, t in rows], SCHEMA).repartition(7)


# ---------------------------------------------------------------- 11
def brute_search(rows, items, k):
    texts = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in rows]
    texts = [(i, c, c.total()) for i, c in texts if c]
    total, n_docs = sum(n for *_, n in texts), len(texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        asked = Counter(TERM.findall(lower(text)))
        scored = []
        for i, c, n in texts:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


ITEMS = [(1, "kan lor lor KAN tedle"), (2, None), (3, ""), (4, "日本 ÀÉ àé"), (4, "kar"), (5, prose(5, 9)), (5, prose(5, 9)), (6, "nowhere"), (None, "miX rust"), (7, "x" * 1_200_000)]


@pytest.mark.parametrize("ways", [{}, {"block_bytes": 40}])
def test_search(spark, rows, docs, monkeypatch, ways):
    items = spark.createDataFrame([(i, t, "score") for i, t in ITEMS], "item_id long, text string, score string")
    want = brute_search(rows, ITEMS, 4)
    assert Counter(map(tuple, search.search(docs, items, 4, **ways).collect())) == want
    assert {n for _, n, *_ in want} == {1, 2, 3, 4} and sum(x[0] == 7 for x in want) == 1


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs, items.where("false")).count() == 0 and search.search(docs.where("false"), items).count() == 0
    assert search.search(docs, items.where("item_id in (2, 3, 6)")).count() == 0
    assert search.search(docs, items.where("item_id = 7"), 3).columns == ["item_id", "rank", "doc_id", "score"]


def test_radix_order_and_chunks():
    keys = np.random.default_rng(1).integers(0, 1 << 37, 5000)
    assert (search.radix_order(keys, 37) == np.argsort(keys, kind="stable")).all()
    texts = [b"ab cd " * 200_000, None, b"", b"e" * 1_000_000 + b" f"]
    found = Counter()
    for numbers, parts in search._pieces(texts):
        _, starts, _, _, owner = search._terms(numbers, parts, search.series(256, 1))
        found.update(owner.tolist())
        assert len(parts) == len(numbers)
    assert found == {0: 400_000, 3: 2}


# ---------------------------------------------------------------- 12
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=2):
    out, form = set(), {}
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), counts[form[w]] if form[w] else None))
    return out


def brute_counts(rows, edited):
    out = Counter()
    for i, t in rows:
        for run in re.findall(variants.LETTERS, lower(t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if edited and h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("edited", [False, True])
def test_words(docs, rows, edited):
    assert {(r.word, r.n) for r in variants.words(docs, edited).collect()} == set(brute_counts(rows, edited).items())


@pytest.mark.parametrize("letters", ["ab", "abcÿ", "abcdefghijkl"])
def test_variants(spark, letters):
    rng = np.random.default_rng(len(letters))
    words = {"".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(700)}
    words |= {"a" * n for n in range(1, 30)} | {"a" * n + "b" for n in range(30)} | {"z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1499}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.zipf(1.5, len(words)), strict=True)}
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)).collect()
    assert {tuple(r) for r in got} == brute_variants(counts) and len(got) == len(counts)


def test_variants_of_documents(spark, docs, rows):
    more = [(300 + i, "Saddle saddle saddle sadle candle candles" + " handle" * (i % 2)) for i in range(120)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = variants.variants(variants.words(every, edited=True)).collect()
    assert {tuple(r) for r in got} == brute_variants(brute_counts(rows + more, True)) and any(r.form for r in got)
    assert variants.variants(variants.words(docs.where("false"))).count() == 0


# ---------------------------------------------------------------- 13
URLS = [
    "https://a.Example.org/es/1", "https://b.example.org/en/12?x", "http://example.org/en/2", "http://org/es/", "http://x.com/fr/1#y", "http://x.com/de/", "http://x.com/de/2", "http://x.com/other",
    "http://y.net/", "http://y.net?u=http://x.com/fr/", "nothing", None, "", "://", "http://notorg/x", "http://w.com/en", "http://v.net/es/", "http://X.com", "http://com/fr", "http://u.example.com/fr/a",
]


def brute_judged(rows, rules, rounds=urls.ROUNDS):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        return lower(host), re.match("[^?#]*", rest[len(host) :])[0]

    def ruled(host, path):
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: (len(r[1] + r[2]), r[0]), default=None)

    pages = [(i, *parts(u), h) for i, u, h in rows]
    seeds, links = {}, Counter()
    for host in {h for _, h, _, _ in pages if h}:
        own = [ruled(h, p) for _, h, p, _ in pages if h == host]
        seeds[host] = [sum(r is not None and r[0] == v for r in own) / len(own) for v in ("allow", "block")]
    for _, host, _, html in pages:
        for target in re.findall(urls.LINK, html or ""):
            if host and lower(target) != host:
                links[host, lower(target)] += 1
    scores = []
    for kind, turn in ((0, False), (1, True)):
        edges = {(b, a) if turn else (a, b): n for (a, b), n in links.items()}
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        base = {h: 0.15 * s[kind] for h, s in seeds.items()}
        score = dict(base)
        for _ in range(rounds):
            score, old = dict(base), score
            for (a, b), n in edges.items():
                score[b] = score.get(b, 0) + 0.85 * old.get(a, 0) * n / out[a]
        scores.append(score)
    result = []
    for i, host, path, _ in pages:
        r = ruled(host, path)
        method = "block" if round(scores[1].get(host, 0), 9) > round(scores[0].get(host, 0), 9) else "allow"
        result.append((i, host, path, r and r[1] + r[2], r[0] if r else method))
    return Counter(result)


def test_urls(spark):
    link = lambda *hosts: "".join(f'<li><a class=c href="http://{h}/p">t</a>' for h in hosts) + '<a href="/own">o</a><a href="de">r</a>'
    htmls = [link("w.com", "y.net"), None, "", link("v.net"), link("y.net"), link(), link("v.net", "x.com"), "<IFRAME SRC='//V.net/a'></IFRAME>", link("x.com", "x.com", "nowhere.io")]
    rows = [(i, u, htmls[i % len(htmls)]) for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[5], link("w.com")), (99, "http://bad.io/", link("x.com")), (98, "http://good.io/", link("org"))]
    rules = (*urls.RULES, ("block", "example.org", "/es/"), ("allow", "example.org", "/es/"), ("allow", None, "/"))
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, host string, share int")
    table = urls.rules_table(spark, rules)
    want = brute_judged(rows, [r for r in rules if r[1]])
    got = urls.report(pages, table)
    assert Counter(map(tuple, got.collect())) == want and got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {v for (i, *_, v), _ in want.items() if i == 99} == {"block"} and {v for (i, *_, v), _ in want.items() if i == 98} == {"allow"}
    kept = urls.allowed(pages, table)
    assert kept.columns == pages.columns and kept.count() == sum(n for x, n in want.items() if x[-1] == "allow")
    assert urls.report(pages.where("false"), table).count() == 0 and urls.report(pages, table.where("false")).where("verdict <> 'allow'").count() == 0


def test_urls_run_without_python(spark):
    pages = spark.createDataFrame([(1, "http://x.com/fr/1", "")], "page_id long, url string, html string")
    plan = urls.report(pages, spark.sql("SELECT 'allow' AS verdict, 'com' AS host, '/fr/' AS path"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

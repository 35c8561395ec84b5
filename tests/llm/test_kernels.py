"""Spark-free kernels against brute force."""

import hashlib
import heapq
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from offersieve.llm import bpe, decontaminate, fingerprints, hashing, language, minhash, quality, sharding, suffixes

RNG = random.Random(5)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def coder():
    return bpe.load(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = [
    "", " ", "Σίσυφος ΣΣ", "İstanbul don't I'LL we've", "a\x1cb \x1d\x7f", "<|endoftext|>x<|startoftext|> <|end", "日本語テキスト 123４５", "é é ﬁ ｆｕｌｌ", "​﻿ zero width",
    "😀👍🏽 ok!!　x\x85y", "a" * 5000, "Ⅷ½ ² ₂", "ffì<|END", "᠎ a\u0085", "x" * 70 + " " + "ß" * 70,
]


@pytest.mark.parametrize("text", TEXTS + ["".join(RNG.choice("ab Aé'世.1s\ńΩ") for _ in range(300)) for _ in range(30)])
def test_bpe_equals_tokenizer(coder, tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    assert coder.decode(ids) == decoded and coder.digest(text)[2] == hashlib.sha256(decoded.encode()).hexdigest()
    assert coder.decode([*ids, 10**6]) == decoded


def test_forced_cuts_are_never_inside_a_token(coder):
    word = "".join(map(coder.alphabet.__getitem__, "日本語abcß".encode()))
    assert "".join(coder.cut(word)) == word and len(coder.cut(word)) > 1
    assert all(p[i : i + 2] in coder.inner for p in coder.cut(word) for i in range(len(p) - 1))


def test_deal_is_the_heap():
    for _ in range(200):
        loads = [RNG.randrange(50) for _ in range(RNG.randrange(1, 9))]
        size, count = RNG.randrange(1, 20), RNG.randrange(0, 60)
        heap, want = [(x, j) for j, x in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            x, j = heapq.heappop(heap)
            want[j] += 1
            heapq.heappush(heap, (x + size, j))
        assert sharding.deal(list(loads), size, count) == want


def test_word_hashes_ignore_place_and_case():
    a = hashing.word_hashes("Foo bar\tFOO\nBar  baz")
    assert a[0] == a[2] and a[1] == a[3] and len(set(a.tolist())) == 3
    long = "ab cd " * 300_000
    assert len(np.unique(hashing.word_hashes(long))) == 2 and len(hashing.word_hashes(None)) == 0
    assert len(hashing.shingle_set("a b c d")) == 1 and len(hashing.shingle_set("a b c d e f")) == 2 and len(hashing.shingle_set(" \n")) == 0


def _sets(similarity, n=400):
    common = int(2 * n * similarity / (1 + similarity))
    base = hashing.series(3 * n, RNG.randrange(1 << 40))
    return np.sort(base[:n]), np.sort(np.r_[base[:common], base[n : 2 * n - common]])


def test_fingerprints_estimate_similarity():
    for s in (0.0, 0.3, 0.6, 0.9, 1.0):
        got = [fingerprints.likeness(*map(fingerprints.bins, _sets(s))) for _ in range(15)]
        assert abs(np.mean(got) - s) < 0.03
    assert fingerprints.fingerprint(None) == "" and fingerprints.likeness(None, None) == 1.0 and fingerprints.likeness(None, fingerprints.bins(_sets(1)[0])) == 0.0
    low = fingerprints.bins(hashing.series(3, 1))
    assert (fingerprints.unpack(fingerprints.pack(low)) == low).all()


def test_sketch_fills_and_estimates():
    for n in (1, 2, 7, 500):
        assert (minhash.sketch(hashing.series(n, n), 224) != np.iinfo(np.uint64).max).all()
    for s in (0.3, 0.85):
        got = [(lambda a, b: (minhash.sketch(a, 224) == minhash.sketch(b, 224)).mean())(*_sets(s)) for _ in range(10)]
        assert abs(np.mean(got) - s) < 0.05


def test_parity_is_a_lower_bound():
    for _ in range(50):
        a, b = _sets(RNG.random(), RNG.randrange(2, 300))
        apart = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view(np.uint64).tolist())
        assert apart <= len(np.setxor1d(a, b))


def test_bands_find_linked_sets():
    for _ in range(100):
        a, b = _sets(0.86, 300)
        assert set(minhash.bands(a).tolist()) & set(minhash.bands(b).tolist())


def test_templates():
    window = lambda t: decontaminate.windows(*decontaminate.template(t)[1:], 8)[1].tolist()
    assert window("If Anna has 3 red apples and buys 4 km more") == window("If Bob has 17 red apples and buys 9 miles more!")
    assert window("If Anna has 3 red apples and buys 4 km more") != window("If Anna has 3 red pears and buys 4 km more")
    assert window("A B C D E F G H I J") == []


def test_only_words_of_items_are_hashed(monkeypatch):
    """A window with a word of no item matches nothing; with the items' words at hand, the same windows match and other words cost no hash."""
    hashed, whole = [], decontaminate._hashes
    monkeypatch.setattr(decontaminate, "_hashes", lambda word: hashed.append(word) or whole(word))
    item = "If Anna has 3 red apples, and Straße ΣΑΣ buys 4 days more for the İstanbul of - ten"
    words = [w for w in item.split() for w in (w, w.lower(), w.upper(), w.title(), f"({w})")] + [f"x{chr(97 + i)}" for i in range(26)] + ["Eve", "17", "5kg", "hours", "ﬁne", "ẞ", "-", "+", "..."]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, 60)) for _ in range(30)] + [item, None, "", item.upper() + " " + item.replace("Anna", "Bob").replace("3", "9"), "word"] + item.split() + [item + "\u2028" + item] * 2
    lengths = [(kind, n) for kind in (decontaminate.TEMPLATE, decontaminate.WORDS) for n in (3, 8)]
    wanted = np.sort(np.array([r[4] for r in decontaminate._windows([item], lengths, decontaminate._Words())], np.int64).view(np.uint64))
    want = [(i, *r[1:]) for i, t in enumerate(texts) for r in decontaminate._windows([t], lengths, decontaminate._Words(), wanted)]
    assert len({r[0] for r in want}) > 5
    hashed.clear()
    vocabulary = frozenset(form for w in item.split() for form in decontaminate._forms(w)[1:])
    assert sorted(decontaminate._windows(texts, lengths, decontaminate._Words(vocabulary), wanted)) == sorted(want)
    assert hashed and set(hashed) <= vocabulary | {"straße", "i̇stanbul"}


def test_texts_are_taken_together():
    texts = ["a" * 70_000, None, "b" * 40_000, "", "c" * 300_000, "d"]
    assert [t for _, group in decontaminate._together(texts) for t in group] == texts
    assert [start for start, _ in decontaminate._together(texts)] == [0, 3, 5] and list(decontaminate._together([])) == []


def brute_kneser_ney(counted, alphabet):
    """P(last | sequence) by the recursion as it is written, from {sequence of four: count}."""
    levels = {4: dict(counted)}
    for n in (3, 2, 1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
    discounts = {}
    for n, c in levels.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discounts[n] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)

    def p(g):
        n = len(g)
        if not n:
            return 1 / (alphabet + 1)
        after = {k: v for k, v in levels[n].items() if k[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total, d = sum(after.values()), discounts[n]
        return max(after.get(g, 0) - d, 0) / total + d * len(after) / total * p(g[1:])

    return p


def test_language_models_are_kneser_ney():
    texts = {"en": "the cat and the dog that are in the house with this", "fr": "le chat et le chien qui sont dans la maison avec cette"}
    rows = {}
    for k, t in texts.items():
        whole = language.characters(t * 3).astype("<u4").tobytes().decode("utf-32-le")
        for i in range(len(whole) - 3):
            rows[k, whole[i : i + 4]] = rows.get((k, whole[i : i + 4]), 0) + 1
    number = {"en": 0, "fr": 1}
    model = language.fit(["en", "fr"], np.array([number[k] for k, _ in rows]), [g for _, g in rows], np.array(list(rows.values())))
    alphabet = sorted({g[-1] for _, g in rows})
    brute = [brute_kneser_ney({g: n for (k, g), n in rows.items() if k == lang}, len(alphabet)) for lang in number]
    seen = ["".join(RNG.choice([*alphabet, "漢"]) for _ in range(4)) for _ in range(300)] + [g for _, g in rows]
    points = np.array([[ord(c) for c in g] for g in seen], np.uint32)
    for own, p in zip(model._logs(points), brute, strict=True):
        assert np.allclose(np.exp(own), [p(g) for g in seen], rtol=1e-9)
    # Probabilities of all characters after a history sum to one.
    for p in brute:
        assert abs(sum(p(" th" + c) for c in [*alphabet, "漢"]) - 1) < 1e-9
    mixed = ["the house and the cat", None, "dans la maison", "12 !?", "", "a" * 700_000, "the house and the cat"]
    got = model.predictions(mixed)
    assert [g[0] for g in got][:5] == ["en", "und", "fr", "und", "und"] and got[0] == got[6] == model.predict(mixed[0]) and got[1] == ("und", 0.0, True)
    for text, (_, score, _) in zip(mixed, got, strict=True):
        whole = "".join(map(chr, language.characters(text)))
        if whole and len(whole) < 100:
            odds = [sum(np.log(p(whole[i : i + 4])) for i in range(len(whole) - 3)) for p in brute]
            assert abs(score - 1 / (1 + np.exp(min(odds) - max(odds)))) < 1e-9


def test_quality_model_learns():
    good = [" ".join(RNG.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(RNG.choice(["ALPHA!!", "BETA$$", "gamma***"]) for _ in range(30)) for _ in range(60)]
    rows, y = [quality.features(t) for t in good + bad], np.array([1] * 60 + [0] * 60)
    model = quality.Model(quality.descend(rows[::2], y[::2], quality.ratios(rows[::2], y[::2])), 1.0, 0.0)
    margins = np.array([model.margin(r) for r in rows[1::2]])
    assert margins[y[1::2] == 1].min() > margins[y[1::2] == 0].max()
    assert 0 <= model.score("") <= 1 and len(quality.features(None)) == 0 and quality.logistic(margins, y[1::2])[0] > 0


def test_merged_blocks_are_equal_prefixes():
    for _ in range(20):
        shards = [np.array([RNG.randrange(3) for _ in range(RNG.randrange(40, 90))], np.uint8) for _ in range(RNG.randrange(1, 5))]
        depth = 7
        place, block = suffixes.merged_blocks(shards, depth)
        cyclic = [bytes(np.roll(s, -i)[:depth]) for s in shards for i in range(len(s))]
        assert sorted(place.tolist()) == list(range(len(cyclic)))
        ordered = [cyclic[p] for p in place]
        assert ordered == sorted(cyclic)
        assert [a == b for a, b in zip(ordered, ordered[1:], strict=False)] == (block[1:] == block[:-1]).tolist()


def test_contexts_cover_every_string_and_pieces_agree():
    data = np.array([RNG.randrange(97, 101) for _ in range(3000)], np.uint8)
    owner, body, _, start, place, end = suffixes.contexts(data)
    assert start[0] == 0 and end[-1] == 3000 and (start[1:] == end[:-1] - suffixes.SPAN + 1).all() and ((place >= start) & (place + suffixes.KEY <= end)).all()
    assert all(len(x) == 0 for x in suffixes.contexts(data[:49]))


def test_fingerprint_bins_by_hand():
    """One hash a shingle, least value a bin, and an empty bin's own walk to the first filled one, in plain loops."""
    for n in (1, 3, 40, 700, 5000):
        shingles = hashing.series(n, 1000 + n)
        filled = {}
        for h in hashing.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).tolist():
            at, value = h >> 55, h & ((1 << 55) - 1)
            filled[at] = min(filled.get(at, value), value)
        want = []
        for at in range(fingerprints.BINS):
            stop = at
            for step in [] if at in filled else fingerprints._steps()[at].tolist():
                if step in filled:
                    stop = step
                    break
            else:  # a walk that met none goes on to the next filled bin
                while stop not in filled:
                    stop = (stop + 1) % fingerprints.BINS
            want.append(int(hashing.mix(np.array([filled[stop]], np.uint64))[0]) & 15)
        assert fingerprints.bins(shingles).tolist() == want
    for share in (0.0, 0.3, 0.6, 0.9):
        errors = []
        for seed in range(20):
            values = hashing.series(2000, 7000 + seed)
            both = int(1000 * share)
            a, b = values[:1000], np.r_[values[:both], values[1000 : 2000 - both]]
            true = both / (2000 - both)
            errors.append(fingerprints.likeness(*[fingerprints.unpack(fingerprints.pack(fingerprints.bins(x))) for x in (a, b)]) - true)
        assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.12


def test_dual_descent_reaches_the_optimum():
    """Weights against a dense solver of the same hinge loss run much longer, and ratios against counts by hand."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.choice(40, 12, p=np.linspace(1, 3, 40) / 80 if i % 3 else np.linspace(3, 1, 40) / 80)) for i in range(90)]
    y = np.array([int(i % 3 > 0) for i in range(90)])
    ratio = quality.ratios(rows, y)
    width = quality.WIDTH
    for f in range(40):
        share = [(1 + sum(f in r for r, t in zip(rows, y, strict=True) if t == k)) / (width + sum(len(r) for r, t in zip(rows, y, strict=True) if t == k)) for k in (0, 1)]
        assert abs(ratio[f] - np.log(share[1] / share[0])) < 1e-12
    x = np.zeros((90, 41))
    for i, r in enumerate(rows):
        x[i, r], x[i, 40] = ratio[r] / np.sqrt(len(r)), 1
    sign = np.where(y > 0, 1.0, -1.0)
    cost = 0.5 / np.where(y > 0, (y > 0).mean(), (y <= 0).mean())

    def primal(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()

    alpha, gram = np.zeros(90), (x * sign[:, None]) @ (x * sign[:, None]).T
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20_000):  # projected gradient on the dual
        alpha = np.clip(alpha + (1 - gram @ alpha) * step, 0, cost)
    best = primal((x * sign[:, None]).T @ alpha)
    got = quality.descend(rows, y, ratio, rounds=200, mixing=1.0)
    own = np.append(got[:40] / np.where(ratio[:40] == 0, 1, ratio[:40]), got[width])
    assert abs(primal(own) - best) < 1e-3 * best


def test_whole_words_have_shapes():
    assert quality.shape("a1!" * 30) == "a0!" * 30 and quality.shape("HTTPServer") == "AAaa"


def test_blocks_by_binary_search(spark):
    for cuts in ([], [5], [1, 4], list(range(-7, 300, 7))):
        d = spark.range(-20, 320)
        got = [r[0] for r in d.select(fingerprints._place(d["id"], cuts)).collect()]
        assert got == np.searchsorted(np.array(cuts, np.int64), np.arange(-20, 320), "right").tolist()


def test_contexts_of_many_documents_are_those_of_each():
    texts = [bytes(RNG.randrange(97, 101) for _ in range(n)) for n in (0, 300, 49, 50, 1000, 7, 2000)]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    each = [suffixes.contexts(np.frombuffer(t, np.uint8)) for t in texts]
    offsets = np.cumsum(sizes) - sizes
    for i, got in enumerate(suffixes.contexts(data, sizes)):
        assert got.tolist() == np.concatenate([e[i] + (o if i > 2 else e[i].dtype.type(0)) for e, o in zip(each, offsets.tolist(), strict=True)]).tolist()


def test_a_bucket_is_answered_in_parts():
    """Parts give the answers of the whole, in memory that does not follow the bucket's size (the whole takes tens of bytes for each of its own)."""
    rng = np.random.default_rng(5)
    left, doc = rng.integers(0, 27, 30_000).astype(np.uint8), rng.integers(0, 99, 30_000)
    data = rng.integers(97, 99, int(left.sum()) + 50 * len(left)).astype(np.uint8)
    blob = suffixes._pack(left, np.full(len(left), 26, np.uint8), doc, data)
    peaks, said = [], []
    for part_bytes in (1 << 30, 1 << 16):
        tracemalloc.start()
        said.append(suffixes.answer_strings([blob], part_bytes))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert said[0] == said[1] and peaks[1] * 3 < peaks[0]

"""Decontamination, classifiers, language model, URL rules and the pipeline: brute force, held-out accuracy, odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm.decontaminate import WuManber, decontaminate, keep_clean
from tarn.llm.elias_fano import BOOK, EliasFano, NgramTrie, mapped
from tarn.llm.lm import lm_scores
from tarn.llm.quality import fit_quality, keep_quality, score_quality
from tarn.llm.toxicity import fit_toxicity, score_toxicity, threshold
from tarn.llm.url_rules import SITE_RULES, judge_urls, mine

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "s", 2.0, 4) for i, t in pairs], "doc_id long, text string, n_words int, spans string, score double, carried int")


# -- decontamination -------------------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def brute_hits(docs, items):
    wins = {}
    for item, t in items:
        w = words(t)
        m = min(13, len(w))
        if item is not None:
            for i in range(len(w) - m + 1 if m else 0):
                wins.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in wins:
                    hit.update(range(i, i + m))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def benchmark_case():
    rng = random.Random(6)
    vocabulary = ["a", "b", "Été", "x9", "the", "of", "日本"] + [f"w{i}" for i in range(20)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 30, 60]))) for i in range(20)] + [(100, None), (101, "..."), (None, text(20)), (3, text(15))]
    docs = []
    for i in range(120):
        t = text(rng.randrange(0, 300))
        if i % 3 == 0:
            w = (rng.choice(items)[1] or "").split()
            k = rng.randrange(0, max(1, len(w) - 13))
            t += "\n" + ", ".join(w[k : k + rng.choice([12, 13, 20])]).upper() + "! " + text(5)
        docs.append((i, t))
    return docs + [(500, None), (501, ""), (502, "?!"), (None, docs[0][1]), (3, docs[3][1]), (503, (items[6][1] + " ") * 400)], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontaminate(spark, block_bytes):
    docs, items = benchmark_case()
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate(frame(spark, docs), bench, block_bytes=block_bytes).drop("spans")
    want = brute_hits(docs, items)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    kept = keep_clean(frame(spark, docs), bench, block_bytes=block_bytes)
    assert kept.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.spans) for r in kept.collect()), key=repr) == sorted(((r[0], "s") for r in want if not r[5]), key=repr)
    assert decontaminate(frame(spark, []), bench).count() == 0
    assert decontaminate(frame(spark, docs[:3]), bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0


def test_wu_manber_skips():
    rng = np.random.default_rng(7)
    patterns = np.unique(rng.integers(1, 5, (50, 13)).astype(np.int32), axis=0)
    text = rng.integers(0, 5, 5000).astype(np.int32)
    for at in (0, 700, 4987):
        text[at : at + 13] = patterns[at % len(patterns)]
    place, row = WuManber(patterns).search(text)
    windows = {tuple(p): k for k, p in enumerate(patterns.tolist())}
    want = [(i + 12, windows[tuple(text[i : i + 13].tolist())]) for i in range(len(text) - 12) if tuple(text[i : i + 13].tolist()) in windows]
    assert sorted(zip(place.tolist(), row.tolist(), strict=True)) == want and len(want) >= 3


# -- classifiers -----------------------------------------------------------------------------------------------------


def corpus():
    rng = random.Random(9)
    good = ["river", "stone", "walks", "slowly", "under", "green", "light", "morning", "reads"]
    docs, labels = [], []
    for i in range(900):
        junk, toxic = i % 4 == 0, i % 5 == 1
        w = [rng.choice(good) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(10, 80))]
        if junk:
            w = [x.upper() + "!!" for x in w] if i % 8 else [w[0]] * len(w)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vileword", "vilething", "nastyfoe"]))
        docs.append((i, " ".join(w)))
        if i % 3 or i % 7 == 0:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels


ODD_DOCS = [(9000, None), (9001, ""), (9002, " \n"), (None, "river stone"), (5, "river stone"), (9003, "river " * 50_000)]


@pytest.mark.parametrize(("fit", "score", "label", "fold", "rest"), [(fit_quality, score_quality, "quality", 3, 1), (fit_toxicity, score_toxicity, "toxic", 5, 0)])
def test_classifiers(spark, fit, score, label, fold, rest):
    docs, labels = corpus()
    known = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit(frame(spark, docs), known)
    got = score(frame(spark, docs + ODD_DOCS), model).collect()
    assert len(got) == len(docs) + len(ODD_DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % fold == rest) for r in got)
    truth = {i: (q, t)[label == "toxic"] for i, q, t in ((i, int(i % 4 != 0), int(i % 5 == 1)) for i, _ in docs)}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95
    # what is held out teaches nothing
    flipped = spark.createDataFrame([(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % fold == rest else (i, q, t) for i, q, t in labels] + [(None, 1, 1), (7, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    again = fit(frame(spark, docs), flipped)
    assert np.array_equal(model.features, again.features) and model.bias == again.bias
    none = fit(frame(spark, []), known.limit(0))
    assert score(frame(spark, docs[:5]), none).count() == 5 and score(frame(spark, []), none).count() == 0


def test_keep_quality(spark):
    docs, labels = corpus()
    df = frame(spark, docs + ODD_DOCS)
    model = fit_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept, scores = keep_quality(df, model), score_quality(df, model)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in scores.where("predicted = 1").collect()), key=str)


def test_corrected_threshold():
    positive, unlabelled = np.array([3.0, 4.0, 5.0]), np.array([0.0] * 80 + [0.1] * 10 + [3.5] * 10)
    assert 0.1 < threshold(positive, unlabelled, 0.1) <= 3.0


# -- language model --------------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 3), (1000, 10**6), (1000, 50), (5000, 1 << 62)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        e = EliasFano.of(v)
        assert (e.get(np.arange(n)) == v).all()
        q = rng.integers(0, top + 5, 2000).astype(np.uint64)
        assert (e.successor(q) == np.searchsorted(v, q)).all()
        assert (e.successor(v) == np.searchsorted(v, v)).all()


def test_trie(tmp_path):
    rng = np.random.default_rng(2)
    rows = Counter(zip(rng.integers(0, 300, 20_000).tolist(), rng.integers(1, 40, 20_000).tolist(), rng.integers(0, 9, 20_000).tolist(), strict=True))
    root, two, three = (np.array(x, np.uint64) for x in zip(*sorted(rows), strict=True))
    root *= np.uint64(97)
    n = np.array([rows[k] for k in sorted(rows)])
    data = NgramTrie.build(root, [two, three], n, 0.75).to_bytes()
    t = mapped(data, str(tmp_path))
    assert not list(tmp_path.iterdir()) and len(data) < 9 * len(n)
    count, (a2, a3), (g1, g2) = t.find(root, [two, three])
    c1, c2, on = Counter(), Counter(), Counter()
    for (r, x, y), m in rows.items():
        c1[r] += m
        c2[r, x] += m
        on[r, x] += m * (y > 0)
    d1, d2 = Counter(r for r, _ in c2), Counter((r, x) for r, x, y in rows if y)
    for k, (r, x, y) in enumerate(sorted(rows)):
        assert count[k] == c1[r]
        want = [(c2[r, x] - 0.75) / c1[r], 0.75 * d1[r] / c1[r]]
        got = [BOOK[a2[k]], BOOK[g1[k]]]
        if y:
            want += [(rows[r, x, y] - 0.75) / on[r, x], 0.75 * d2[r, x] / on[r, x]]
            got += [BOOK[a3[k]], BOOK[g2[k]]]
        else:
            assert a3[k] == 0
        assert np.abs(np.log10(want) - np.log10(got)).max() < 0.02
    count, alphas, gammas = t.find(root + np.uint64(1), [two, three])
    assert not count.any() and not any(x.any() for x in alphas + gammas)
    count, (a2, a3), (g1, g2) = t.find(root, [two + np.uint64(50), three])
    assert count.all() and g1.all() and not (a2.any() or a3.any() or g2.any())
    empty = NgramTrie.load(np.frombuffer(NgramTrie.build(root[:0], [two[:0], three[:0]], n[:0], 0.75).to_bytes(), np.uint8))
    assert not empty.find(root[:3], [two[:3], three[:3]])[0].any()


def brute_model(docs, held):
    """(n_tokens, n_known, base, scores of the orders 1 to 3) by text, from counts of all n-grams of training texts."""
    tokens = lambda t: ["<s>", *[x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(UPPER)) if x], "</s>"]
    counts, texts = [Counter(), Counter(), Counter()], 0
    for i, t in docs:
        if not held(i):
            k = tokens(t)
            texts += 1
            counts[0].update(k[1:])
            for size in (2, 3):
                counts[size - 1].update(zip(*[k[j:] for j in range(size)], strict=False))
    n, v = sum(counts[0].values()), len(counts[0])
    on = [Counter(), Counter()]
    then = [Counter(), Counter()]
    for size in (2, 3):
        for g, m in counts[size - 1].items():
            on[size - 2][g[:-1]] += m
            then[size - 2][g[:-1]] += 1

    def p(order, h, w):
        if order == 1:
            return (counts[0][w] + 0.1) / (n + 0.1 * (v + 1))
        c = on[order - 2][h]
        if not c:
            return p(order - 1, h[1:], w)
        return max(0, counts[order - 1][(*h, w)] - 0.75) / c + 0.75 * then[order - 2][h] / c * p(order - 1, h[1:], w)

    def scored(t):
        k = tokens(t)
        sums = [sum(math.log10(p(min(order, i + 1), tuple(k[i + 1 - min(order, i + 1) : i]) if order > 1 else (), k[i])) for i in range(1, len(k))) for order in (1, 2, 3)]
        return len(k) - 1, sum(counts[0][w] > 0 for w in k[1:]), sums

    return n, scored


def lm_corpus():
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["the", "a", "Cat", "dog\n", "sat", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    # clauses that come again, so that trigrams matter
    docs += [(400 + i, " ".join(rng.choice(["the cat sat on", "a dog ran off", "w1 w2 w3 w4", "x"]) for _ in range(12))) for i in range(100)]
    return docs + [(1000, None), (1001, ""), (None, "the cat"), (1, docs[1][1]), (1002, "the cat " * 3000), (1003, "neverseen\x0bword"), (1004, " ".join(f"only{k}" for k in range(50)))]


def in_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize(("share", "bucket", "block"), [(1 << 16, 1 << 20, 1 << 20), (1 << 16, 200, 500), (40, 4, 2000)])
def test_language_model(spark, share, bucket, block, monkeypatch):
    """The scores are those of brute force whether no word is hot, or many words and pairs are, in one block or in many."""
    from tarn.llm import lm

    monkeypatch.setattr(lm, "HOT_SHARE", share)
    monkeypatch.setattr(lm, "BUCKET_NGRAMS", bucket)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    docs = lm_corpus()
    held = spark.createDataFrame([(i, t, in_fold(i)) for i, t in docs], "id long, text string, held boolean")
    numbers, words, pairs, word_of = lm.survey(held)
    assert lm.BEGIN in words and (len(words) > 3 and len(pairs) > 2) == (bucket < 1000)
    assert (words[word_of] != 0).all()
    n, scored = brute_model(docs, in_fold)
    assert numbers[lm.TOKENS] == n
    got = lm_scores(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    for r in got:
        size, known, sums = scored(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (in_fold(r.doc_id), size, known, n)
        assert abs(r.base_score - sums[0]) < 1e-6 * size
        assert abs(r.score - sums[2]) < 0.02 * size
    # higher orders tell more, and the score is nearer to that of the third than to those of the others
    assert sum(r.score for r in got) > sum(scored(texts[r.doc_id])[2][1] for r in got) > sum(r.base_score for r in got)
    assert lm_scores(frame(spark, [])).count() == 0
    alone = lm_scores(frame(spark, [(i, "x y") for i in range(200) if in_fold(i)][:3])).collect()
    assert len(alone) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9 for r in alone)


@pytest.mark.parametrize(("share", "bucket"), [(1 << 16, 1 << 20), (1 << 16, 200)])
def test_language_model_is_kept(spark, share, bucket, monkeypatch):
    """Tries that were written once score any documents, as the pass that learns does, and others as brute force does."""
    from tarn.llm import lm

    monkeypatch.setattr(lm, "HOT_SHARE", share)
    monkeypatch.setattr(lm, "BUCKET_NGRAMS", bucket)
    docs = lm_corpus()
    model = lm.fit(frame(spark, docs))
    key = lambda r: (str(r.doc_id), r.n_tokens, r.score)
    one, two = (sorted(x.collect(), key=key) for x in (lm_scores(frame(spark, docs)), model.score(frame(spark, docs))))
    assert [tuple(r)[:5] for r in one] == [tuple(r)[:5] for r in two]
    assert np.allclose([[r.base_score, r.score] for r in one], [[r.base_score, r.score] for r in two])
    others = [(5000 + k, t) for k, t in enumerate(["the cat sat on a dog", "on sat cat the", "nothing known here", None, "w1 w2 w3 w4 w1 w2"])]
    _, scored = brute_model(docs, in_fold)
    for r in model.score(frame(spark, others)).collect():
        size, known, sums = scored(dict(others)[r.doc_id])
        assert (r.n_tokens, r.n_known) == (size, known) and abs(r.base_score - sums[0]) < 1e-6 * size and abs(r.score - sums[2]) < 0.02 * size


def test_language_model_knows_repeats(spark):
    """Documents that the corpus has twice score above those that it has once."""
    rng = random.Random(5)
    syllables = ["er", "on", "th", "ing", "an", "re", "st", "the", "en", "es"]
    text = lambda: " ".join(rng.choice(["the", "of", "in"]) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(150))
    docs = [(i, text()) for i in range(1000)]
    docs += [(2000 + i, docs[i][1]) for i in range(0, 60)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scores(frame(spark, docs)).collect() if not r.held_out}
    twice = [got[i] for i in range(60) if i in got and 2000 + i in got]
    once = [got[i] for i in range(60, 1000) if i in got]
    assert np.mean(np.array(twice) > np.quantile(once, 0.99)) > 0.95


# -- URL rules -------------------------------------------------------------------------------------------------------


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(UPPER)
    best = None
    for verdict, h, p in SITE_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best


URLS = [None, "", "no scheme", "http://Example.COM/en/x?y#z", "http://example.com/EN/", "https://www.example.com/en/1", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://example.com", "http://example.com?q=/en/", "ftp://x.net/es/a://b", "http://x.net/fr/", "http://net/fr/1", "http://x.org/fr/1", "http:///en/", "http://a.com/\nb", "://com/", "http://x.net/de/9"]


@pytest.mark.parametrize("longest", [14, 0])
def test_mining_is_bounded(spark, longest, monkeypatch):
    """A frequent URL of many tokens doesn't make all of their combinations."""
    from tarn.llm import url_rules

    monkeypatch.setattr(url_rules, "LONGEST", longest)
    urls = ["http://hub.net/es/" + "/".join(f"part{chr(97 + k)}" for k in range(25))] * 60 + [f"http://x{i}.example.com/q" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge_urls(pages).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 120)} == {"allow"}


@pytest.mark.parametrize("longest", [14, 0])
def test_mining_is_whole(spark, longest, monkeypatch):
    """Tokens count in URLs of many frequent tokens too, and so do those beyond the 200 most frequent."""
    from tarn.llm import url_rules

    monkeypatch.setattr(url_rules, "LONGEST", longest)
    rare = [f"p:r{k:02}" for k in range(14)]
    rows = [(["p:t", *rare], "allow")] * 33 + [(["p:t"], "block")] * 2 + [(["p:o"], "block")] * 65
    common = [f"q:c{k:03}" for k in range(200)]
    rows += [(common, label) for label in ("allow", "block") for _ in range(20)] + [(["p:late", "p:z"], "block")] * 10
    rows += [(["p:x", "p:y"], "block")] * 10 + [(["p:x"], "allow")] * 10 + [(["p:y"], "allow")] * 10
    rules = mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.01)
    got = {(items, verdict): confidence for items, verdict, confidence, _ in rules.by_token()}
    assert got[("p:t",), "allow"] == 33 / 35 and (("p:t",), "block") not in got
    assert got[("p:late",), "block"] == 1 and got[("p:x", "p:y"), "block"] == 1
    # brute force over all combinations of the tokens that don't stand in the rows of 200
    want, n = {}, len(rows)
    tokens = sorted({t for r, _ in rows for t in r if t[:3] != "q:c"})
    for size in (1, 2, 3):
        for items in combinations(tokens, size):
            by = Counter(label for r, label in rows if set(items) <= set(r))
            for label, m in by.items():
                c = m / sum(by.values())
                if m >= 0.01 * n and c >= 0.8 and c > sum(x == label for _, x in rows) / n and not any(want.get((k, label), 0) >= c for r in range(1, size) for k in combinations(items, r)):
                    want[items, label] = c
    assert got == want


def brute_rules(rows, min_support, min_confidence):
    n, want = len(rows), {}
    shares = Counter(label for _, label in rows)
    tokens = sorted({t for r, _ in rows for t in r})
    for size in range(1, len(tokens) + 1):
        for items in combinations(tokens, size):
            by = Counter(label for r, label in rows if set(items) <= set(r))
            for label, m in by.items():
                c = m / sum(by.values())
                if m >= min_support * n and c >= min_confidence and c > shares[label] / n and not any(want.get((k, label), 0) >= c for r in range(1, size) for k in combinations(items, r)):
                    want[items, label] = c
    return want


def test_mining_is_exact(spark, monkeypatch):
    """The rules of random URLs, and the verdicts they give, are those of brute force, by FP-growth and level by level; also with a URL of 25 tokens."""
    from tarn.llm import url_rules

    rng = random.Random(31)
    for trial in range(2):
        rows = []
        for _ in range(120):
            r = [t for t in "abcdefg" if rng.random() < 0.5]
            # labels that only combinations of four tell
            rows.append((r + (["twin"] if "a" in r else []), "block" if set("abcd"[: 3 + trial]) <= set(r) or rng.random() < 0.2 else "allow"))
        want = brute_rules(rows, 0.03, 0.7)
        hub = ([f"x{k:02}" for k in range(25)], "block")
        want_hub = {k: v for k, v in brute_rules([*rows, *[(["x00"], "block")] * 10], 0.03, 0.7).items() if "x00" not in k[0]}
        assert max(len(k[0]) for k in want) >= 3
        for longest in (14, 0):
            monkeypatch.setattr(url_rules, "LONGEST", longest)
            rules = mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.03, 0.7)
            got = {(items, verdict): c for items, verdict, c, _ in rules.by_token()}
            assert got == want
            best = sorted(((-c, -s, items, v) for items, v, c, s in rules.rules))
            asked = spark.createDataFrame([(k, [t for t in [*"abcdefg", "twin"] if rng.random() < 0.4]) for k in range(100)], "k int, tokens array<string>")
            for r in asked.select("tokens", url_rules.judge_mined(F.col("tokens"), rules).alias("v")).collect():
                have = {rules.items.get(t, t) for t in r.tokens}
                assert r.v == next((v for *_, items, v in best if set(items) <= have), rules.default)
            whole = mine(spark.createDataFrame([*rows, *[hub] * 10], "tokens array<string>, label string"), 0.03, 0.7)
            got = {(items, verdict): c for items, verdict, c, _ in whole.by_token()}
            assert {k: v for k, v in got.items() if not k[0][0].startswith("x")} == want_hub
            assert {k for k in got if k[0][0].startswith("x")} == {((t,), "block") for t in hub[0]}
    assert mine(spark.createDataFrame([(None, "allow"), (["a", None], "block"), (["a"], None), ([], "allow")], "tokens array<string>, label string")).default == "allow"


def test_urls(spark):
    urls = URLS * 3 + [f"http://h{i % 7}.example.{d}/{lang}/{i}" for i in range(300) for d, lang in (("net", "es"), ("net", "en"), ("org", "es"), ("com", "en"))]
    pages = spark.createDataFrame([(i if i != 4 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule): r.verdict for r in judge_urls(pages).collect()}
    assert len(got) == len(urls) and set(got.values()) <= {"allow", "block"}
    for i, u in enumerate(urls):
        host, path, best = brute_url(u)
        verdict = got[i if i != 4 else None, host, path, best and best[1]]
        assert best is None or verdict == best[0]
        if u and "example.org/es/" in u:
            assert verdict == "block"  # what /es/ says elsewhere
    assert judge_urls(pages.limit(0)).count() == 0


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test")
        assert docs.columns == columns, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.count() == corpus_pipeline.run(spark, folder).count()


def test_pipeline_near_threshold(spark):
    """Near copies of a similarity from 0.80 go, those below it stay."""
    import corpus_pipeline

    pairs = []
    for k, same in enumerate((88, 89, 90, 91, 92, 93)):  # of 100 shingles each: similarities of 0.786, 0.802, ... 0.869
        words = [f"w{k}x{j}" for j in range(208 - same)]
        pairs += [(2 * k, " ".join(words[:104])), (2 * k + 1, " ".join(words[100 - same : 204 - same]))]
    kept = corpus_pipeline.near(spark, frame(spark, pairs), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4, 6, 8, 10]


PASSAGE = [f"bench{k}" for k in range(40)]


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """Tables with nulls, empty, very long and repeated texts, ties, planted passages, near and exact copies, and clashing columns."""
    rng = random.Random(21)
    docs, labels = corpus()
    docs = [(i, t) for i, t in docs]
    plain = lambda n: " ".join(rng.choice(["river", "stone", "walks", "slowly", "under", "green"]) + str(rng.randrange(1000)) for _ in range(n))
    long = plain(30_000)
    planted = {2000: plain(10) + " " + " ".join(PASSAGE[:13]), 2001: plain(3000) + " " + " ".join(PASSAGE[5:18]).upper() + " " + plain(3000), 2002: plain(50) + "\nshort, item. " + plain(5)}
    near = plain(200)
    extra = [(3000, near), (3001, near + " more"), (3002, near.replace(" ", "  \n")), (3003, long), (3004, long + " x"), (3005, plain(60) + " " + " ".join(PASSAGE[:12]) + " no"), (None, plain(30)), (None, None), (3006, None), (3007, ""), (3008, " \n"), (3009, plain(40)), (3009, plain(40))]
    rows = docs + list(planted.items()) + extra
    folder = str(tmp_path_factory.mktemp("odd"))
    columns = "doc_id long, text string, lang string, source string, n_chars long, n_words int, _text string, carried int, kept boolean, id long, label int, component string"
    frame = spark.createDataFrame([(i, t, None, "s", None, k, "x", None, None, 5, 1, "c") for k, (i, t) in enumerate(rows)], columns)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, *[(i, 1, 0) for i in range(2000, 3010)], (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(PASSAGE)), (2, "Short item"), (3, None), (4, "?!"), (None, plain(20)), (1, "river999999")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, planted


def test_pipeline_of_odd_rows(spark, odd_corpus):
    import corpus_pipeline

    folder, rows, planted = odd_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, whole = docs.columns, {tuple(r) for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test")
        seen[name] = docs.collect()
        assert docs.columns == columns and {tuple(r) for r in seen[name]} <= whole, name
    ids = {name: [r.doc_id for r in got] for name, got in seen.items()}
    good = {i for i, _ in rows if i is not None and i >= 2000}
    assert good - {3007, 3008, 3006} <= set(ids["quality"])
    assert 3002 not in ids["exact dedup"] and {3000, 3001} <= set(ids["exact dedup"])
    assert ids["exact dedup"].count(3009) == 2 and sum(r.text is None or not r.text.strip() for r in seen["exact dedup"]) <= 2
    assert {3000, 3003, 3009} <= set(ids["near dedup"]) and not {3001, 3004} & set(ids["near dedup"])
    # every planted passage goes, however long the document; twelve words of one are no window
    assert set(planted) <= set(ids["near dedup"]) and not set(planted) & set(ids["decontamination"])
    assert set(ids["near dedup"]) - set(planted) == set(ids["decontamination"]) and 3005 in ids["decontamination"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(ids["decontamination"])
    assert sorted(map(str, packed)) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_pipeline_of_empty_tables(spark, odd_corpus, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{odd_corpus[0]}/documents.parquet").limit(20).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 20


def test_classifiers_by_finite_differences():
    from tarn.llm import quality, toxicity

    rng = np.random.default_rng(3)
    table, out, bias = rng.normal(size=(30, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    at, share = np.array([1, 5, 29]), np.array([0.5, 0.3, 0.2])
    for label in (0, 1):
        loss, *got = quality.gradients(table, out, bias, at, share, label)
        for what, by in zip((table, out, bias), got, strict=True):
            for place in np.ndindex(what.shape):
                what[place] += 1e-6
                slope = (quality.gradients(table, out, bias, at, share, label)[0] - loss) / 1e-6
                what[place] -= 1e-6
                if what is table:
                    want = by[list(at).index(place[0]), place[1]] if place[0] in at else 0.0
                else:
                    want = by[place]
                assert abs(slope - want) < 1e-4
    zp, zu = rng.normal(size=5), rng.normal(size=9)
    for prior, low in ((0.2, 0.0), (0.9, 3.0)):
        total, gp, gu = toxicity.risk(zp + low, zu - low, prior)
        negative = np.logaddexp(0, zu - low).mean() - prior * np.logaddexp(0, zp + low).mean()
        assert (negative < 0) == (low > 0)
        assert math.isclose(total, prior * np.logaddexp(0, -zp - low).mean() + max(0, negative))
        for z, by in ((zp, gp), (zu, gu)):
            for k in range(len(z)):
                z[k] += 1e-6
                up = toxicity.risk(zp + low, zu - low, prior)[0] if not low else -(np.logaddexp(0, zu - low).mean() - prior * np.logaddexp(0, zp + low).mean())
                z[k] -= 1e-6
                assert abs((up - (total if not low else -negative)) / 1e-6 - by[k]) < 1e-4


def test_subword_features():
    """Buckets don't depend on the words around; grams are those of each word alone."""
    from tarn.llm import quality, toxicity

    words = ["a", "straße", "日本語テキスト", "x" * 500, "<>", "walk", "walks"]
    for features in (quality.word_features, toxicity.word_features):
        bucket, word = features(words)
        for k, w in enumerate(words):
            assert sorted(bucket[word == k]) == sorted(features([w])[0])
    assert [len(quality.word_features([w])[0]) for w in words] == [1 + (len(w) + 2 - 3 + 1) + max(0, len(w) + 2 - 4 + 1) for w in words]
    assert [len(toxicity.word_features([w])[0]) for w in words] == [1 + sum(len(w) > n for n in toxicity.STARTS) for w in words]
    assert quality.repeats(["a", "a", "b", "a", "a", "a"]) == 3

"""Exact, near and line dedup against brute force, and the odd cases of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest

from tarn.llm._common import materialise
from tarn.llm.content_sort import content_sort
from tarn.llm.cuckoo import CuckooFilter
from tarn.llm.lines import LineIndex, dedup_lines, line_key
from tarn.llm.minhash import banding, components, estimate, keep_first, near_duplicates, packed, signatures

ODD = "doc_id long, text string, lang string, _id string, keep_id string, n_lines int, shard int, `we.ird` int"
EXTRA = ("en", "x", "y", 1, 2, 3)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in pairs], ODD)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_content_sort(spark):
    pairs = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (7, " "), (4, "A b"), (6, "a b"), (6, "a b"), (None, "a b"), (None, None), (8, "é" * 200_000), (10, "é" * 200_000)]
    got = content_sort(frame(spark, pairs)).collect()
    assert len(got) == len(pairs)
    groups = {}
    for i, t in pairs:
        groups.setdefault(norm(t), []).append(i)
    for r in got:
        members = groups[next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)]
        least = min(m for m in members if m is not None)
        assert (r.keep_id, r.group_size) == (least, len(members)) and (not r.kept or r.doc_id == least)
    assert sum(r.kept for r in got) == len(groups)
    assert content_sort(frame(spark, [])).count() == 0
    only = content_sort(frame(spark, [(None, "q"), (None, "q")])).collect()
    assert [r.keep_id for r in only] == [None, None] and sum(r.kept for r in only) == 1


def test_content_sort_repeated_smallest(spark):
    got = content_sort(frame(spark, [(6, "z"), (6, "z"), (7, "z")])).collect()
    assert sum(r.kept for r in got) == 1


@pytest.mark.parametrize("only_kept", [False, True])
def test_content_sort_hot_group(spark, only_kept):
    random.seed(1)
    pairs = [(i, "hot  text" if i % 3 == 0 else "warm" if i % 3 == 1 and i < 400 else f"t {i // 2}") for i in range(1500)]
    random.shuffle(pairs)
    got = content_sort(frame(spark, pairs), only_kept=only_kept).collect()
    least, size = {}, {}
    for i, t in pairs:
        least[norm(t)] = min(i, least.get(norm(t), i))
        size[norm(t)] = size.get(norm(t), 0) + 1
    if only_kept:
        assert sorted((r.doc_id, r.text, r.lang, r["we.ird"]) for r in got) == sorted((i, t, "en", 3) for i, t in pairs if least[norm(t)] == i)
    else:
        text = dict(pairs)
        assert all((r.keep_id, r.group_size, r.kept) == (least[k := norm(text[r.doc_id])], size[k], r.doc_id == least[k]) for r in got) and len(got) == 1500


def test_content_sort_is_native(spark):
    plan = content_sort(frame(spark, [(i, f"t{i % 9}") for i in range(300)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(t):
    w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(pairs):
    sets = [(i, shingles(t)) for i, t in pairs]
    ids = {i for i, _ in pairs if i is not None}
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                i, j = sorted((find(i), find(j)))
                top[j] = i
    return {i: find(i) for i in ids}


def near_corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    pairs = []
    for i in range(260):
        if i % 2:
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        pairs.append((i, " ".join(t)))
    pairs += [(300, "One two three"), (301, "one  TWO\nthree"), (302, "one two"), (303, ""), (304, None), (305, " \n"), (306, "É x y z q"), (307, "é x y z q"), (None, pairs[1][1]), (1, pairs[1][1]), (308, "hub a b c d e f g")]
    return pairs


def test_near_duplicates(spark, monkeypatch):
    pairs = near_corpus()
    want = brute(pairs)
    got = near_duplicates(frame(spark, pairs)).collect()
    assert len(got) == len(pairs) and len(set(want.values())) > 100
    by_text = {i: len(shingles(t)) for i, t in pairs}
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id or r.doc_id is None), r
        assert r.n_shingles == by_text[r.doc_id]
    kept = keep_first(frame(spark, pairs))
    assert kept.columns[:2] == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {None, *want.values()}
    assert near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("rows", "hubs"), [(20, 16), (20, 1), (7, 3)])
def test_near_duplicates_in_blocks(spark, monkeypatch, rows, hubs):
    """A cluster of several blocks: pairs across blocks are found too, by hubs or by what they leave."""
    from tarn.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(minhash, "HUBS", hubs)
    pairs = near_corpus(8)
    # a chain, each link near its neighbours only, and far from the hubs
    rng = random.Random(4)
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):
        chain[(7 * i) % 100] = f"d{rng.randrange(9)}{i}"
        pairs.append((2000 + i, " ".join(chain)))
    want = brute(pairs)
    assert all(r.component_id == want.get(r.doc_id) for r in near_duplicates(frame(spark, pairs)).collect())


@pytest.mark.parametrize("threshold", [(50, 100)])
def test_near_duplicates_at_lower_thresholds(spark, threshold):
    """Pairs at the threshold share a band; those a little below it aren't linked."""
    share, rng = threshold[0] / threshold[1], random.Random(12)
    pairs, want = [], {}
    for i in range(0, 400, 2):
        # 100 shingles each, a run of the first text's words goes on in the second
        same = math.ceil(200 * share / (1 + share)) - (i % 8 == 0)
        words = [f"w{rng.randrange(10**9)}" for _ in range(208 - same)]
        pairs += [(i, " ".join(words[:104])), (i + 1, " ".join(words[100 - same : 204 - same]))]
        a, b = (shingles(t) for _, t in pairs[-2:])
        linked = threshold[1] * len(a & b) >= threshold[0] * len(a | b)
        assert len(a) == len(b) == 100 and linked == (i % 8 > 0)
        want |= {i: i, i + 1: i if linked else i + 1}
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, pairs), threshold=threshold).collect()}
    assert got == want


def test_banding():
    assert banding(0.85) == (8, 44)
    for share in (0.05, 0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 1.0):
        rows, bands = banding(share)
        assert rows * bands <= 352 and (1 - share**rows) ** bands <= 1e-6
    for share in (0.0, 0.03):
        with pytest.raises(ValueError):
            banding(share)


def test_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    errors = []
    for share in (0.5, 0.8, 0.9, 1.0):
        k = int(len(a) * share)
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 1 << 63, len(a) - k).astype(np.uint64)]))
        true = k / (2 * len(a) - k)
        s = packed(signatures([a, b]))
        errors.append(abs(estimate(s[0], s[1:])[0] - true))
    assert max(errors) < 0.11 and errors[-1] == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == got[101] == 100 and all(got[200 + i] == 200 for i in range(1, 300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(pairs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t in pairs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in pairs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (i is not None and len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) < i)]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = [(1, "A shared line here\nown one\n\nééééééééééé"), (2, "  a SHARED line here\t\nééééééééééé\nshort"), (3, None), (4, ""), (5, "short\nshort\na shared line here\na shared line here"), (6, "only in this one, twice\nonly in this one, twice"), (None, "a shared line here"), (2, "a shared line here"), (7, "x" * 300_000 + "\n" + "x" * 300_000), (8, "x" * 300_000), (9, "Éééééééééééé"), (10, "éééééééééééé"), (11, "a shared line here")]


def chmods(spark, tmp_path, work):
    """How often Spark's JVM starts chmod while work runs."""
    jvm = spark.sparkContext._jvm
    log = jvm.jdk.jfr.Recording()
    log.enable("jdk.ProcessStart")
    log.start()
    out = work()
    path = jvm.java.io.File(str(tmp_path / "processes.jfr")).toPath()
    log.dump(path)
    log.close()
    return out, sum("chmod" in e.getString("command") for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(path))


def test_tables_start_few_processes(spark, tmp_path):
    """Each of them counts all of an executor's memory once more for a moment: one a file, one for its task, four a table."""
    done, n = chmods(spark, tmp_path, lambda: materialise(spark.range(0, 800, 1, 8), "few"))
    assert done.count() == 800 and n <= 2 * 8 + 4

    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 500)], "a long, b long")
    done, n = chmods(spark, tmp_path, lambda: components(edges, "few-links"))
    assert {(r.node, r.component) for r in done.collect()} == {(i, 0) for i in range(1, 500)}
    tables = len(list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("tarn-few-links-*")))
    assert n <= 6 * tables and tables <= 8  # one a round, and one before them
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_tables_tell_of_damage(spark):
    """Written tables have no files of checksums, but their pages do."""
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    try:
        done = materialise(spark.createDataFrame([("some text",)], "t string"), "damaged")
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
    path = Path(done.inputFiles()[0].removeprefix("file://"))
    data = path.read_bytes()
    assert done.first().t == "some text" and b"some text" in data
    path.write_bytes(data.replace(b"some text", b"same text", 1))
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        done.collect()


def test_lines(spark):
    got = dedup_lines(frame(spark, LINES))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(LINES)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_lines_are_reversible(spark):
    first, second = [p for p in LINES if p[0] in (1, 3, 5, 6)], [p for p in LINES if p[0] in (4, 8, 9, 11)]
    empty = LineIndex.create(spark, 1000)
    one = empty.insert(frame(spark, first))
    both = one.insert(frame(spark, second))
    assert sorted(map(tuple, both.apply(frame(spark, first + second)).collect()), key=repr) == brute_lines(first + second)
    counts = lambda x: sorted((bytes(r.key), r.n_docs, r.min_doc) for r in x.counts.collect())
    back = both.delete(spark.createDataFrame([(i,) for i, _ in second], "doc_id long"))
    assert counts(back) == counts(one)
    gone = both.delete(spark.createDataFrame([(1,), (99,)], "doc_id long"))
    assert sorted(map(tuple, gone.apply(frame(spark, [p for p in first + second if p[0] != 1])).collect()), key=repr) == brute_lines([p for p in first + second if p[0] != 1])
    keys = spark.createDataFrame([(bytearray(line_key(b"a shared line here")),), (bytearray(16),)], "key binary")
    assert [r.n_docs for r in both.contains(keys).collect()] == [3]
    none = back.delete(spark.createDataFrame([(i,) for i, _ in first], "doc_id long"))
    assert none.counts.count() == 0 and none.contains(keys).count() == 0


def test_lines_in_batches(spark, monkeypatch):
    """However many batches: the result of one; keys that the filters deny are never looked up, and shards grow with the keys."""
    from pyspark.sql import functions as F

    from tarn.llm import lines

    rng = random.Random(12)
    pool = [f"a line that is shared {k}" for k in range(60)]
    pairs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"own line {i} {k}" for k in range(rng.randrange(0, 12)))) for i in range(200)]
    monkeypatch.setattr(lines, "SHARD_KEYS", 64)
    want = brute_lines(pairs)
    assert sorted(map(tuple, dedup_lines(frame(spark, pairs), batches=1).collect()), key=repr) == want
    monkeypatch.setattr(lines, "GENERATIONS", 3)
    docs = frame(spark, pairs)
    index = LineIndex.create(spark, 64)
    denied = 0
    for k in range(4):
        part = docs.where(F.col("doc_id") % 4 == k)
        if k == 1:
            keys = lines.line_keys(part).groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("min_doc"))
            before = {bytes(r.key) for r in index.counts.collect()}
            probed = index._probed(keys).collect()
            held = {bytes(r.key) for r in probed} & before
            assert all(r.maybe for r in probed if bytes(r.key) in held) and len(held) > 5
            denied = sum(not r.maybe for r in probed)
            assert denied >= len(probed) - len(held) - 2
        index = index.insert(part)
        if k == 1:
            # what was denied has one row, and no other key is flagged
            assert {bytes(r.key) for r in index.rows.where(F.col("flag") == lines.AGAIN).collect()} == held
    assert denied > 100 and index.shards > 4 and index.since < 3
    assert sorted(map(tuple, index.apply(docs).collect()), key=repr) == want
    assert index.filters.agg(F.sum("n")).first()[0] == index.counts.count()
    # deleting and inserting again
    some = docs.where("doc_id % 5 = 0")
    less = index.delete(some.select("doc_id"))
    rest = [p for p in pairs if p[0] % 5]
    assert sorted(map(tuple, less.apply(frame(spark, rest)).collect()), key=repr) == brute_lines(rest)
    assert less.filters.agg(F.sum("n")).first()[0] == less.counts.count()
    again = less.insert(some)
    assert sorted(map(tuple, again.apply(docs).collect()), key=repr) == want
    # a filter that denies what it should not would show
    blind = spark.createDataFrame([(s, bytearray(lines.CuckooFilter(16).to_bytes()), 0) for s in range(index.shards)], "shard int, filter binary, n long")
    wrong = lines.replace(LineIndex.create(spark, 64).insert(docs.where("doc_id < 100")), filters=blind, shards=index.shards).insert(docs.where("doc_id >= 100"))
    assert sorted(map(tuple, wrong.apply(docs).collect()), key=repr) != want


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    f = CuckooFilter(len(keys))
    f.insert(keys)
    assert f.contains(keys).all() and not f.full
    f = CuckooFilter.from_bytes(f.to_bytes())
    others = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.002
    f.delete(keys[:2000])
    assert f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.01
    small = CuckooFilter(16)
    small.insert(keys[:400])
    assert small.full and small.contains(keys[:400]).all()


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, others don't, and a text's words are its own."""
    from tarn.llm import words

    rng = random.Random(2)
    texts = ["", None, " \n\t", "a", "A b\x0bC\x0cd\re", "é É ß", "x" * 3000 + " y", "a" * 40 + " " + "a" * 41] + [" ".join(rng.choice(["the", "then", "he", "THE", "ab", "ba"]) + rng.choice(["", "s", "S", "1"]) for _ in range(rng.randrange(30))) + rng.choice(["", " ", "\n"]) for _ in range(200)]
    split = [(t or "").encode().lower().split() for t in texts]
    for piece in (1 << 20, 50):
        monkeypatch.setattr(words, "PIECE", piece)
        got = words.word_hashes(texts)
        assert [len(h) for h in got] == [len(w) for w in split]
        by_word = {}
        for h, w in zip(got, split, strict=True):
            for a, b in zip(h.tolist(), w, strict=True):
                assert by_word.setdefault(b, a) == a
        assert len(set(by_word.values())) == len(by_word)
    assert words.word_hashes([]) == [] and [len(h) for h in words.word_hashes([None])] == [0]

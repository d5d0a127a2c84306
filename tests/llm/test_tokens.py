"""Packing and token counts against the libraries themselves."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest

from tarn.llm.byte_tokens import ByteTokens
from tarn.llm.packing import Capacity, best_fit, pack_documents
from tarn.llm.token_counts import check_model, count_pieces, pretokens, token_counts

JSON, RANKS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
TEXTS = ["", None, "Hello world", "a  b", "  a", "a \n b", "x\n\ny ", " é b c", "foo <|endoftext|> bar<|endoftext|>\n", "日本 語 a　b", "don't it's\tx y", "1²³ x", " ", "\n", "a\n", "１２ ½ x", "x\r\ny z", "▁a ▁▁b", "\x1f a", "a  b ▁", "  ", "<s> x</s>", "a\0b", "ﬁ ① \U0001f600 👩‍👩‍👧", "word " * 5000, "x" * 3000, "Ünï cödé " * 400]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i != 3 else None, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, piece int, n_tokens int, _row int")


def test_ids():
    t = ByteTokens(JSON, RANKS, budget=1000)
    for x in TEXTS:
        assert t.ids(x or "") == array("I", t.whole.encode(x or "", add_special_tokens=False).ids).tobytes(), x
    assert len(t) <= 5


def test_counts(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for frequent in (1 << 18, 3):
        got = token_counts(docs(spark, TEXTS * 2), MODEL, limit=1000, frequent=frequent).collect()
        want = sorted((len((t or "").encode()), n := len(p.encode(t or "")), n > 1000) for t in TEXTS * 2)
        assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts(docs(spark, []), MODEL).count() == 0
    check_model(MODEL)
    assert count_pieces(MODEL, ["\n", "▁"]).tolist() == [1, 1]
    assert pretokens("a b\nc") == ["▁a", "▁b", "\n", "c"]


def check_packing(rows, most, lengths=None):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= most
    return len(places)


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    rows = pack_documents(docs(spark), JSON, RANKS).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i if i != 3 else None], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and pieces[0].start == 0
        assert all(r.length == 1024 for r in pieces[1:]) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
    n = check_packing(rows, 1024)
    assert n <= sum(r.length for r in rows) // 1024 + 2
    assert pack_documents(docs(spark, []), JSON, RANKS).count() == 0


def test_packing_many(spark):
    random.seed(4)
    texts = ["hot text of one length " * 7] * 700 + ["w " * random.randrange(0, 1500) for _ in range(800)]
    rows = pack_documents(docs(spark, texts), JSON, RANKS).collect()
    assert check_packing(rows, 1024) <= 1.005 * sum(r.length for r in rows) / 1024 + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_vector_best_fit(score):
    random.seed(5)
    histogram = {random.randrange(1, 1000): random.randrange(1, 500) for _ in range(200)}
    capacity = Capacity(1024, documents=6, attention=700_000) if score == "dot" else Capacity(1024, documents=6)
    if score == "dot":
        histogram = {k: v for k, v in histogram.items() if k * k <= 700_000}
    bins = best_fit(histogram, capacity, (1.0, 0.5, 0.5), score)
    used = defaultdict(int)
    for n, content in bins:
        assert sum(content) <= 1024 and len(content) <= 6 and sum(x * x for x in content) <= (700_000 if score == "dot" else 1 << 20)
        for x in content:
            used[x] += n
    assert dict(used) == histogram and len(bins) <= 4 * len(histogram)
    with pytest.raises(ValueError, match="exceeds"):
        best_fit({1025: 1}, Capacity(1024))


def one_by_one(histogram, capacity, weights, score):
    """Best-fit, item by item: the contents of all bins."""
    import numpy as np

    from tarn.llm.packing import ranks

    cap, w = capacity.vector(), np.asarray(weights, dtype=float)
    left, contents = [], []
    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length])
        for _ in range(histogram[length]):
            fits = [k for k, r in enumerate(left) if (r >= item).all()]
            if fits:
                by = ranks(np.array([left[k] for k in fits]), item, cap, w, score)
                k = min(zip(by.tolist(), [tuple(left[k].tolist()) for k in fits], fits, strict=True))[2]
                left[k], contents[k] = left[k] - item, (*contents[k], length)
            else:
                left.append(cap - item)
                contents.append((length,))
    return sorted(tuple(r.tolist()) for r in left), contents


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 0.5, 0.5), (1.0, 0.0, 0.0), (0.2, 1.0, 0.3)])
def test_best_fit_is_item_by_item(score, weights):
    """The same residuals as item by item, under all three capacities, each of which binds somewhere."""
    from tarn.llm.packing import fewest

    rng = random.Random(8)
    bound = [0, 0, 0]
    for trial in range(40):
        capacity = Capacity(rng.choice([100, 1024]), documents=rng.choice([3, 6, None]), attention=rng.choice([4000, None]) if trial % 2 else None)
        longest = int(min(capacity.tokens, capacity.vector()[2] ** 0.5))
        histogram = {rng.randrange(1, longest + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))}
        bins = best_fit(histogram, capacity, weights, score)
        left, contents = one_by_one(histogram, capacity, weights, score)
        cap = capacity.vector().tolist()
        got = sorted((cap[0] - sum(c), cap[1] - len(c), cap[2] - sum(x * x for x in c)) for n, c in bins for _ in range(n))
        assert got == left and all(min(r) >= 0 for r in got)
        for k in range(3):
            bound[k] += any(r[k] < min(histogram) ** (1, 0, 2)[k] for r in left)
        assert sum(n for n, _ in fewest(histogram, [capacity, Capacity(capacity.tokens)], weights, score)) <= min(len(left), sum(n for n, _ in best_fit(histogram, Capacity(capacity.tokens), weights, score)))
    assert min(bound) > 3
    assert best_fit({600: 10, 100: 10}, Capacity(), weights, "norm") == [(7, (600,)), (2, (600, 100, 100, 100, 100)), (1, (600, 100, 100))] or weights[0] < 1

"""LM scoring: a trigram model over all training tokens in Elias-Fano tries, one for each bucket of the trigrams.

With c the counts of training n-grams and P1 the contract's smoothed unigram, the model interpolates by absolute discounting:

    Pk(w | h) = alpha(hw) + gamma(h) P(k-1)(w | h')    alpha(hw) = max(0, c(hw) - D) / c(h .)    gamma(h) = D d(h) / c(h .)

c(h .) counts the n-grams that go on after h, d(h) the distinct words that do; h' is h without its first word. Where h was
never seen, alpha is 0 and gamma 1. A text begins with a mark, which is context and no token, and ends with one, which is
both. alpha and gamma are the tries' quantised numbers.

Every token but the end begins an n-gram of up to three. A block of documents sends each of its distinct n-grams once, with
how often training documents of the block have it, to the bucket of the n-gram's first word; all orders that begin so, and
all counts that their alpha and gamma need, are there. A bucket adds up, writes its trie to a file, and answers every block
from the mapped file, by successor search relative to the word and then to the pair: its word's exact count, and codes of
alpha and gamma. The block, which kept where its n-grams stand (by their place in the buckets' order), puts the orders together, token by token.

A first word that is hot, with more than a share of all tokens, would make a hot bucket: its n-grams go by first and second
word, and if these are a hot pair too, by all three. What such buckets can't know, the counts of hot words and pairs and
the distinct words after them, is added up over blocks and buckets, and alpha and gamma of hot contexts come from these,
exactly. As a block sends an n-gram once, an n-gram that all documents have is one row a block. Nothing is pruned, capped
or sampled.

``fit`` keeps the tries in a table; ``LanguageModel.score`` sends it the n-grams of any documents. ``lm_scores`` learns and
scores the same documents in one pass over the n-grams: the bucket that has written a trie answers at once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_fold, materialise, partitions
from .elias_fano import BOOK, NgramTrie, mapped
from .words import scramble, word_hashes

U64 = np.uint64
END, BEGIN = U64(0x9AE16A3B2F90404F), U64(0xC949C7DEFE8A21B5)
STEP = U64(0x9E3779B97F4A7C15)
DISCOUNT = 0.75
#: Tokens that a task turns into a block at a time, and n-grams that a bucket has, about.
BLOCK_TOKENS, BUCKET_NGRAMS = 1 << 20, 1 << 20
#: A word or pair is hot with more than one in so many of all tokens, and of a bucket's n-grams; fewer than twice as many are hot.
HOT_SHARE, HOT_IN_BUCKET = 1 << 16, 4
#: Bits of keys after the first word: of the second word's hash, and of the third's. A word that isn't hot has at most
#: some 2**17 followers, of which few share a key then; where hot means more, the second's bits are more.
SECOND, THIRD = 24, 20
#: Rows between the stages: (bucket, block, kind, id, n, data).
TRIE, SENT, ANSWER, OWN, NUMBER = 0, 1, 2, 3, 4
ROWS = "bucket long, block long, kind byte, id long, n long, data binary"
#: What a NUMBER is: distinct words; of hot word i: how often, distinct followers; of hot pair i: how often, how often with a third, distinct thirds.
DISTINCT, WORD, WORD_THEN, PAIR, PAIR_ON, PAIR_THEN = range(6)
#: Numbers that the survey counts: training tokens, training texts, all tokens.
TOKENS, TEXTS, ALL = range(3)


def tokens_of(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the mark of the beginning, and hashes of its words, A-Z lower-cased: what n-grams begin with."""
    return [np.concatenate([[BEGIN], h]) for h in word_hashes(texts)]


def chained(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return scramble(h * STEP ^ w)


def ngrams(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, third, whether there is a third) of texts one after another; a text's last n-gram is (word, END)."""
    one = np.concatenate(tokens)
    last = np.cumsum([len(t) for t in tokens]) - 1
    two = np.append(one[1:], END)
    two[last] = END
    three = np.append(two[1:], END)
    there = np.ones(len(one), bool)
    there[last] = False
    return one, two, three, there


def packed(*columns: np.ndarray) -> bytes:
    """Columns as planes of bytes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(columns[0])], np.int64).tobytes() + b"".join(planes))


def unpacked(data: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in map(np.dtype, types):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return out


def place_in(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x is in a sorted table, -1 where it isn't."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


@dataclass
class Routes:
    """Where n-grams go: sorted hashes of hot words and pairs, the word of each pair, and the number of buckets."""

    words: np.ndarray
    pairs: np.ndarray
    word_of: np.ndarray
    buckets: int
    second: int = SECOND

    def of(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bucket, root in it, keys after the root, hot): hot is 0, or 1 + the hot word's number, or that of the hot pair beyond those."""
        word = place_in(self.words, one)
        hot = np.flatnonzero(word >= 0)
        pair_hash = chained(one[hot], two[hot])
        pair = np.full(len(one), -1)
        pair[hot] = place_in(self.pairs, pair_hash)
        route = one.copy()
        route[hot] = pair_hash
        both = pair >= 0
        route[both] = chained(route[both], np.where(there[both], three[both], U64(0)))
        second = np.where(word >= 0, U64(0), scramble(two.copy()) >> U64(64 - self.second)).astype(U64)
        # a key is 0 only where the root has it, or the n-gram is shorter
        second[word < 0] = np.maximum(second[word < 0], U64(1))
        second[word >= 0] = 1
        third = np.where(there, np.maximum(scramble(three.copy()) >> U64(64 - THIRD), U64(1)), U64(0))
        third[both & there] = 1
        # buckets are ranges of roots
        h = scramble(route) >> U64(16)
        mark = np.where(both, 1 + len(self.words) + pair, 1 + word).astype(np.uint32)
        return (h >> U64(16)) * U64(self.buckets) >> U64(32), h, second << U64(THIRD) | third, mark


def survey(texts: DataFrame) -> tuple[dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """(training tokens, training texts and all tokens; hot words, hot pairs, the word of each pair), counted over all texts."""
    import pyarrow as pa

    def count(batches):
        parts, numbers = [], np.zeros(3, np.int64)

        def out():
            one, two, *_ = ngrams(parts)
            least = max(4, len(one) // (2 * HOT_SHARE))
            rows = [(2, U64(k), U64(0), int(n)) for k, n in enumerate(numbers)]
            pair = chained(one, two)
            for kind, h in ((0, one), (1, pair)):
                # counts of buckets first: most have too few for any word in them
                bucket = (h >> U64(46)).astype(np.int64)
                at = np.flatnonzero((np.bincount(bucket, minlength=1 << 18) > least)[bucket])
                value, first, n = np.unique(h[at], return_index=True, return_counts=True)
                rows += [(kind, v, w, int(m)) for v, w, m in zip(value[n > least], one[at][first][n > least], n[n > least], strict=True)]
            kind, h, word, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), *(pa.array(np.array(x, U64).view(np.int64)) for x in (h, word)), pa.array(n, pa.int64())], names=["kind", "h", "word", "n"])

        for batch in bounded_batches(batches):
            for tokens, held in zip(tokens_of(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                parts.append(tokens)
                numbers += (0 if held else len(parts[-1]), 0 if held else 1, len(parts[-1]))
            if sum(map(len, parts)) > BLOCK_TOKENS:
                yield out()
                parts, numbers = [], np.zeros(3, np.int64)
        if parts:
            yield out()

    found = materialise(texts.mapInArrow(count, "kind byte, h long, word long, n long").groupBy("kind", "h").agg(F.min("word").alias("word"), F.sum("n").alias("n")), "survey", small=True)
    numbers = {r["h"]: r["n"] for r in found.where("kind = 2").collect()}
    numbers = {k: numbers.get(k, 0) for k in (TOKENS, TEXTS, ALL)}
    least = max(numbers[ALL] // HOT_SHARE, BUCKET_NGRAMS // HOT_IN_BUCKET)
    # blocks in which it has less than half of that share may not have counted a hot one; fewer than 2 * HOT_SHARE of each
    hot = found.where((F.col("kind") < 2) & (2 * F.col("n") > least)).toPandas()
    words = np.unique(np.append(hot["h"][hot["kind"] == 0].to_numpy(np.int64).view(U64), BEGIN))
    pairs = hot[hot["kind"] == 1]
    h, word = pairs["h"].to_numpy(np.int64).view(U64), place_in(words, pairs["word"].to_numpy(np.int64).view(U64))
    # a hot pair's word is hot; where blocks said so of the pair alone, it isn't taken for hot
    order = np.argsort(h[word >= 0])
    return numbers, words, h[word >= 0][order], word[word >= 0][order]


def deal(texts: DataFrame, routes, learn: bool, id_col: str) -> DataFrame:
    """Rows SENT for each block and bucket, OWN for each block, and with ``learn`` NUMBERs of hot words and pairs."""
    import pyarrow as pa
    from pyspark import TaskContext

    def rows(batches):
        to = routes.value
        task, start, docs, size = TaskContext.get().partitionId() << 33, 0, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, held, tokens = (list(x) for x in zip(*docs, strict=True))
            sizes = np.array([len(t) for t in tokens])
            one, two, three, there = ngrams(tokens)
            bucket, root, keys, hot = to.of(one, two, three, there)
            train = np.repeat(~np.array(held, bool), sizes) if learn else np.zeros(len(one), bool)
            order = np.lexsort((keys, root))
            r, k = root[order], keys[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
            record = np.empty(len(one), np.uint32)
            record[order] = np.cumsum(new) - 1
            first = order[new]
            n = np.bincount(record, train, len(first)).astype(np.uint32)
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[first]) != 0, [True]]))
            blocks = []
            for i, j in zip(bounds, bounds[1:], strict=False):
                at = first[i:j]
                step = np.diff(root[at], prepend=U64(0))
                blocks.append((int(bucket[at[0]]), SENT, None, None, packed(step, keys[at].astype(U64), n[i:j], hot[at])))
            sink = pa.BufferOutputStream()
            own = pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(held, pa.bool_()), pa.array(sizes)], names=["id", "held", "size"])
            with pa.ipc.new_stream(sink, own.schema) as stream:
                stream.write_batch(own)
            table = sink.getvalue().to_pybytes()
            blocks.append(((task + start) % to.buckets, OWN, None, None, len(table).to_bytes(8, "little") + table + packed(record)))
            if learn:
                w, p = len(to.words), len(to.pairs)
                word = np.where(hot == 0, -1, np.where(hot <= w, hot.astype(np.int64) - 1, 0))
                pair = hot.astype(np.int64) - 1 - w
                word[pair >= 0] = to.word_of[pair[pair >= 0]]
                for kind, of, size_, which in ((WORD, word, w, train), (PAIR, pair, p, train), (PAIR_ON, pair, p, train & there)):
                    count = np.bincount(of[(of >= 0) & which], minlength=size_) if size_ else np.empty(0)
                    blocks += [(task % to.buckets, NUMBER, kind << 32 | int(i), int(count[i]), None) for i in np.flatnonzero(count)]
            bucket_, kind, number, n_, data = zip(*blocks, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_, pa.int64()), pa.array([task + start] * len(blocks), pa.int64()), pa.array(kind, pa.int8()), pa.array(number, pa.int64()), pa.array(n_, pa.int64()), pa.array(data, pa.binary())], names=names)

        names, id_arrow = ["bucket", "block", "kind", "id", "n", "data"], None
        for batch in bounded_batches(batches):
            id_arrow = batch.schema.field(0).type
            ids, texts_, held_ = (batch.column(i).to_pylist() for i in range(3))
            for doc, tokens, held in zip(ids, tokens_of(texts_), held_, strict=True):
                docs.append((doc, held, tokens))
                size += len(docs[-1][2])
                if size > BLOCK_TOKENS:
                    yield from out()
                    start, docs, size = start + len(docs), [], 0
        if docs:
            yield from out()

    return texts.mapInArrow(rows, ROWS)


def added_up(records: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(root, keys, n, hot) of all records with training counts, each n-gram once, sorted."""
    root, keys, n, hot = (np.concatenate([r[k][r[2] > 0] for r in records]) for k in range(4))
    order = np.lexsort((keys, root))
    root, keys, n, hot = root[order], keys[order], n[order], hot[order]
    first = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (keys[1:] != keys[:-1])])) if len(root) else np.empty(0, np.int64)
    return root[first], keys[first], np.add.reduceat(n.astype(np.int64), first) if len(first) else n.astype(np.int64), hot[first]


def split(keys: np.ndarray) -> list[np.ndarray]:
    return [keys >> U64(THIRD), keys & U64((1 << THIRD) - 1)]


def answer(dealt: DataFrame, routes, learn: bool, keep: bool) -> DataFrame:
    """ANSWERs for what was SENT, from the buckets' tries, which are learnt or come as rows TRIE; OWN rows and NUMBERs as they are.

    With ``learn`` also NUMBERs of distinct words, and with ``keep`` rows TRIE.
    """
    import pyarrow as pa

    names = ["bucket", "block", "kind", "id", "n", "data"]

    def rows(batches):
        to, now, held, trie, folder = routes.value, None, [], None, tempfile.gettempdir()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ([],) * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

        def read(data: bytes) -> tuple[np.ndarray, ...]:
            step, keys, n, hot = unpacked(data, U64, U64, np.uint32, np.uint32)
            return np.cumsum(step, dtype=U64), keys, n, hot

        def answered(block: int, record: tuple[np.ndarray, ...]) -> tuple:
            count, alphas, gammas = trie.find(record[0], split(record[1]))
            return now, block, ANSWER, None, None, packed(count.astype(U64), record[3], *alphas, *gammas)

        def learnt() -> Iterator[pa.RecordBatch]:
            """The bucket's trie, its numbers and all its answers."""
            nonlocal trie, held
            root, keys, n, hot = added_up([r for _, r in held])
            data = NgramTrie.build(root, split(keys), n, DISCOUNT).to_bytes()
            trie = mapped(data, folder)
            w, at = len(to.words), np.flatnonzero(np.diff(root, prepend=~root[:1]))
            # a pair that a text ends with goes on nowhere
            at = at[(hot[at] <= w) | (split(keys[at])[1] > 0)]
            which, distinct = np.unique(hot[at], return_counts=True)
            numbers = [(DISTINCT << 32, d) if h == 0 else (WORD_THEN << 32 | h - 1, d) if h <= w else (PAIR_THEN << 32 | h - 1 - w, d) for h, d in zip(which.tolist(), distinct.tolist(), strict=True)]
            yield batch_of([(now, None, NUMBER, k, d, None) for k, d in numbers] + [(now, None, TRIE, None, None, data)] * keep)
            for block, r in held:
                yield batch_of([answered(block, r)])
            held, trie = [], None

        for batch in bounded_batches(batches, 64, 16 << 20):
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                bucket, block, kind, _, _, data = row
                if bucket != now:
                    if held:
                        yield from learnt()
                    now, trie = bucket, None
                if kind == TRIE:
                    trie = mapped(data, folder)
                elif kind != SENT:
                    yield batch_of([row])
                elif learn:
                    held.append((block, read(data)))
                else:
                    trie = trie or NgramTrie.build(*_nothing(), DISCOUNT)
                    yield batch_of([answered(block, read(data))])
        if held:
            yield from learnt()

    spark = dealt.sparkSession
    # as many buckets to each task
    n = partitions(spark)
    dealt = dealt.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(rows, ROWS)


def _nothing() -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    return np.empty(0, U64), [np.empty(0, U64)] * 2, np.empty(0, np.int64)


@dataclass
class Counts:
    """Numbers of the whole corpus: training tokens and texts, distinct tokens, and those of hot words and pairs."""

    tokens: int
    texts: int
    distinct: int
    word: np.ndarray
    word_then: np.ndarray
    pair: np.ndarray
    pair_on: np.ndarray
    pair_then: np.ndarray

    @classmethod
    def of(cls, answers: DataFrame, numbers: dict[int, int], to: Routes) -> Counts:
        # a few for each hot word and pair
        found = {r["id"]: r["n"] for r in answers.where(F.col("kind") == NUMBER).groupBy("id").agg(F.sum("n").alias("n")).collect()}
        w, p = len(to.words), len(to.pairs)
        columns = [np.array([found.get(kind << 32 | i, 0) for i in range(size)], np.int64) for kind, size in ((WORD, w), (WORD_THEN, w), (PAIR, p), (PAIR_ON, p), (PAIR_THEN, p))]
        # a hot pair is one more word after its first
        columns[1] += np.bincount(to.word_of[columns[2] > 0], minlength=w)
        # the mark of the beginning is no token; the end is one, and begins no n-gram
        hot = int((columns[0][to.words != BEGIN] > 0).sum())
        return cls(numbers[TOKENS], numbers[TEXTS], found.get(DISTINCT << 32, 0) + hot + (numbers[TEXTS] > 0), *columns)


def share(over: np.ndarray, under: np.ndarray, nothing: float) -> np.ndarray:
    return np.where(under > 0, np.maximum(over, 0) / np.maximum(under, 1), nothing)


def put_together(record: np.ndarray, sizes: np.ndarray, answers: list[np.ndarray], to: Routes, all_: Counts) -> tuple[np.ndarray, ...]:
    """(n_known, base, score) of a block's documents, from where its n-grams stand and the answers about them."""
    count, hot, alpha2, alpha3, gamma1, gamma2 = (a[record] for a in answers)
    count, hot = count.astype(np.int64), hot.astype(np.int64)
    a2, a3 = BOOK[alpha2], BOOK[alpha3]
    # what a trie doesn't have leaves all to the shorter context
    g1, g2 = (np.where(g > 0, BOOK[g], 1.0) for g in (gamma1, gamma2))
    w = len(to.words)
    pair = np.flatnonzero(hot > w)
    p = hot[pair] - 1 - w
    word = np.flatnonzero(hot > 0)
    of = np.where(hot[word] > w, 0, hot[word] - 1)
    of[hot[word] > w] = to.word_of[p]
    uni = count.copy()
    uni[word] = all_.word[of]
    together = count[word]
    together[hot[word] > w] = all_.pair[p]
    a2[word] = share(together - DISCOUNT, all_.word[of], 0.0)
    g1[word] = share(DISCOUNT * all_.word_then[of], all_.word[of], 1.0)
    a3[pair] = share(count[pair] - DISCOUNT, all_.pair_on[p], 0.0)
    g2[pair] = share(DISCOUNT * all_.pair_then[p], all_.pair_on[p], 1.0)
    # the token after the first of an n-gram; the last one's is the end
    last = np.cumsum(sizes) - 1
    seen = np.append(uni[1:], 0)
    seen[last] = all_.texts
    p1 = (seen + 0.1) / (all_.tokens + 0.1 * (all_.distinct + 1))
    p2 = a2 + g1 * p1
    p3 = np.append(1.0, a3[:-1]) + np.append(0.0, g2[:-1]) * p2
    first = last - sizes + 1
    p3[first] = p2[first]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(doc, seen > 0, len(sizes)).astype(np.int64), np.bincount(doc, np.log10(p1), len(sizes)), np.bincount(doc, np.log10(p3), len(sizes))


def gathered(answers: DataFrame, routes, counts: Counts, id_col: str, id_type: str) -> DataFrame:
    """The scores of each block's documents; a block holds BLOCK_TOKENS tokens, about."""
    import pyarrow as pa

    spark = answers.sparkSession
    known = spark.sparkContext.broadcast(counts)

    def rows(batches):
        now, own, parts = None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            size = int.from_bytes(own[:8], "little")
            docs = pa.ipc.open_stream(own[8 : 8 + size]).read_all().combine_chunks()
            (record,) = unpacked(own[8 + size :], np.uint32)
            columns = zip(*(unpacked(data, U64, np.uint32, *[np.uint8] * 4) for _, data in sorted(parts)), strict=True)
            sizes = docs["size"].to_numpy()
            seen, base, score = put_together(record, sizes, [np.concatenate(c) for c in columns], routes.value, known.value)
            out = pa.Table.from_arrays([docs["id"], docs["held"], pa.array(sizes), pa.array(seen), pa.array(base), pa.array(score)], names=[id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])
            return out.to_batches(4096)

        for batch in bounded_batches(batches, 64, 16 << 20):
            for bucket, block, kind, data in zip(*(batch.column(n).to_pylist() for n in ("bucket", "block", "kind", "data")), strict=True):
                if block != now:
                    if parts:
                        yield from out()
                    now, own, parts = block, None, []
                if kind == OWN:
                    own = data
                else:
                    parts.append((bucket, data))
        if parts:
            yield from out()

    rest = answers.where(F.col("kind").isin(ANSWER, OWN)).select("bucket", "block", "kind", "data")
    rest = rest.repartition(partitions(spark), "block").sortWithinPartitions("block")
    return rest.mapInArrow(rows, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def _texts(docs: DataFrame, folds: int, held_out: int, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(crc_fold(F.col(id_col), folds) == held_out, F.lit(False))
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), held.alias("held"))


def _scores(answers: DataFrame, routes, counts: Counts, docs: DataFrame, id_col: str) -> DataFrame:
    final = gathered(answers, routes, counts, id_col, docs.schema[id_col].dataType.simpleString())
    return final.select(id_col, "held_out", "n_tokens", "n_known", F.lit(int(counts.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


@dataclass
class LanguageModel:
    """Tries by bucket in a written table, and the numbers that go with them."""

    spark: SparkSession
    tries: DataFrame
    routes: Routes
    counts: Counts
    folds: int
    held_out: int

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scores of any documents, learnt from or not, as those of ``lm_scores``. A bucket's trie comes before its n-grams, and these are answered one block at a time."""
        routes = self.spark.sparkContext.broadcast(self.routes)
        sent = deal(_texts(docs, self.folds, self.held_out, id_col, text_col), routes, False, id_col)
        return _scores(answer(self.tries.unionByName(sent), routes, False, False), routes, self.counts, docs, id_col)


def _learnt(docs: DataFrame, folds: int, held_out: int, id_col: str, text_col: str, keep: bool, only_train: bool):
    spark = docs.sparkSession
    texts = _texts(docs, folds, held_out, id_col, text_col)
    numbers, *hot = survey(texts)
    # several buckets a task, so that tasks are alike
    more = max(0, (numbers[ALL] // HOT_SHARE // (BUCKET_NGRAMS // HOT_IN_BUCKET)).bit_length()) if BUCKET_NGRAMS >= HOT_IN_BUCKET else 0
    to = Routes(*hot, max(3 * partitions(spark), -(-numbers[ALL] // BUCKET_NGRAMS)), min(32, SECOND + more))
    routes = spark.sparkContext.broadcast(to)
    sent = deal(texts.where("NOT held") if only_train else texts, routes, True, id_col)
    answers = answer(sent, routes, True, keep)
    if only_train:
        answers = answers.where(F.col("kind").isin(TRIE, NUMBER))
    answers = materialise(answers, "lm-tries" if only_train else "lm-answers")
    return answers, routes, Counts.of(answers, numbers, to)


def fit(docs: DataFrame, folds: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """A model of all rows but the held-out fold; see ``lm_scores`` for what becomes of odd rows."""
    answers, routes, counts = _learnt(docs, folds, held_out, id_col, text_col, True, True)
    return LanguageModel(docs.sparkSession, answers.where(F.col("kind") == TRIE), routes.value, counts, folds, held_out)


def lm_scores(docs: DataFrame, folds: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows but the held-out fold (a null id isn't held out) and scores all whole texts; null and empty
    texts are their end alone. Repeated rows count as often as they come and are scored each. With nothing to learn
    from, every token has the same unigram probability. Empty tables give empty results; other columns of docs are not
    read.
    """
    answers, routes, counts = _learnt(docs, folds, held_out, id_col, text_col, False, False)
    return _scores(answers, routes, counts, docs, id_col)

"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's windows, as rows of word numbers. A shift table over blocks of words says how far a
search may go on from where it stands; where it says 0, the bucket of the block's hash names the patterns that end so,
and these are compared word by word. Many cursors walk through a batch of documents at once, in numpy.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, materialise

WINDOW = 13
BLOCK = 2
#: Bytes of benchmark text that are searched for at a time; a larger benchmark is searched for in several blocks.
BLOCK_BYTES = 16 << 20
#: Words that one cursor walks over.
STRIDE = 192
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; ASCII letters, digits and all characters beyond ASCII make words."""
    return (text or "").encode().translate(_TABLE).split()


class WuManber:
    """The patterns of one length: rows of word numbers from 1 on."""

    def __init__(self, patterns: np.ndarray):
        self.n, self.m = patterns.shape
        self.block = min(BLOCK, self.m)
        self.bits = int(np.clip(np.ceil(np.log2(max(2, self.n * self.m))) + 4, 12, 24))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, dtype=np.int16)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._code(patterns[:, end - self.block + 1 : end + 1].T), self.m - 1 - end)
        last = self._code(patterns[:, self.m - self.block :].T)
        self.order = np.argsort(last, kind="stable")
        self.patterns = patterns[self.order]
        self.first = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1)).astype(np.int64)

    def _code(self, block) -> np.ndarray:
        h = np.zeros(len(block[0]), dtype=np.uint64)
        for w in block:
            h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of last words, pattern rows) of all occurrences in an array of word numbers, where 0 is in no pattern."""
        found, ends = [], len(text)
        at = np.arange(self.m - 1, ends, STRIDE)
        stop = np.minimum(at + STRIDE, ends)
        while len(at):
            shift = self.shift[self._code([text[at - k] for k in range(self.block - 1, -1, -1)])]
            if (here := shift == 0).any():
                found.append(at[here])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        last = np.concatenate(found)
        code = self._code([text[last - k] for k in range(self.block - 1, -1, -1)])
        count = self.first[code + 1] - self.first[code]
        place = np.repeat(last, count)
        row = np.repeat(self.first[code] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        for k in (0, *range(self.m - 1, 0, -1)):  # first word first: it rules most of a bucket out
            same = text[place - self.m + 1 + k] == self.patterns[row, k]
            place, row = place[same], row[same]
        return place, self.order[row]


class Benchmark:
    """The windows of some items, by length, with the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], dtype=np.int32)
            if m := min(window, len(ids)):
                by_length.setdefault(m, []).append((np.unique(np.lib.stride_tricks.sliding_window_view(ids, m), axis=0), number[item]))
        self.searches = [self._search(parts) for parts in by_length.values()]

    @staticmethod
    def _search(parts: list[tuple[np.ndarray, int]]) -> tuple[WuManber, np.ndarray, np.ndarray]:
        """A search for distinct windows; the items of window r are owners[first[r] : first[r + 1]]."""
        windows, row = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
        item = np.repeat([i for _, i in parts], [len(w) for w, _ in parts])
        pairs = np.unique(np.column_stack([row.ravel(), item]), axis=0)
        return WuManber(windows), np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1].astype(np.int32)

    def occurrences(self, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """For each document (its words), the spans [from, to) of words in occurrences, and the items that occur."""
        starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
        flat = np.zeros(starts[-1], dtype=np.int32)
        get = self.numbers.get
        for d, at in zip(docs, starts, strict=False):
            flat[at : at + len(d)] = np.fromiter(map(get, d, repeat(0)), dtype=np.int32, count=len(d))
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set] = [set() for _ in docs]
        for search, first, owners in self.searches:
            place, row = search.search(flat)
            doc = np.searchsorted(starts, place, side="right") - 1
            for d, p, r in zip(doc.tolist(), (place - starts[doc]).tolist(), row.tolist(), strict=True):
                spans[d].append((p - search.m + 1, p + 1))
                items[d].update(owners[first[r] : first[r + 1]].tolist())
        return spans, [{self.names[i] for i in x} for x in items]


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: tuple[int, int] = (1, 20), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. n_hit counts the words inside
    occurrences of windows, n_items the items with such; spans are the places [from, to) in words, merged. A document is
    contaminated if it has hits, and share[1] * n_hit >= share[0] * n_words. Null and empty texts have no words; items
    without words or id have no windows; rows of one item_id are one item; null and repeated document ids stay as they
    are; empty tables give empty results or no hits; other columns are not read.

    With ``carry`` the text follows as _text, and the other columns of docs as fields c0, c1, ... of a struct named carried.

    The benchmark is broadcast in blocks of about ``block_bytes`` of text, and each block is searched for in all
    documents, in a pass of its own that is written before the next: no shuffle, and one block's index in memory.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(None).cast("array<int>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"), *([F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col], F.lit(0)).alias("carried")] if carry else []))
    last_schema = f"`{id_col}` {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>" + (f", _text string, carried {found.schema['carried'].dataType.simpleString()}" if carry else "")
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        index = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in part.collect()], window))
        last = k == blocks - 1

        def search(batches, index=index, last=last):
            for batch in bounded_batches(batches):
                docs = [words_of(t) for t in batch.column(1).to_pylist()]
                spans, held = index.value.occurrences(docs)
                out = []
                for d, s, i, old_s, old_i in zip(docs, spans, held, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if old_s:
                        s += zip(old_s[::2], old_s[1::2], strict=True)
                    s = merged(s) if s else s
                    i = sorted(i | set(old_i or ()))
                    hit = sum(b - a for a, b in s)
                    flat = [x for pair in s for x in pair]
                    out.append((len(d), hit, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), hit > 0 and share[1] * hit >= share[0] * len(d), flat) if last else (flat, i))
                cols = list(zip(*out, strict=True)) if out else [()] * (6 if last else 2)
                if last:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *((batch.column(1), batch.column(4)) if carry else ())], names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"] + ["_text", "carried"] * carry)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.string())), *batch.columns[4:]], names=["_id", "_text", "_spans", "_items"] + ["carried"] * carry)

        found = found.mapInArrow(search, last_schema if last else found.schema)
        if not last:
            found = materialise(found, "searched")
            index.destroy()
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that aren't contaminated, as they are, with all their columns.

    ``how`` goes to ``decontaminate``, whose rules for nulls, empty texts, repeated rows and empty tables hold: rows without
    words, and all rows where the benchmark has no words, stay. Each text goes through the search once.
    """
    found = decontaminate(docs, benchmark, text_col=text_col, carry=True, **how).where("NOT contaminated")
    return found.select(*[(F.col("_text") if c == text_col else F.col(f"carried.c{k}")).alias(c) for k, c in enumerate(docs.columns)])

"""Vector best-fit packing of tokenised documents into sequences.

An item has three sizes: tokens, one document, and attention cost (its length squared). A bin has a capacity in each.
Items go in by falling length, each to the open bin that fits in every dimension and whose weighted residual norm
would be least (``score="norm"``) or whose weighted dot product of item and residual is greatest (``score="dot"``).

All items of one length are alike, and so are all bins of one content: the packer works on the histogram of lengths,
which has at most ``tokens`` rows however large the corpus is, and packs whole classes of bins in one step. What it
returns is a list of bin contents with their counts; items then find their places by their rank among those of their
length. No task and no driver ever holds the items.
"""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, materialise, partitions


#: Documents in a sequence, at most: the first of these with which there are no more sequences than with any other.
DOCUMENTS = (16, 24, 32, 48, 64, None)


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults for documents and attention are those that tokens already imply."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


def ranks(left: np.ndarray, item: np.ndarray, cap: np.ndarray, weights: np.ndarray, score: str) -> np.ndarray:
    """What bins of these residuals are chosen by, the least first, for an item that fits."""
    if score == "norm":
        after = (left - item) / cap
        return (weights * after * after).sum(axis=1)
    return -(weights * (item / cap) * (left / cap)).sum(axis=1)


def best_fit(histogram: dict[int, int], capacity: Capacity, weights=(1.0, 0.5, 0.5), score: str = "norm") -> list[tuple[int, tuple[int, ...]]]:
    """[(number of bins, lengths in each)] for {length: number of items}: the bins of item-by-item best-fit.

    Items go in by falling length, each to the open bin that ranks first, of several the one with the least residuals
    (tokens, then documents, then attention). Equal bins are one class. Where a bin that took an item ranks before the
    others of its class for the next one too (as with "norm", where its residual has shrunk), it takes items until it is
    full, and then the next bin of the class does; else each bin of the class takes one. Both are what happens item by
    item, as nothing else changes meanwhile. The number of classes stays a small multiple of the number of lengths: a
    step uses up the items of a length or a class of bins, and adds two classes at most. Raises ValueError for a length
    that no empty bin can hold.
    """
    cap, w = capacity.vector(), np.asarray(weights, dtype=float)
    left = np.empty((0, 3), dtype=np.int64)
    counts = np.empty(0, dtype=np.int64)
    contents: list[tuple[int, ...]] = []

    def add(residual, count, content):
        nonlocal left, counts
        left, counts = np.vstack([left, residual]), np.append(counts, count)
        contents.append(content)

    for length in sorted(histogram, reverse=True):
        todo, item = int(histogram[length]), np.array([length, 1, length * length], dtype=np.int64)
        if (item > cap).any():
            raise ValueError(f"an item of {length} tokens exceeds the capacity")
        while todo > 0:
            fits = np.flatnonzero((left >= item).all(axis=1) & (counts > 0))
            if not len(fits):
                each = int((cap // item).min())
                if full := todo // each:
                    add(cap - each * item, full, (length,) * each)
                if rest := todo % each:
                    add(cap - rest * item, 1, (length,) * rest)
                break
            rank = ranks(left[fits], item, cap, w, score)
            best = fits[rank == rank.min()]
            at = int(best[np.lexsort(left[best].T[::-1])[0]])
            residual, many, content = left[at].copy(), int(counts[at]), contents[at]
            after = residual - item
            each = 1
            if (after >= item).all() and ranks(after[None], item, cap, w, score)[0] <= rank.min():
                each = int((residual // item).min())
            full = min(many, todo // each)
            counts[at] -= full
            todo -= full * each
            if full:
                add(residual - each * item, full, content + (length,) * each)
            if todo and full < many and todo < each:
                counts[at] -= 1
                add(residual - todo * item, 1, content + (length,) * todo)
                todo = 0
    return [(int(n), c) for n, c in zip(counts, contents, strict=True) if n]


def fewest(histogram: dict[int, int], capacities: list[Capacity], weights=(1.0, 0.5, 0.5), score: str = "norm") -> list[tuple[int, tuple[int, ...]]]:
    """The packing with the fewest bins of those under each of the capacities, the first of several; capacities that can't hold a length are passed over, but for the last."""
    found = []
    for c in capacities:
        if c is capacities[-1] or all((np.array([n, 1, n * n]) <= c.vector()).all() for n in histogram):
            found.append(best_fit(histogram, c, weights, score))
    return min(found, key=lambda bins: sum(n for n, _ in bins))


def places(bins: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset), sorted: the items of a length with ranks from first rank on take one sequence each from first sequence on."""
    rows, used, first = [], {}, 0
    for count, content in bins:
        offset = 0
        for length in content:
            rank = used.get(length, 0)
            rows.append((length, rank, first, offset))
            used[length] = rank + count
            offset += length
        first += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return tuple(table.T)


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, most: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, _row (unique).

    A document is its ids and then end_id; null text counts as empty. One of more than ``most`` ids is cut so that all
    pieces but the first have ``most``.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    id_type = docs.schema[id_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long, _row long"

    def cut(batches):
        from .byte_tokens import ByteTokens

        tokens, end = ByteTokens(json_path, ranks_path), np.array([end_id], dtype="<u4").tobytes()
        row = TaskContext.get().partitionId() << 33
        for batch in bounded_batches(batches):
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = tokens.ids(text or "") + end
                n = len(ids) // 4
                start, length, piece = 0, n % most or min(n, most), 0
                while start < n:
                    at.append(i)
                    out.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), row))
                    start, length, piece, row = start + length, most, piece + 1, row + 1
            piece, start, length, crc, rows = (list(x) for x in zip(*out, strict=True)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, rows))], names=[id_col, "piece", "start", "length", "ids_crc32", "_row"])

    assert sys.byteorder == "little"
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacities: list[Capacity], weights=(1.0, 0.5, 0.5), score: str = "norm") -> DataFrame:
    """pieces (length, _row and any others) with sequence_id and offset instead of _row, packed as ``fewest`` says.

    ``pieces`` must give the same rows each time it is read, as a written table does. Empty tables give empty results;
    equal lengths are told apart by _row, so ties and repeated rows each get a place of their own.
    """
    import pyarrow as pa

    chunks = min(4096, max(1, partitions(pieces.sparkSession)))
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)))
    counts = dealt.groupBy("length", "_chunk").count()
    # at most `tokens` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    length, rank, first, offset = places(fewest(histogram, capacities, weights, score))
    span = int(rank.max(initial=0)) + max(histogram.values(), default=0) + 1
    keys = length * span + rank

    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("_row")) - 1)
    ranked = ranked.join(starts, ["length", "_chunk"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    out = [c for c in pieces.columns if c != "_row"]
    ranked = ranked.select(*out, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank") + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            n = np.asarray(batch.column("length").to_numpy(zero_copy_only=False), dtype=np.int64)
            r = np.asarray(batch.column("_rank").to_numpy(zero_copy_only=False), dtype=np.int64)
            at = np.searchsorted(keys, n * span + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(first[at] + r - rank[at]), pa.array(offset[at])], names=[*out, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: Capacity | list[Capacity] | None = None, end_id: int = 2, weights=(1.0, 0.5, 0.5), score: str = "norm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise documents, cut the long ones, and pack the pieces: id, piece, start, length, ids_crc32, sequence_id, offset.

    Of several capacities, which must agree in tokens, the one with the fewest sequences is taken, by default of those
    with ``DOCUMENTS``: the tightest bound of documents that costs no sequence. Null text counts as empty (the end id alone); null
    and repeated ids stay as they are, each row a document of its own; an empty table packs into nothing; other columns
    of docs are not read. Tokenised once: the pieces' numbers are written to the shared folder, and only they are
    shuffled.
    """
    capacities = capacity if isinstance(capacity, list) else [capacity] if capacity else [Capacity(documents=n) for n in DOCUMENTS]
    if len({c.tokens for c in capacities}) != 1:
        raise ValueError("capacities differ in tokens")
    pieces = token_pieces(docs, json_path, ranks_path, capacities[0].tokens, end_id, id_col, text_col)
    return pack(materialise(pieces, "pieces"), capacities, weights, score)

"""Token counts without ids: pieces are counted once per distinct pre-token, joined to each document's pre-tokens, and summed.

In a sentencepiece BPE no piece goes on from a visible character to a space mark, and none holds a newline, so that
encoding a text is encoding its pre-tokens one by one: a newline, or space marks and the visible characters after
them. ``check_model`` asserts both of the model at hand.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, materialise

MARK = "▁"
UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; empty strings among them count nothing."""
    if not text:
        return []
    if "  " in text or "\x1f" in text or MARK in text or text[0] == " ":
        return UNIT.findall(MARK + text.replace(" ", MARK))
    return (MARK + text).replace(" ", "\x1f" + MARK).replace("\n", "\x1f\n\x1f").split("\x1f")


@lru_cache(maxsize=1)
def _processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def check_model(model_path: str) -> None:
    """Raise ValueError if the model's pieces could cross pre-tokens."""
    p = _processor(model_path)
    for i in range(p.get_piece_size()):
        s = p.id_to_piece(i)
        if "\n" in s or re.search(f"[^{MARK}]{MARK}", s):
            raise ValueError(f"piece {s!r} crosses pre-tokens")
    if "".join(p.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}" or len(p.encode("\n")) != 2:
        raise ValueError("the model doesn't mark spaces as pre-tokens need")


def count_pieces(model_path: str, units: list[str]) -> np.ndarray:
    """The number of pieces of each pre-token. The model puts a space mark before a text: one is taken off, or a newline put between."""
    p = _processor(model_path)
    marked = [u[:1] == MARK for u in units]
    got = p.encode([u[1:].replace(MARK, " ") if m and len(u) > 1 else "\n" + u for u, m in zip(units, marked, strict=True)], num_threads=1)
    # "\n" + u has the mark and the newline before it
    return np.array([len(ids) - (0 if m and len(u) > 1 else 2) for ids, u, m in zip(got, units, marked, strict=True)], dtype=np.int64)


def _frequency(words: DataFrame, most: int) -> int:
    """The least frequency, of a scale of 16 steps an octave, that at most ``most`` pre-tokens reach."""
    step = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 16 * 63 rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return 1 << 62 if least is None else int(np.ceil(2 ** (least / 16) - 1e-9))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, frequent: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The most frequent pre-tokens, at most ``frequent`` of them, are joined by broadcast within each document; all others
    by a shuffle of (row, pre-token, frequency), which by their rarity holds no hot key. Null and empty texts have no
    tokens; null and repeated ids stay as they are, each row a document of its own; an empty table gives an empty
    result; other columns of docs are not read.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    check_model(model_path)
    spark = docs.sparkSession
    texts = docs.select(id_col, text_col)

    def vocabulary(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

        for batch in bounded_batches(batches):
            for text in batch.column(1).to_pylist():
                if text:
                    seen.update(pretokens(text))
            if len(seen) > 400_000:
                yield out()
                seen = Counter()
        yield out()

    def pieces(batches):
        for batch in bounded_batches(batches, 4096):
            units = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_pieces(model_path, units))], names=["unit", "n", "pieces"])

    words = texts.mapInArrow(vocabulary, "unit string, n long").where("unit != ''").groupBy("unit").agg(F.sum("n").alias("n"))
    words = materialise(words.mapInArrow(pieces, "unit string, n long, pieces long"), "pre-tokens")
    top = words.where(F.col("n") >= _frequency(words, frequent)).select("unit", "pieces").toPandas().sort_values("unit")
    known = spark.sparkContext.broadcast((pa.array(top["unit"], pa.string()), top["pieces"].to_numpy(dtype=np.int64)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def by_document(batches):
        units, counts = known.value
        pieces_of = dict(zip(units.to_pylist(), counts.tolist(), strict=True))
        pieces_of[""] = 0
        row = TaskContext.get().partitionId() << 33
        for batch in bounded_batches(batches):
            sizes, sums, rows, rare, rare_n = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                total, odd, odd_n = 0, [], []
                for unit, n in Counter(pretokens(text or "")).items():
                    if (k := pieces_of.get(unit)) is not None:
                        total += n * k
                    else:
                        odd.append(unit)
                        odd_n.append(n)
                sizes.append(len((text or "").encode()))
                sums.append(total)
                rare.append(odd)
                rare_n.append(odd_n)
                rows.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(rare_n, pa.list_(pa.int64()))], names=[id_col, "_row", "n_bytes", "_known", "_rare", "_rare_n"])

    rows = materialise(texts.mapInArrow(by_document, f"`{id_col}` {id_type}, _row long, n_bytes long, _known long, _rare array<string>, _rare_n array<long>"), "frequencies")
    rare = rows.select("_row", F.explode(F.arrays_zip("_rare", "_rare_n")).alias("u")).select("_row", F.col("u._rare").alias("unit"), F.col("u._rare_n").alias("_f"))
    sums = rare.join(words.select("unit", "pieces"), "unit").groupBy("_row").agg(F.sum(F.col("_f") * F.col("pieces")).alias("_others"))
    total = F.col("_known") + F.coalesce("_others", F.lit(0))
    return rows.select(id_col, "_row", "n_bytes", "_known").join(sums, "_row", "left").select(id_col, "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))

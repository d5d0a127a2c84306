"""Deletion vectors: sets of row numbers in 64-bit roaring bitmaps, inline or in files."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, uri_of

#: Deleted rows, by the vectors' own counts, up to which the driver decodes them itself.
FEW_ROWS = 1 << 16
_Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"


def z85_decode(text: str) -> bytes:
    out = bytearray()
    for i in range(0, len(text), 5):
        n = 0
        for c in text[i : i + 5]:
            n = n * 85 + _Z85.index(c)
        out += n.to_bytes(4, "big")
    return bytes(out)


def z85_encode(data: bytes) -> str:
    out = []
    for i in range(0, len(data), 4):
        n, part = int.from_bytes(data[i : i + 4], "big"), []
        for _ in range(5):
            n, r = divmod(n, 85)
            part.append(_Z85[r])
        out += reversed(part)
    return "".join(out)


def _bitmap32(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Values of a standard 32-bit roaring bitmap at a place, and where it ends."""
    cookie = struct.unpack_from("<I", data, at)[0]
    start, runs = at, None
    if cookie & 0xFFFF == 12347:
        n = (cookie >> 16) + 1
        runs = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at + 4), bitorder="little")[:n].astype(bool)
        at += 4 + (n + 7) // 8
    elif cookie == 12346:
        n = struct.unpack_from("<I", data, at + 4)[0]
        at += 8
    else:
        raise ValueError("not a roaring bitmap")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if runs is None or n >= 4:
        at += 4 * n  # offsets: containers follow one another anyway
    parts = []
    for i, (high, less) in enumerate(heads):
        if runs is not None and runs[i]:
            k = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs]) if k else np.empty(0, np.int64)
            at += 2 + 4 * k
        elif less + 1 > 4096:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        else:
            low = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        parts.append(low + (high << 16))
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), at - start


def decode_bitmap(data: bytes) -> np.ndarray:
    """Sorted row numbers of a serialised 64-bit bitmap with its magic number in front."""
    magic = struct.unpack_from("<i", data, 0)[0]
    if magic != 1681511377:
        raise ValueError("not a deletion vector")
    n, at, parts = struct.unpack_from("<q", data, 4)[0], 12, []
    for _ in range(n):
        high = struct.unpack_from("<I", data, at)[0]
        values, size = _bitmap32(data, at + 4)
        parts.append(values + (high << 32))
        at += 4 + size
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def encode_bitmap(rows: np.ndarray) -> bytes:
    """The inverse of ``decode_bitmap``, in array containers (for tests and tools)."""
    rows = np.unique(np.asarray(rows, dtype=np.int64))
    out = [struct.pack("<i", 1681511377), struct.pack("<q", len(highs := np.unique(rows >> 32)))]
    for high in highs:
        low = rows[rows >> 32 == high] & 0xFFFFFFFF
        keys = np.unique(low >> 16)
        body, head, offsets, at = [], [], [], 8 + 8 * len(keys)
        for k in keys:
            part = (low[low >> 16 == k] & 0xFFFF).astype("<u2")
            if len(part) > 4096:
                bits = np.zeros(65536, np.uint8)
                bits[part] = 1
                data = np.packbits(bits, bitorder="little").tobytes()
            else:
                data = part.tobytes()
            head.append(struct.pack("<HH", int(k), len(part) - 1))
            offsets.append(struct.pack("<I", at))
            at += len(data)
            body.append(data)
        out += [struct.pack("<I", int(high)), struct.pack("<II", 12346, len(keys)), *head, *offsets, *body]
    return b"".join(out)


def deleted_rows(store: Store, dv: dict) -> np.ndarray:
    """The row numbers that a deletion vector of the log takes out of its file."""
    if dv["storageType"] == "i":
        return decode_bitmap(z85_decode(dv["pathOrInlineDv"])[: dv["sizeInBytes"]])
    data, at = store.read(vector_file(dv)), dv.get("offset") or 1
    size = struct.unpack_from(">i", data, at)[0]
    return decode_bitmap(data[at + 4 : at + 4 + size])


def vector_file(dv: dict) -> str:
    """The file that holds a vector which isn't inline."""
    place = dv["pathOrInlineDv"]
    if dv["storageType"] != "u":
        return place
    prefix, name = place[:-20], uuid.UUID(bytes=z85_decode(place[-20:]))
    return f"{prefix}/deletion_vector_{name}.bin" if prefix else f"deletion_vector_{name}.bin"


def deleted_frame(spark: SparkSession, store: Store, vectors: list[tuple[str, dict]], file_col: str, row_col: str) -> DataFrame:
    """(file, row number) of all rows that the vectors, each with its data file, take out.

    Few rows are decoded on the driver; else a row a vector is dealt to the executors, which decode it with the part of
    the vectors' file that Spark reads for it.
    """
    schema = f"{file_col} string, {row_col} long"
    import pandas as pd

    if sum(dv.get("cardinality") or FEW_ROWS for _, dv in vectors) <= FEW_ROWS:
        return spark.createDataFrame(pd.concat([pd.DataFrame({file_col: u, row_col: deleted_rows(store, dv)}) for u, dv in vectors]), schema)
    inside = [(u, bytearray(z85_decode(dv["pathOrInlineDv"])[: dv["sizeInBytes"]])) for u, dv in vectors if dv["storageType"] == "i"]
    filed = [(u, store.absolute(vector_file(dv)), dv.get("offset") or 1, dv["sizeInBytes"]) for u, dv in vectors if dv["storageType"] != "i"]
    data = spark.createDataFrame(inside, "file string, data binary")
    if filed:
        where = spark.createDataFrame([(u, uri_of(p), at, n) for u, p, at, n in filed], "file string, vectors string, at int, n int")
        files = spark.read.format("binaryFile").load(list(dict.fromkeys(p for _, p, *_ in filed))).select(F.col("_metadata.file_path").alias("vectors"), "content")
        # behind its size, in 4 bytes
        data = data.unionByName(files.join(where, "vectors").select("file", F.expr("substring(content, at + 5, n)").alias("data")))
    parts = min(len(vectors), 4 * spark.sparkContext.defaultParallelism)

    def decode(frames):
        for pdf in frames:
            for file, bits in zip(pdf["file"], pdf["data"], strict=True):
                yield pd.DataFrame({file_col: file, row_col: decode_bitmap(bytes(bits))})

    return data.repartition(parts).mapInPandas(decode, schema)


def inline(rows) -> dict:
    """A deletion vector that holds its rows itself."""
    data = encode_bitmap(rows)
    padded = data + b"\0" * (-len(data) % 4)
    return {"storageType": "i", "pathOrInlineDv": z85_encode(padded), "sizeInBytes": len(data), "cardinality": len(set(map(int, rows)))}

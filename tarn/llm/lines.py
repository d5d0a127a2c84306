"""Reversible line dedup: exact reference counts of line keys, with sharded cuckoo filters before them.

``LineIndex`` is a log of generations, one for each insertion or deletion of documents, in written tables:

- postings (key, doc_id, gen): one row for each key that a document holds, and gone (doc_id, gen): documents deleted since;
- rows (key, n_docs, min_doc, flag, gen): what a generation adds to a key's count. FRESH says that no document held the
  key before, AGAIN that some did, RESET that the row stands in place of all before it;
- filters (shard, filter, n): a cuckoo filter over the keys that documents hold, for each shard of their hashes.

An insertion asks the filters. Keys that these deny are fresh without a look at the table, and fresh keys that no later
row flags never enter a merge of counts: that a filter denies no key that is held is what makes the counts right. Only
keys that they let through are looked up. A deletion counts the keys of its documents anew from the postings of these
keys, and takes keys that no document holds any more out of the filters. Both write rows for the documents and keys that
they are about and filters of the shards that they touch; ``compact`` writes one generation of many, which happens by
itself after ``GENERATIONS``. Filters that are full are built anew from the exact table, and so are all, in more shards,
when they hold twice the keys that they are meant for. Nothing is changed in place: an operation that was stopped
half-way leaves the old index whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, materialise
from .cuckoo import CuckooFilter

BLANK = b" \t\n\x0b\x0c\r"
LEAST = 10
#: Keys in a shard, about.
SHARD_KEYS = 1 << 18
#: Generations after which an index is compacted.
GENERATIONS = 16
FRESH, AGAIN, RESET = 0, 1, 2


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """128 bits of a line's key, or None for a key of fewer than ``least`` code points."""
    key = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _shard(keys: int) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))


@dataclass(frozen=True)
class LineIndex:
    spark: SparkSession
    postings: DataFrame
    gone: DataFrame | None
    rows: DataFrame
    filters: DataFrame | None
    shards: int | None
    gen: int = 0
    since: int = 0

    @classmethod
    def create(cls, spark: SparkSession, expected_keys: int | None = None) -> LineIndex:
        """An empty index, with filters for the keys expected, or else for those of the first insertion."""
        empty = lambda schema: spark.createDataFrame([], schema)
        return cls(spark, empty("key binary, doc_id long, gen int"), None, empty("key binary, n_docs long, min_doc long, flag int, gen int"), None, expected_keys and _shard(expected_keys))

    @property
    def held(self) -> DataFrame:
        """The postings (key, doc_id) of documents that weren't deleted."""
        if self.gone is None:
            return self.postings.select("key", "doc_id")
        return self.postings.join(self.gone.groupBy("doc_id").agg(F.max("gone").alias("gone")), "doc_id", "left").where("gone IS NULL OR gen > gone").select("key", "doc_id")

    @property
    def counts(self) -> DataFrame:
        """(key, n_docs, min_doc) of all keys that documents hold. Only keys with a flagged row are merged."""
        flagged = self.rows.where(F.col("flag") > FRESH).select("key").distinct()
        plain = self.rows.join(flagged, "key", "left_anti").select("key", "n_docs", "min_doc")
        # a key has a row a generation at most
        last = F.max(F.when(F.col("flag") == RESET, F.col("gen"))).over(Window.partitionBy("key"))
        merged = self.rows.join(flagged, "key", "left_semi").withColumn("last", last).where("last IS NULL OR gen >= last")
        merged = merged.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("min_doc").alias("min_doc")).where("n_docs > 0")
        return plain.unionByName(merged)

    def _of(self, keys: DataFrame, shards: int | None = None) -> DataFrame:
        """keys with the shard of each."""
        shard = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long") % (shards or self.shards)
        return keys.withColumn("shard", shard.cast("int"))

    def _probed(self, delta: DataFrame) -> DataFrame:
        """delta (key, n_docs, min_doc) with ``maybe``: whether the filter of its shard can't rule out that the key is held."""

        def probe(key, left, right):
            if not len(left):
                return left.assign(maybe=[])
            maybe = CuckooFilter.from_bytes(right["filter"][0]).contains(_low(left["key"])) if len(right) else np.zeros(len(left), dtype=bool)
            return left.assign(maybe=maybe)

        return self._of(delta).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "key binary, n_docs long, min_doc long, shard int, maybe boolean")

    def _with(self, keys: DataFrame, insert: bool, **new) -> LineIndex:
        """A new generation, with keys inserted into the filters or deleted from them."""
        room = SHARD_KEYS

        def change(key, left, right):
            # room for as many keys as shards have before there are more of them
            f = CuckooFilter.from_bytes(right["filter"][0]) if len(right) else CuckooFilter(max(2 * room, len(left)))
            n = int(right["n"][0]) if len(right) else 0
            fits = not insert or n + len(left) <= f.room
            if len(left):
                if fits:
                    (f.insert if insert else f.delete)(_low(left["key"]))
                n += len(left) if insert else -len(left)
            return right.__class__({"shard": [key[0]], "filter": [f.to_bytes()], "n": [n], "full": [f.full or not fits]})

        touched = self._of(keys).select("shard", "key")
        if self.filters is None:
            filters = touched.groupBy("shard").applyInPandas(lambda k, a: change(k, a, a.iloc[:0].assign(filter=None, n=0)), "shard int, filter binary, n long, full boolean")
        else:
            # filters of shards without such keys go by as they are
            which = touched.select("shard").distinct()
            asked = self.filters.join(which, "shard", "left_semi")
            filters = touched.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(change, "shard int, filter binary, n long, full boolean")
            filters = filters.unionByName(self.filters.join(which, "shard", "left_anti").withColumn("full", F.lit(False)))
        filters = materialise(filters, "line-filters")
        index = replace(self, gen=self.gen + 1, since=self.since + 1, **new)

        def build(key, pdf):
            f = CuckooFilter(2 * max(room, len(pdf)))
            f.insert(_low(pdf["key"]))
            return pdf.__class__({"shard": [key[0]], "filter": [f.to_bytes()], "n": [len(pdf)]})

        total, full = filters.agg(F.sum("n"), F.coalesce(F.bool_or("full"), F.lit(False))).first()
        if (total or 0) > 2 * SHARD_KEYS * self.shards:
            index = replace(index, shards=_shard(total))
            filters = materialise(index._of(index.counts.select("key")).groupBy("shard").applyInPandas(build, "shard int, filter binary, n long"), "line-filters")
        elif full:
            whole = self._of(index.counts.select("key")).join(filters.where("full").select("shard"), "shard", "left_semi")
            filters = materialise(filters.where("NOT full").drop("full").unionByName(whole.groupBy("shard").applyInPandas(build, "shard int, filter binary, n long")), "line-filters")
        else:
            filters = filters.drop("full")
        index = replace(index, filters=filters)
        return index.compact() if index.since >= GENERATIONS else index

    def compact(self) -> LineIndex:
        """The same index in one generation; this reads and writes all of it."""
        gen = F.lit(self.gen).cast("int")
        counts = self.counts.select("key", "n_docs", "min_doc", F.lit(FRESH).alias("flag"), gen.alias("gen"))
        return replace(self, postings=materialise(self.held.withColumn("gen", gen), "postings"), gone=None, rows=materialise(counts, "line-counts"), since=0)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> LineIndex:
        """The index with these documents added. Rows of one doc_id are one document; the id must not be in the index yet."""
        return self.insert_keys(materialise(line_keys(docs, id_col, text_col, least), "postings"))

    def insert_keys(self, new: DataFrame) -> LineIndex:
        """The same for what ``line_keys`` gave, as a written table."""
        if self.shards is None:
            return replace(self, shards=_shard(new.count())).insert_keys(new)
        gen = F.lit(self.gen + 1).cast("int")
        new = new.dropDuplicates(["key", "doc_id"])
        # partial sums before the shuffle: a line that most documents hold is one row a task
        delta = new.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"))
        row = lambda rows, flag: rows.select("key", "n_docs", "min_doc", F.lit(flag).alias("flag"), gen.alias("gen"))
        if self.filters is None:
            fresh = materialise(row(delta, FRESH), "line-counts")
            rows = fresh
        else:
            probed = materialise(self._probed(delta), "line-delta")
            # the exact table is asked only for what the filters let through
            maybe = probed.where("maybe")
            there = self.rows.join(maybe, "key", "left_semi").groupBy("key").agg(F.max(F.struct("gen", "flag", "n_docs")).alias("last"))
            # a key is held unless its last row reset it to none
            there = there.where(~((F.col("last.flag") == RESET) & (F.col("last.n_docs") == 0))).select("key", F.lit(True).alias("held"))
            maybe = maybe.join(there, "key", "left")
            rows = materialise(row(probed.where("NOT maybe"), FRESH).unionByName(row(maybe.where("held IS NULL"), FRESH)).unionByName(row(maybe.where("held"), AGAIN)), "line-counts")
            fresh = rows.where(F.col("flag") == FRESH)
        return self._with(fresh.select("key"), True, postings=self._both(self.postings, new.select("key", "doc_id", gen.alias("gen"))), rows=self._both(self.rows, rows))

    def _both(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new) if self.gen else new

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index as if these documents had never been inserted; ids that it doesn't hold change nothing."""
        if self.filters is None:
            return self
        gen = F.lit(self.gen + 1).cast("int")
        gone = materialise(ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "line-gone")
        touched = materialise(self.held.join(gone, "doc_id", "left_semi").select("key").distinct(), "line-touched")
        rest = self.held.join(touched, "key", "left_semi").join(gone, "doc_id", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"))
        rows = touched.join(rest, "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "min_doc", F.lit(RESET).alias("flag"), gen.alias("gen"))
        rows = materialise(rows, "line-counts")
        return self._with(rows.where("n_docs = 0").select("key"), False, rows=self.rows.unionByName(rows), gone=gone.select("doc_id", gen.alias("gone")) if self.gone is None else self.gone.unionByName(gone.select("doc_id", gen.alias("gone"))))

    def contains(self, keys: DataFrame) -> DataFrame:
        """(key, n_docs, min_doc) of those keys (column key) that documents hold: filters first, exact counts for what they let through."""
        delta = keys.select("key").distinct().select("key", F.lit(0).cast("long").alias("n_docs"), F.lit(None).cast("long").alias("min_doc"))
        if self.filters is None:
            return self.counts
        return self.counts.join(self._probed(delta).where("maybe").select("key"), "key", "left_semi")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, with_text: bool = False) -> DataFrame:
        """One row per row of docs (which the index holds): id, n_lines, n_dropped, kept_sha256 (and text with ``with_text``).

        A line goes if its key is held by at least 2 documents and another holds it first by id. Null and empty texts
        are one empty line. A null id is no document's: its lines neither count nor go.
        """
        import pyarrow as pa

        repeated = materialise(self.counts.where("n_docs > 1"), "line-repeated")
        n = self.postings.count()
        # a key with more than 1/1000 of all postings: fewer than 1000 of them, so that they can be broadcast
        most = max(1000, n // 1000)
        post = self.held
        hot = F.broadcast(repeated.where(F.col("n_docs") > most).select("key", "min_doc"))
        cold = repeated.where(F.col("n_docs") <= most).select("key", "min_doc")
        dropped = post.join(hot, "key").unionByName(post.join(cold, "key")).where("doc_id > min_doc")
        drops = dropped.groupBy("doc_id").agg(F.collect_list("key").alias("_drop")).withColumnRenamed("doc_id", "_id")
        id_type = docs.schema[id_col].dataType.simpleString()
        base = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
        both = base.join(drops, F.col("_doc") == F.col("_id"), "left").select("_doc", "_text", "_drop")

        def rebuild(batches):
            for batch in bounded_batches(batches):
                lines, gone, shas, texts = [], [], [], []
                for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    parts = (text or "").encode().split(b"\n")
                    kept = parts
                    if drop:
                        away = set(drop)
                        kept = [p for p in parts if line_key(p, least) not in away]
                    out = b"\n".join(kept)
                    lines.append(len(parts))
                    gone.append(len(parts) - len(kept))
                    shas.append(hashlib.sha256(out).hexdigest())
                    texts.append(out.decode() if with_text else None)
                cols = [batch.column(0), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * with_text, names=[id_col, "n_lines", "n_dropped", "kept_sha256"] + ["text"] * with_text)

        return both.mapInArrow(rebuild, f"`{id_col}` {id_type}, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text)


def _low(keys) -> np.ndarray:
    """The last 8 bytes of each key; shards go by the first ones."""
    return np.frombuffer(b"".join(bytes(k)[8:] for k in keys), dtype=np.uint64)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(key, doc_id) for each key of a document, once."""
    import pyarrow as pa

    def keys(batches):
        for batch in bounded_batches(batches):
            out, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                found = {k for k in (line_key(p, least) for p in set(text.encode().split(b"\n"))) if k is not None}
                out.extend(found)
                ids.extend([doc] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(keys, "key binary, doc_id long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", expected_keys: int | None = None, batches: int = 2) -> DataFrame:
    """Index docs in ``batches``, by the hash of their ids, and take their repeated lines out: see ``LineIndex.apply``.

    The batches after the first go through the filters; the result is that of one batch. Other columns of docs are not read.
    """
    keys = materialise(line_keys(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "line-keys")
    index = LineIndex.create(docs.sparkSession, expected_keys)
    if index.shards is None:
        index = replace(index, shards=_shard(keys.count()))
    for k in range(batches):
        index = index.insert_keys(keys.where(F.col("batch") == k).drop("batch"))
    return index.apply(docs, id_col, text_col)

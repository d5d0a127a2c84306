"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from sys import getsizeof

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hadoop without its native library starts chmod for each file and folder that it makes on a local or mounted disk, and
#: until such a child runs its program it counts all of the executor's memory once more. So written tables do without
#: files of checksums, as pages have their own, and without a file that marks success. Other stores have no use for these.
WRITTEN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
READ = {"parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tarn-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    Shuffle partitions are meant for texts; ``small`` says that df has a few numbers for each, and writes fewer files.
    """
    spark = df.sparkSession
    if small:
        df = fewer(df)
    path = new_path(spark, name)
    df.write.options(**WRITTEN).parquet(path)
    return spark.read.options(**READ).schema(df.schema).parquet(path)


def fewer(df: DataFrame) -> DataFrame:
    """df in an eighth of the partitions that are meant for texts; nothing is known of their keys, so that a join deals, and splits, them anew."""
    return df.coalesce(max(1, partitions(df.sparkSession) // 8))


def held(df: DataFrame) -> DataFrame:
    """df, of a few numbers for each text, on the executors' disks until its ``unpersist``; what a lost executor held is computed again.

    For what is used more than once between two written tables: no file is made in the shared folder. Its size is known
    when this returns, so that a join broadcasts what is small.
    """
    df = fewer(df).persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: the held-out rule of the learned operators (null id: null)."""
    return (F.crc32(id_col.cast("string").cast("binary")) % folds).cast("int")


#: Bytes that a worker's cache of words or chunks may hold, about.
CACHE_BYTES = 48 << 20


class Cache(dict):
    """key -> ``make(key)``. Entries are kept while they fit into ``budget`` bytes, about; the others are made each time."""

    def __init__(self, make, budget: int = CACHE_BYTES):
        super().__init__()
        self.make, self.left = make, budget

    def __missing__(self, key):
        value = self.make(key)
        cost = getsizeof(key) + getsizeof(value) + 100  # of the entry itself
        if cost <= self.left:
            self.left -= cost
            self[key] = value
        return value


def bounded_batches(batches, rows: int = 256, size: int = 4 << 20):
    """Slices of Arrow batches, so that Python objects exist for a bounded number of rows, and about ``size`` bytes of text (or one row), at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if batch.nbytes <= size:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        ends = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64)))
        at = done = 0
        while at < batch.num_rows:
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])

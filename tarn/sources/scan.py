"""Scans: the files of a snapshot as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate
from ..functions.values import comparable, from_partition
from .deletion_vectors import deleted_frame
from .snapshot import Snapshot, TableError, physical_name, relative, stats_of
from .store import Store, uri_of

FILE, ROW = "__tarn_file", "__tarn_row"
#: Files whose partition values are broadcast, some MB at most; with more, Spark sizes the join.
BROADCAST_FILES = 10_000


def physical_schema(schema: T.StructType, partitions) -> T.StructType:
    return T.StructType([T.StructField(physical_name(f), f.dataType, True) for f in schema if f.name not in partitions])


def bounds_of(snapshot: Snapshot, add: dict):
    """What the log knows of a file's columns: partition values exactly, others by their statistics."""
    types, parts, stats = {f.name: f for f in snapshot.metadata.schema}, snapshot.metadata.partition_columns, stats_of(add)
    # a deletion vector only takes rows away, so bounds still hold; counts of nulls don't
    whole = not add.get("deletionVector")

    def bounds(name: str):
        f = types[name]
        rows = stats.get("numRecords")
        if name in parts:
            v = comparable(from_partition((add.get("partitionValues") or {}).get(physical_name(f)), f.dataType), f.dataType)
            return (v, v, 0, 1) if v is not None else (None, None, 1, 1)
        p = physical_name(f)
        lo, hi = (stats.get("minValues") or {}).get(p), (stats.get("maxValues") or {}).get(p)
        nulls = (stats.get("nullCount") or {}).get(p) if whole else None
        if isinstance(f.dataType, (T.BooleanType, T.BinaryType)) or isinstance(lo, dict) or isinstance(nulls, dict):
            return None, None, nulls if isinstance(nulls, int) else None, rows
        try:
            lo, hi = comparable(lo, f.dataType), comparable(hi, f.dataType)
        except (ValueError, ArithmeticError):
            lo = hi = None
        if hi is not None and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            hi += 1000  # some writers cut to milliseconds
        return lo, hi, nulls, rows

    return bounds


def prune(spark: SparkSession, snapshot: Snapshot, adds: list[dict], predicate: Predicate | None) -> list[dict]:
    """The files that may hold rows where the predicate is true."""
    if predicate is None:
        return adds
    test = predicate.skipping()
    return [a for a in adds if test(bounds_of(snapshot, a)) is not False]


def exact_partitions(spark: SparkSession, snapshot: Snapshot, adds: list[dict], predicate: Predicate) -> list[dict]:
    """The files where a predicate on partition columns alone is true, as Spark evaluates it."""
    fields = [f for f in snapshot.metadata.schema if f.name in snapshot.metadata.partition_columns]
    rows = {}
    for a in adds:
        rows.setdefault(tuple((a.get("partitionValues") or {}).get(physical_name(f)) for f in fields), []).append(a)
    values = [(k, *(from_partition(v, f.dataType) for v, f in zip(r, fields, strict=True))) for k, r in enumerate(rows)]
    schema = T.StructType([T.StructField("__n", T.LongType())] + [T.StructField(f.name, f.dataType, True) for f in fields])
    true = {r["__n"] for r in spark.createDataFrame(values, schema).where(predicate.column).select("__n").collect()}
    return [a for k, adds_ in enumerate(rows.values()) if k in true for a in adds_]


def scan(spark: SparkSession, store: Store, snapshot: Snapshot, adds: list[dict] | None = None, predicate: Predicate | None = None, identity: bool = False, without_vectors: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a snapshot's files (all, or those in ``adds``), with its columns in order.

    With ``identity``, FILE (as Spark spells it) and ROW follow. The predicate prunes files only: the caller filters.
    Partition values come from the log, by a join on the file, whose rows don't move unless there are more than
    BROADCAST_FILES; a file of the scan that the log doesn't know is an error. Deletion vectors are an anti join on (file, row).
    """
    meta = snapshot.metadata
    schema = schema or meta.schema
    adds = prune(spark, snapshot, snapshot.adds if adds is None else adds, predicate)
    parts = [f for f in schema if f.name in meta.partition_columns]
    extra = [T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())] if identity else []
    if not adds:
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + extra))
    data = physical_schema(schema, meta.partition_columns)
    paths = [store.absolute(relative(a)) for a in adds]
    df = spark.read.schema(data).option("mergeSchema", "false").parquet(*[_literal(p) for p in dict.fromkeys(paths)])
    vectors = [] if without_vectors else [(uri_of(p), a["deletionVector"]) for p, a in zip(paths, adds, strict=True) if a.get("deletionVector")]
    known = parts or vectors or identity
    cols = [F.col(f"`{physical_name(f)}`").alias(f.name) for f in schema if f.name not in meta.partition_columns]
    if known:
        df = df.select(*cols, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    else:
        df = df.select(*cols)
    if parts:
        values = {(uri_of(p), *((a.get("partitionValues") or {}).get(physical_name(f)) for f in parts)) for p, a in zip(paths, adds, strict=True)}
        rows = [(r[0], True, *(from_partition(v, f.dataType) for v, f in zip(r[1:], parts, strict=True))) for r in values]
        listed = spark.createDataFrame(rows, T.StructType([T.StructField(FILE, T.StringType()), T.StructField("__listed", T.BooleanType())] + [T.StructField(f.name, f.dataType, True) for f in parts]))
        if len(rows) <= BROADCAST_FILES:
            listed = F.broadcast(listed)  # Spark doesn't know how few they are
        df = df.join(listed, FILE, "left").where(F.coalesce("__listed", F.raise_error(F.concat(F.lit("not in the log: "), FILE)).cast("boolean"))).drop("__listed")
    if vectors:
        df = df.join(deleted_frame(spark, store, vectors, FILE, ROW), [FILE, ROW], "left_anti")
    return df.select(*[F.col(f"`{f.name}`") for f in schema], *([FILE, ROW] if identity else []))


def _literal(path: str) -> str:
    """A path without the meaning that Spark gives to globs."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def check_readable(snapshot: Snapshot) -> None:
    if snapshot.metadata is None:
        raise TableError("the table has no metadata")

"""Writes: data files with statistics, and the actions that name them."""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate, is_true
from ..functions.values import SchemaError, cast_to, partition_text, stat_value
from ..sources.snapshot import Metadata, Protocol, TableError, physical_name
from ..sources.store import Store, encoded

CDC_FOLDER = "_change_data"
CHANGE = "_change_type"
#: Files that a task of a write with few partition values has open at once.
WRITERS = 8


@dataclass(frozen=True)
class ColumnProperties:
    """Settings of one column: dictionary and statistics on or off, and a bloom filter with its false positives and distinct values."""

    dictionary: bool | None = None
    statistics: bool | None = None
    bloom_filter: bool | None = None
    bloom_filter_fpp: float | None = None
    bloom_filter_ndv: int | None = None

    def options(self, column: str | None = None) -> dict:
        at = f"#{column}" if column else ""
        out = {"parquet.enable.dictionary": self.dictionary, "parquet.column.statistics.enabled": self.statistics, "parquet.bloom.filter.enabled": self.bloom_filter, "parquet.bloom.filter.fpp": self.bloom_filter_fpp, "parquet.bloom.filter.expected.ndv": self.bloom_filter_ndv}
        return {k + at: str(v).lower() for k, v in out.items() if v is not None}


@dataclass(frozen=True)
class WriterProperties:
    compression: str | None = None
    compression_level: int | None = None
    max_row_group_size: int | None = None
    data_page_size_limit: int | None = None
    dictionary_page_size_limit: int | None = None
    bloom_filter_columns: tuple[str, ...] = ()
    statistics_truncate_length: int | None = None
    column_index_truncate_length: int | None = None
    default_column: ColumnProperties | None = None
    columns: dict[str, ColumnProperties] | None = None

    def options(self) -> dict:
        out: dict = {}
        if self.compression:
            out["compression"] = self.compression.lower()
        if self.compression_level is not None:
            out["parquet.compression.codec.zstd.level"] = self.compression_level
        if self.max_row_group_size:
            out["parquet.block.size"] = self.max_row_group_size
        if self.data_page_size_limit:
            out["parquet.page.size"] = self.data_page_size_limit
        if self.dictionary_page_size_limit:
            out["parquet.dictionary.page.size"] = self.dictionary_page_size_limit
        for c in self.bloom_filter_columns:
            out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        if self.statistics_truncate_length:
            out["parquet.statistics.truncate.length"] = self.statistics_truncate_length
        if self.column_index_truncate_length:
            out["parquet.columnindex.truncate.length"] = self.column_index_truncate_length
        if self.default_column:
            out |= self.default_column.options()
        for c, p in (self.columns or {}).items():
            out |= p.options(c)
        return out


@contextlib.contextmanager
def session(spark: SparkSession, **conf: str):
    """Settings that hold for a block; identifiers are case-sensitive in it."""
    conf = {"spark.sql.caseSensitive": "true", **{k.replace("__", "."): v for k, v in conf.items()}}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ConstraintViolation(TableError):
    pass


def generated(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.metadata["delta.generationExpression"] for f in schema if "delta.generationExpression" in f.metadata}


def constraints(metadata: Metadata) -> dict[str, str]:
    """Name -> SQL of everything that each row must make true."""
    out = {k.removeprefix("delta.constraints."): v for k, v in metadata.configuration.items() if k.startswith("delta.constraints.")}
    for f in metadata.schema:
        if "delta.invariants" in f.metadata:
            out[f"invariant of {f.name}"] = json.loads(f.metadata["delta.invariants"])["expression"]["expression"]
    out |= {f"generated {c}": f"`{c}` <=> CAST(({e}) AS {next(f.dataType.simpleString() for f in metadata.schema if f.name == c)})" for c, e in generated(metadata.schema).items()}
    return out


def not_null(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """(path, condition) for each field that must not be null, nested ones where their parents are there."""
    out = []
    for f in schema:
        c = F.col(f"{prefix}`{f.name}`")
        if not f.nullable:
            out.append((f"{prefix}{f.name}".replace("`", ""), c.isNotNull()))
        if isinstance(f.dataType, T.StructType):
            out += [(p, c.isNull() | k) for p, k in not_null(f.dataType, f"{prefix}`{f.name}`.")]
    return out


def conform(df: DataFrame, schema: T.StructType, safe: bool = False) -> DataFrame:
    """df with the schema's columns, cast; missing generated columns computed, other missing ones null."""
    have = {f.name: f.dataType for f in df.schema}
    gen = generated(schema)
    cols = [cast_to(F.col(f"`{f.name}`"), have[f.name], f.dataType, safe).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    df = df.select(*cols)
    for name, e in gen.items():
        if name not in have:
            t = next(f.dataType for f in schema if f.name == name)
            df = df.withColumn(name, F.expr(e).cast(t))
    return df.select(*[F.col(f"`{f.name}`") for f in schema])


def checked(df: DataFrame, metadata: Metadata) -> DataFrame:
    """df that fails when it is written if a row breaks a rule; a rule that comes out null is broken.

    The check is an expression in the same pass: nothing is read twice.
    """
    rules = [(f"NOT NULL {p}", c) for p, c in not_null(metadata.schema)] + [(f"{n}: {sql}", F.expr(sql)) for n, sql in constraints(metadata).items()]
    if not rules:
        return df
    row = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in metadata.schema if not isinstance(f.dataType, (T.VariantType,))]))
    ok = F.lit(True)
    for name, c in rules:
        ok = ok & F.when(is_true(c), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"TARN_CONSTRAINT {name} in row "), F.coalesce(row, F.lit("?")))).cast("boolean"))
    return df.where(ok)


def violation(e: Exception) -> ConstraintViolation | None:
    m = re.search(r"TARN_CONSTRAINT ([^\n]*)", str(e))
    return ConstraintViolation(m[1]) if m else None


def stats_columns(metadata: Metadata) -> list[str]:
    """The columns that get statistics: the configured ones, or the first so many top-level ones."""
    names = [f.name for f in metadata.schema if f.name not in metadata.partition_columns]
    if listed := metadata.configuration.get("delta.dataSkippingStatsColumns"):
        wanted = {c.strip().strip("`") for c in listed.split(",")}
        return [n for n in names if n in wanted]
    n = int(metadata.configuration.get("delta.dataSkippingNumIndexedCols", 32))
    return names if n < 0 else names[:n]


def footer_stats(path: str, fields: list[tuple[str, T.DataType]]) -> str:
    """Statistics of one Parquet file, from its footer, as the log has them."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    place: dict[str, int] = {}
    for i in range(meta.num_columns):
        place.setdefault(meta.schema.column(i).path, i)
    least, most, nulls = {}, {}, {}
    for name, t in fields:
        at = place.get(name)
        if at is None or isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            continue
        lo = hi = None
        n, known, bounded = 0, True, True
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            if s is None or not s.has_null_count:
                known = False
            else:
                n += s.null_count
            if s is not None and s.has_min_max:
                lo, hi = s.min if lo is None or s.min < lo else lo, s.max if hi is None or s.max > hi else hi
            elif s is None or s.null_count < meta.row_group(g).num_rows:
                bounded = False
        if known:
            nulls[name] = n
        if bounded and not isinstance(t, (T.BooleanType, T.BinaryType)):
            if (v := stat_value(lo, t)) is not None:
                least[name] = v if not isinstance(v, str) or not isinstance(t, T.StringType) else v[:32]
            if (v := stat_value(hi, t)) is not None:
                if not isinstance(t, T.StringType) or len(v) <= 32:
                    most[name] = v
                elif (up := _above(v[:32])) is not None:
                    most[name] = up
    return json.dumps({"numRecords": meta.num_rows, "minValues": least, "maxValues": most, "nullCount": nulls}, default=str)


def _above(prefix: str) -> str | None:
    """A string above all that start with the prefix."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0xD7FF:
            return prefix[:i] + chr(ord(prefix[i]) + 1)
    return None


def statistics(spark: SparkSession, store: Store, paths: list[str], metadata: Metadata) -> dict[str, str]:
    """Path -> statistics. Footers are read by the executors for many files, on the driver for few; stores that only Spark reads get theirs from a query."""
    fields = [(physical_name(f), f.dataType) for f in metadata.schema if f.name in set(stats_columns(metadata))]
    if store.local and len(paths) <= 32:
        return {p: footer_stats(store.absolute(p), fields) for p in paths}
    if store.local:
        full = [(p, store.absolute(p)) for p in paths]

        def read(frames):
            for pdf in frames:
                yield pdf.assign(stats=[footer_stats(x, fields) for x in pdf["full"]])[["path", "stats"]]

        files = spark.createDataFrame(full, "path string, full string").repartition(min(len(full), 4 * spark.sparkContext.defaultParallelism))
        return {r["path"]: r["stats"] for r in files.mapInPandas(read, "path string, stats string").collect()}
    simple = [(n, t) for n, t in fields if not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    ordered = [(n, t) for n, t in simple if not isinstance(t, (T.BooleanType, T.BinaryType))]
    df = spark.read.schema(T.StructType([T.StructField(n, t) for n, t in simple])).parquet(*[store.absolute(p) for p in paths])
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(f"`{n}`").isNull()).alias(f"null{i}") for i, (n, _) in enumerate(simple)]
    aggs += [f(F.col(f"`{n}`")).alias(f"{k}{i}") for i, (n, _) in enumerate(ordered) for k, f in (("min", F.min), ("max", F.max))]
    out = {}
    for r in df.groupBy(F.col("_metadata.file_name").alias("file")).agg(*aggs).collect():
        low = {n: v for i, (n, t) in enumerate(ordered) if (v := stat_value(r[f"min{i}"], t)) is not None}
        top = {n: v for i, (n, t) in enumerate(ordered) if (v := stat_value(r[f"max{i}"], t)) is not None}
        out[r["file"]] = json.dumps({"numRecords": r["n"], "minValues": low, "maxValues": top, "nullCount": {n: r[f"null{i}"] for i, (n, _) in enumerate(simple)}}, default=str)
    return {p: out[p.rsplit("/", 1)[-1]] for p in paths if p.rsplit("/", 1)[-1] in out}


def write_files(spark: SparkSession, store: Store, df: DataFrame, metadata: Metadata, *, folder: str | None = None, properties: WriterProperties | None = None, data_change: bool = True, sort: bool = False, target_rows: int | None = None, cdc: bool = False, few_partitions: bool = False) -> list[dict]:
    """Write df's rows (the table's columns) and return the add (or cdc) actions.

    Files go straight to a folder of this write's own under the table: nothing is moved, and files that no commit names
    are vacuum's. Partitioned tables are shuffled by their partition columns with REBALANCE, so that Spark splits a hot
    partition over several tasks and puts small ones together. ``sort`` keeps df's own order and partitioning.
    ``few_partitions`` says that there are few partition values: rows stay in their tasks, unsorted, and each task writes a
    file of each value (beyond WRITERS values it sorts what is left).
    """
    parts = [f for f in metadata.schema if f.name in metadata.partition_columns]
    folder = folder or f"{CDC_FOLDER + '/' if cdc else ''}w-{uuid.uuid4().hex}"
    kept = [F.col(f"`{f.name}`").alias(physical_name(f)) for f in metadata.schema if f.name not in metadata.partition_columns]
    names = [physical_name(f) for f in parts]
    texts = [partition_text(F.col(f"`{f.name}`"), f.dataType).alias(n) for f, n in zip(parts, names, strict=True)]
    out = df.select(*kept, *([F.col(CHANGE)] if cdc else []), *texts)
    if parts and not sort and not few_partitions:
        out = out.hint("rebalance", *[F.col(f"`{n}`") for n in names])
    writer = out.write.mode("append").options(**(properties or WriterProperties()).options())
    if target_rows:
        writer = writer.option("maxRecordsPerFile", target_rows)
    if parts:
        writer = writer.partitionBy(*names)
    try:
        unsorted = {"spark__sql__maxConcurrentOutputFileWriters": str(WRITERS)} if parts and few_partitions and not sort else {}
        with session(spark, spark__sql__parquet__outputTimestampType="TIMESTAMP_MICROS", spark__sql__parquet__writeLegacyFormat="false", **unsorted):
            writer.parquet(store.absolute(folder))
    except Exception as e:
        if (why := violation(e)) is not None:
            raise why from None
        raise
    files = [f for f in store.list(folder, recursive=True) if f.path.endswith(".parquet") and not f.path.rsplit("/", 1)[-1].startswith((".", "_"))]
    stats = {} if cdc else statistics(spark, store, [f.path for f in files], metadata)
    actions = []
    for f in sorted(files, key=lambda x: x.path):
        values = _values(f.path, parts)
        a = {"path": encoded(f.path), "partitionValues": values, "size": f.size, "dataChange": data_change and not cdc}
        if cdc:
            actions.append({"cdc": a})
            continue
        s = stats.get(f.path)
        if s and json.loads(s)["numRecords"] == 0:
            store.delete(f.path)  # an empty task's file
            continue
        actions.append({"add": {**a, "modificationTime": f.modified, "stats": s}})
    return actions


def _values(path: str, parts: list[T.StructField]) -> dict:
    """Partition values from the folders that Spark made: its escapes undone, the default partition as null."""
    from urllib.parse import unquote

    found = {}
    for piece in path.split("/")[:-1]:
        name, eq, value = piece.partition("=")
        if eq:
            found[unquote(name)] = None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value)
    return {physical_name(f): found.get(physical_name(f)) for f in parts}


def protocol_for(metadata: Metadata, now: Protocol | None = None) -> Protocol:
    """The least protocol, at least the one there is, that the schema and the configuration ask for."""
    now = now or Protocol()
    writer, reader, wf, rf = now.writer, now.reader, set(now.writer_features), set(now.reader_features)
    c = metadata.configuration
    need: list[tuple[str, int]] = []
    if metadata.flag("delta.appendOnly"):
        need.append(("appendOnly", 2))
    if metadata.flag("delta.enableChangeDataFeed"):
        need.append(("changeDataFeed", 4))
    if any(k.startswith("delta.constraints.") for k in c):
        need.append(("checkConstraints", 3))
    if generated(metadata.schema):
        need.append(("generatedColumns", 4))
    if any("delta.invariants" in f.metadata for f in metadata.schema):
        need.append(("invariants", 2))

    def types(t):
        yield type(t)
        for k in ("elementType", "keyType", "valueType"):
            if hasattr(t, k):
                yield from types(getattr(t, k))
        for f in t.fields if isinstance(t, T.StructType) else ():
            yield from types(f.dataType)

    used = set(types(metadata.schema))
    both = [n for n, on in (("timestampNtz", T.TimestampNTZType in used), ("variantType", T.VariantType in used), ("deletionVectors", metadata.flag("delta.enableDeletionVectors"))) if on]
    only = ["inCommitTimestamp"] if metadata.flag("delta.enableInCommitTimestamps") else []
    reader, writer = max(reader, int(c.get("delta.minReaderVersion", 1))), max(writer, int(c.get("delta.minWriterVersion", 1)))
    if both or only or writer >= 7:
        if writer < 7:
            legacy = [("appendOnly", 2), ("invariants", 2), ("checkConstraints", 3), ("changeDataFeed", 4), ("generatedColumns", 4)]
            wf |= {n for n, v in legacy if v <= now.writer and now.writer > 2}
        wf |= {n for n, _ in need} | set(both) | set(only)
        rf |= set(both)
        return Protocol(3 if rf or reader >= 3 else reader, 7, tuple(sorted(rf)), tuple(sorted(wf)))
    return Protocol(reader, max([writer, *(v for _, v in need)]))


def check_schema_allowed(df: DataFrame, metadata: Metadata) -> None:
    """Raise unless df's columns are the table's, but for nullable and generated ones that may be missing."""
    have, want = set(df.columns), {f.name for f in metadata.schema}
    if extra := have - want:
        raise SchemaError(f"the table has no columns {sorted(extra)}; a schema mode would add them")
    gen = generated(metadata.schema)
    if missing := [f.name for f in metadata.schema if f.name not in have and f.name not in gen and not f.nullable]:
        raise SchemaError(f"columns {missing} must be given")


def predicate_of(spark: SparkSession, schema: T.StructType, sql) -> Predicate:
    with session(spark):
        p = Predicate(spark, schema, sql)
        p.check_for_rewrites()
        return p

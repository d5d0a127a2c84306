"""Tables: a transaction log and Parquet files, read and changed through Spark."""

from __future__ import annotations

import re
import time
import uuid
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.predicates import Predicate, dnf, is_true
from .functions.values import SchemaError, from_partition, merge_schema
from .operators import dml, maintenance
from .operators.alter import Alterer, check_properties
from .operators.checkpoint import cleanup_log, compact_logs, create_checkpoint
from .operators.commit import CommitProperties, Hooks, PostCommit, Reads, commit, remove_of
from .operators.writer import CHANGE, check_schema_allowed, checked, conform, predicate_of, protocol_for, session, write_files
from .sources.cdf import load_cdf
from .sources.deletion_vectors import deleted_frame
from .sources.scan import FILE, ROW, exact_partitions, prune, scan
from .sources.snapshot import Log, Metadata, Protocol, Snapshot, TableError, TableNotFound, physical_name, relative, stats_of
from .sources.store import LOG, Store, uri_of

__all__ = ["CommitProperties", "Hooks", "PostCommit", "QueryBuilder", "Table", "TableError", "TableNotFound", "convert_to_table", "create_with_adds", "write_table"]


class Table:
    """A table at a version. Operations commit and move the handle to the version they made."""

    def __init__(self, spark: SparkSession, path: str, version: int | str | datetime | None = None, load: bool = True, storage_options: dict[str, str] | None = None):
        """``storage_options`` are settings of Hadoop's file systems; they hold for the whole session."""
        for k, v in (storage_options or {}).items():
            spark.sparkContext._jsc.hadoopConfiguration().set(k, str(v))
        self.spark, self.path = spark, path
        self.log = Log(spark, path)
        self.store: Store = self.log.store
        self.hooks = Hooks()
        self.snapshot: Snapshot | None = None
        if load:
            self.load_as_version(version) if version is not None else self.refresh()

    # -- state ---------------------------------------------------------------------------------------------------

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return Log(spark, path).latest() >= 0

    @classmethod
    def create(cls, spark, path: str, schema: T.StructType, mode: str = "error", partition_by=None, name=None, description=None, configuration=None, *, commit_properties=None, post=None, raise_if_key_not_exists: bool = True) -> Table:
        """A new table. Of one that exists: error and append raise, ignore loads it, overwrite empties it and sets its metadata anew."""
        table = cls(spark, path, load=False)
        there = table.log.latest() >= 0
        if there and mode in ("error", "append"):
            raise TableError(f"{path} is a table")
        if there and mode == "ignore":
            return cls(spark, path)
        meta = table._new_metadata(schema, partition_by, name, description, configuration, raise_if_key_not_exists)
        actions = [protocol_for(meta).action(), meta.action()]
        if there:
            table.refresh()
            actions = [protocol_for(meta, table.snapshot.protocol).action(), meta.action(), *(remove_of(a) for a in table.snapshot.adds)]
        params = {"mode": {"error": "ErrorIfExists", "ignore": "Ignore", "overwrite": "Overwrite", "append": "Append"}[mode], "location": path, "metadata": meta.action()["metaData"]}
        table.commit(actions, "CREATE OR REPLACE TABLE" if there else "CREATE TABLE", params, reads=Reads(everything=there), props=commit_properties, post=post, new=not there)
        return table

    @staticmethod
    def _new_metadata(schema, partition_by=None, name=None, description=None, configuration=None, strict=True) -> Metadata:
        configuration = {k: str(v) for k, v in (configuration or {}).items() if v is not None}
        check_properties(configuration, strict)
        parts = tuple([partition_by] if isinstance(partition_by, str) else partition_by or ())
        if bad := [p for p in parts if p not in schema.names]:
            raise SchemaError(f"no columns {bad} to partition by")
        if parts and len(parts) == len(schema.names):
            raise SchemaError("a table needs a column that isn't a partition column")
        return Metadata(str(uuid.uuid4()), schema, parts, configuration, name, description, int(time.time() * 1000))

    def refresh(self) -> Table:
        self.snapshot = self.log.snapshot(since=self.snapshot)
        return self

    update_incremental = refresh

    def load_as_version(self, version: int | str | datetime) -> Table:
        self.snapshot = self.log.snapshot(version if isinstance(version, int) else self.log.at_time(version))
        return self

    def version(self) -> int:
        return self.snapshot.version

    def schema(self) -> T.StructType:
        return self.snapshot.metadata.schema

    def metadata(self) -> Metadata:
        return self.snapshot.metadata

    def protocol(self) -> Protocol:
        return self.snapshot.protocol

    def table_uri(self) -> str:
        return self.store.root

    def table_config(self) -> dict:
        return dict(self.snapshot.metadata.configuration)

    def history(self, limit: int | None = None) -> list[dict]:
        return self.log.history(limit)

    def transaction_version(self, app_id: str) -> int | None:
        t = self.snapshot.transactions.get(app_id)
        return t["version"] if t else None

    def domain_metadata(self, domain: str) -> str | None:
        d = self.snapshot.domains.get(domain)
        return d["configuration"] if d else None

    def uri(self, add: dict) -> str:
        return uri_of(self.store.absolute(relative(add)))

    @staticmethod
    def rows_of(add: dict) -> int | None:
        n = stats_of(add).get("numRecords")
        return None if n is None else n - ((add.get("deletionVector") or {}).get("cardinality") or 0)

    def commit(self, actions, operation, params=None, *, reads=None, metrics=None, props=None, post=None, new=False, retries=None, blind=None) -> Table:
        self.snapshot = commit(self.log, None if new else self.snapshot, actions, operation, params, reads=reads, metrics=metrics, props=props, post=post, hooks=self.hooks, retries=retries, blind=blind)
        return self

    # -- reads ---------------------------------------------------------------------------------------------------

    def to_df(self, filters=None, columns=None, predicate: str | Column | None = None, file_column: str | None = None, row_column: str | None = None, paths=None, missing_files: str = "error") -> DataFrame:
        """The rows; ``filters`` (tuples) and ``predicate`` (SQL) skip files and filter. ``paths`` reads those files only.

        Files that aren't in the store any more are an error, or left out with ``missing_files="ignore"``.
        """
        with session(self.spark):
            schema = self.snapshot.metadata.schema
            adds = self.snapshot.adds
            if paths is not None:
                by_path = {relative(a): a for a in adds}
                wanted = [p.removeprefix(f"{self.store.local or self.store.root}/") for p in paths]
                if missing := [p for p in wanted if p not in by_path]:
                    raise TableError(f"not files of the table: {missing[:5]}")
                adds = [by_path[p] for p in wanted]
            p = None
            if filters:
                p = Predicate(self.spark, schema, dnf(filters, schema))
                adds = prune(self.spark, self.snapshot, adds, p)
            q = None
            if predicate is not None:
                q = Predicate(self.spark, schema, predicate)
                adds = prune(self.spark, self.snapshot, adds, q)
            if missing_files == "ignore":
                there = set(self.store.existing(relative(a) for a in adds))
                adds = [a for a in adds if relative(a) in there]
            identity = bool(file_column or row_column)
            df = scan(self.spark, self.store, self.snapshot, adds, identity=identity)
            for x in (p, q):
                df = df.where(x.column) if x is not None else df
            if identity:
                extra = [F.col(a).alias(b) for a, b in ((FILE, file_column), (ROW, row_column)) if b]
                df = df.select(*[F.col(f"`{c}`") for c in schema.names], *extra)
            return df.select(*columns) if columns else df

    def to_arrow(self, filters=None, columns=None):
        return self.to_df(filters, columns).toArrow()

    def to_pandas(self, filters=None, columns=None) -> pd.DataFrame:
        return self.to_df(filters, columns).toPandas()

    def to_pyarrow_dataset(self, filters=None):
        """A pyarrow dataset of the table's files, each a fragment that knows its partition values and the ranges of its statistics."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        import pyarrow.fs
        from pyspark.sql.pandas.types import to_arrow_schema

        if any(a.get("deletionVector") for a in self.snapshot.adds) or self.snapshot.metadata.configuration.get("delta.columnMapping.mode", "none") != "none":
            raise TableError("a dataset of plain files can't show deletion vectors or mapped columns")
        if not self.store.local:
            raise TableError("datasets are of local files")
        meta, fields = self.snapshot.metadata, {f.name: f.dataType for f in self.schema()}
        schema = pa.schema([pa.field(f.name, pa.timestamp("us", "UTC" if f.type.tz else None) if pa.types.is_timestamp(f.type) else f.type, f.nullable) for f in to_arrow_schema(meta.schema)])
        form, fragments = ds.ParquetFileFormat(), []
        for a in self._filtered(filters):
            says, stats = ds.scalar(True), stats_of(a)
            for c in meta.partition_columns:
                v = from_partition((a.get("partitionValues") or {}).get(c), fields[c])
                says &= ds.field(c).is_null() if v is None else ds.field(c) == pa.scalar(v, schema.field(c).type)
            for c, t in fields.items():
                lo, hi = ((stats.get(k) or {}).get(c) for k in ("minValues", "maxValues"))
                # numbers and dates alone: strings may be cut
                if isinstance(t, (T.IntegralType, T.DateType)) and lo is not None and hi is not None and not (stats.get("nullCount") or {}).get(c, 1):
                    lo, hi = (pa.scalar(from_partition(str(x), t), schema.field(c).type) for x in (lo, hi))
                    says &= (ds.field(c) >= lo) & (ds.field(c) <= hi)
            fragments.append(form.make_fragment(self.store.absolute(relative(a)), pa.fs.LocalFileSystem(), says))
        return ds.FileSystemDataset(fragments, schema, form, pa.fs.LocalFileSystem()) if fragments else ds.dataset(schema.empty_table())

    def load_cdf(self, *args, **how) -> DataFrame:
        return load_cdf(self, *args, **how)

    def files_scanned(self, predicate: str) -> list[str]:
        """The files that a scan with this predicate opens."""
        with session(self.spark):
            return [relative(a) for a in prune(self.spark, self.snapshot, self.snapshot.adds, Predicate(self.spark, self.schema(), predicate))]

    def _filtered(self, partition_filters) -> list[dict]:
        if not partition_filters:
            return self.snapshot.adds
        p = Predicate(self.spark, self.schema(), dnf(partition_filters, self.schema()))
        if bad := p.columns - set(self.snapshot.metadata.partition_columns):
            raise TableError(f"not partition columns: {sorted(bad)}")
        return exact_partitions(self.spark, self.snapshot, self.snapshot.adds, p)

    def partitions(self, partition_filters=None) -> list[dict]:
        seen = {}
        for a in self._filtered(partition_filters):
            seen[maintenance.partition_key(a)] = a.get("partitionValues") or {}
        return list(seen.values())

    def file_uris(self, partition_filters=None) -> list[str]:
        return [self.store.absolute(relative(a)) for a in self._filtered(partition_filters)]

    def count(self) -> int:
        """Rows, from the log where every file's number is known, else counted."""
        counts = [self.rows_of(a) for a in self.snapshot.adds]
        return self.to_df().count() if None in counts else sum(counts)

    def deletion_vectors(self) -> DataFrame:
        """(filepath, selection_vector), true where a row is kept; executors decode the vectors, a file's list is one row."""
        with_vector = [(self.store.absolute(relative(a)), a["deletionVector"], stats_of(a).get("numRecords")) for a in self.snapshot.adds if a.get("deletionVector")]
        if not with_vector:
            return self.spark.createDataFrame([], "filepath string, selection_vector array<boolean>")
        gone = deleted_frame(self.spark, self.store, [(p, dv) for p, dv, _ in with_vector], "filepath", "__row")
        # where the log doesn't say how many rows a file has, up to the last that is taken out
        last = gone.groupBy("filepath").agg(F.max("__row").alias("__last"))
        files = self.spark.createDataFrame([(p, n) for p, _, n in with_vector], "filepath string, __n long").join(last, "filepath", "left")
        n = F.greatest(F.coalesce("__n", F.lit(0)), F.coalesce(F.col("__last") + 1, F.lit(0)))
        every = files.select("filepath", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("__row"))
        marked = every.join(gone.withColumn("__gone", F.lit(True)), ["filepath", "__row"], "left")
        lists = marked.groupBy("filepath").agg(F.sort_array(F.collect_list(F.when(F.col("__row").isNotNull(), F.struct("__row", F.col("__gone").isNull().alias("keep"))))).alias("l"))
        return lists.select("filepath", F.col("l.keep").alias("selection_vector"))

    def get_add_actions(self, flatten: bool = False) -> DataFrame:
        """One row a file: path, size_bytes, modification_time, num_records, and nulls, least and greatest values and partition values by column."""
        meta = self.snapshot.metadata
        parts = [f for f in meta.schema if f.name in meta.partition_columns]
        data = [f for f in meta.schema if f.name not in meta.partition_columns and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.BooleanType))]
        rows = []
        for a in self.snapshot.adds:
            s, pv = stats_of(a), a.get("partitionValues") or {}
            val = lambda k, f, s=s: from_partition(str(v), f.dataType) if (v := (s.get(k) or {}).get(physical_name(f))) is not None else None
            rows.append((relative(a), a["size"], a.get("modificationTime"), s.get("numRecords"), tuple((s.get("nullCount") or {}).get(physical_name(f)) for f in data), tuple(val("minValues", f) for f in data), tuple(val("maxValues", f) for f in data), tuple(from_partition(pv.get(physical_name(f)), f.dataType) for f in parts)))
        typed = T.StructType([T.StructField(f.name, f.dataType) for f in data])
        schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("modification_time", T.LongType()), T.StructField("num_records", T.LongType()), T.StructField("null_count", T.StructType([T.StructField(f.name, T.LongType()) for f in data])), T.StructField("min", typed), T.StructField("max", typed), T.StructField("partition", T.StructType([T.StructField(f.name, f.dataType) for f in parts]))])
        if not parts:
            schema, rows = T.StructType(schema.fields[:-1]), [r[:-1] for r in rows]
        df = self.spark.createDataFrame(rows, schema)
        if not flatten:
            return df
        return df.select("path", "size_bytes", "modification_time", "num_records", *[F.col(f"{k}.`{f.name}`").alias(f"{k}.{f.name}") for k in ("null_count", "min", "max") for f in data], *[F.col(f"partition.`{f.name}`").alias(f"partition.{f.name}") for f in parts])

    # -- changes -------------------------------------------------------------------------------------------------

    def delete(self, predicate=None, **how) -> dict:
        return dml.delete(self, predicate, **how)

    def update(self, updates: dict | None = None, new_values: dict | None = None, predicate=None, error_on_type_mismatch: bool = True, **how) -> dict:
        """``updates``: SQL by column; ``new_values``: Python values by column."""
        if updates and new_values:
            raise TableError("either updates or new_values")
        assignments = updates if updates is not None else {k: F.lit(v) for k, v in (new_values or {}).items()}
        return dml.update(self, assignments, predicate, safe=not error_on_type_mismatch, **how)

    def merge(self, source, predicate: str, source_alias=None, target_alias=None, merge_schema: bool = False, error_on_type_mismatch: bool = True, properties=None, *, commit_properties=None, post=None) -> dml.Merge:
        return dml.Merge(self, frame_of(self.spark, source), predicate, source_alias, target_alias, merge_schema, not error_on_type_mismatch, properties, commit_properties, post)

    def alter(self) -> Alterer:
        return Alterer(self)

    def optimize(self) -> Optimizer:
        return Optimizer(self)

    def vacuum(self, *args, **how) -> list[str]:
        return maintenance.vacuum(self, *args, **how)

    def restore(self, target, **how) -> dict:
        return maintenance.restore(self, target, **how)

    def repair(self, dry_run: bool = False, **how) -> dict:
        return maintenance.repair(self, dry_run, **how)

    def generate(self) -> list[str]:
        return maintenance.generate_manifests(self)

    def create_checkpoint(self) -> None:
        create_checkpoint(self.log, self.snapshot)

    def cleanup_metadata(self) -> int:
        return cleanup_log(self.log, self.snapshot)

    def compact_logs(self, starting_version: int, ending_version: int) -> None:
        compact_logs(self.log, starting_version, ending_version)

    def create_write_transaction(self, actions: list[dict], mode: str = "append", partition_filters=None, *, commit_properties=None, post=None) -> None:
        """Commit add actions that the caller made; overwrite removes the files there are (of the filtered partitions)."""
        removes = [remove_of(a) for a in self._filtered(partition_filters)] if mode == "overwrite" else []
        self.commit([{"add": a} for a in actions] + removes, "WRITE", {"mode": mode.title(), "partitionBy": list(self.snapshot.metadata.partition_columns)}, reads=Reads(everything=True) if removes else None, props=commit_properties, post=post)


class Optimizer:
    def __init__(self, table: Table):
        self.table = table

    def compact(self, partition_filters=None, target_size=None, max_concurrent_tasks=None, min_commit_interval=None, **how) -> dict:
        return maintenance.compact(self.table, partition_filters, target_size, max_concurrent_tasks, min_commit_interval, **how)

    def z_order(self, columns, partition_filters=None, target_size=None, **how) -> dict:
        return maintenance.zorder(self.table, list(columns), partition_filters, target_size, **how)


def frame_of(spark: SparkSession, data) -> DataFrame:
    """Rows as a DataFrame: one already, pandas, Arrow, or dicts."""
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_pandas") and not isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data) if type(data).__name__ == "Table" else spark.createDataFrame(data.to_pandas())
    return spark.createDataFrame(data)


def write_table(spark: SparkSession, table_or_path, data, *, mode: str = "error", partition_by=None, schema_mode: str | None = None, predicate: str | None = None, name=None, description=None, configuration=None, safe_cast: bool = False, target_rows: int | None = None, target_file_size: int | None = None, few_partitions: bool = False, operation: str = "WRITE", parameters: dict | None = None, properties=None, commit_properties=None, post=None) -> Table | None:
    """Append to, overwrite (wholly, or where the predicate is true), or create a table.

    Schema modes: none (columns must fit), merge (new columns are added) and overwrite (with mode overwrite only).
    Files hold ``target_rows`` rows at most, or by their estimated width about ``target_file_size`` bytes (or the table's
    delta.targetFileSize). ``few_partitions`` says that the partition columns have few values, so that rows needn't be
    shuffled by them. ``operation`` and ``parameters`` are what the log says of the commit.
    """
    table = table_or_path if isinstance(table_or_path, Table) else Table(spark, table_or_path, load=False)
    df = frame_of(spark, data)
    if mode not in ("error", "append", "overwrite", "ignore"):
        raise TableError(f"no mode {mode}")
    if schema_mode == "overwrite" and mode != "overwrite":
        raise SchemaError("the schema can be overwritten only with mode overwrite")
    there = table.snapshot is not None or table.log.latest() >= 0
    if there and mode == "error":
        raise TableError(f"{table.path} is a table")
    if there and mode == "ignore":
        return table.refresh()
    if there and table.snapshot is None:
        table.refresh()
    known = table.snapshot.metadata.configuration if there else {k: str(v) for k, v in (configuration or {}).items()}
    if target_rows is None and (size := target_file_size or known.get("delta.targetFileSize")):
        target_rows = max(1, int(size) // max(1, _row_width(table if there else None, df)))
    with session(spark):
        if not there:
            fields = [T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema]
            meta = Table._new_metadata(T.StructType(fields), partition_by, name, description, configuration)
            adds = write_files(spark, table.store, checked(conform(df, meta.schema), meta), meta, properties=properties, target_rows=target_rows, few_partitions=few_partitions)
            return table.commit([protocol_for(meta).action(), meta.action(), *adds], operation, {**(parameters or {}), "mode": "ErrorIfExists" if mode == "error" else mode.title(), "partitionBy": list(meta.partition_columns)}, props=commit_properties, post=post, new=True, blind=True)
        now = table.snapshot.metadata
        parts = tuple([partition_by] if isinstance(partition_by, str) else partition_by or ())
        schema, new_parts = now.schema, now.partition_columns
        if schema_mode == "overwrite" and predicate is None:
            schema, new_parts = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema]), parts or tuple(p for p in now.partition_columns if p in df.columns)
        elif parts and parts != now.partition_columns:
            raise SchemaError(f"the table is partitioned by {list(now.partition_columns)}")
        if schema_mode == "merge":
            if now.configuration.get("delta.columnMapping.mode", "none") != "none":
                raise SchemaError("schemas of tables with column mapping can't be merged")
            schema = merge_schema(now.schema, df.schema)
        meta = Metadata(**{**now.__dict__, "schema": schema, "partition_columns": new_parts, "configuration": {**now.configuration, **{k: str(v) for k, v in (configuration or {}).items()}}})
        check_schema_allowed(df, meta)
        rows = checked(conform(df, schema, safe_cast), meta)
        head = []
        if meta != now:
            wanted = protocol_for(meta, table.snapshot.protocol)
            head = ([wanted.action()] if wanted != table.snapshot.protocol else []) + [meta.action()]
        if mode == "append":
            adds = write_files(spark, table.store, rows, meta, properties=properties, target_rows=target_rows, few_partitions=few_partitions)
            return table.commit(head + adds, operation, {**(parameters or {}), "mode": "Append", "partitionBy": list(new_parts)}, props=commit_properties, post=post)
        if now.flag("delta.appendOnly"):
            raise TableError("the table is append-only")
        if predicate is None:
            adds = write_files(spark, table.store, rows, meta, properties=properties, target_rows=target_rows, few_partitions=few_partitions)
            return table.commit(head + adds + [remove_of(a) for a in table.snapshot.adds], operation, {**(parameters or {}), "mode": "Overwrite", "partitionBy": list(new_parts)}, reads=Reads(everything=True), props=commit_properties, post=post)
        p = predicate_of(spark, schema, predicate)
        fits = F.when(is_true(p.column), F.lit(True)).otherwise(F.raise_error(F.lit(f"TARN_CONSTRAINT rows must match: {predicate}")).cast("boolean"))
        new_rows = rows.where(fits)
        cdf = now.flag("delta.enableChangeDataFeed")
        if p.columns <= set(now.partition_columns):
            gone = exact_partitions(spark, table.snapshot, table.snapshot.adds, p)
            adds = write_files(spark, table.store, new_rows, meta, properties=properties, target_rows=target_rows, few_partitions=few_partitions)
        else:
            candidates = prune(spark, table.snapshot, table.snapshot.adds, p)
            gone = dml.touched_files(table, candidates, p)[0] if candidates else []
            old = conform(scan(spark, table.store, table.snapshot, gone), schema)
            adds = write_files(spark, table.store, new_rows.unionByName(old.where(~is_true(p.column))), meta, properties=properties, target_rows=target_rows, few_partitions=few_partitions)
            if cdf:
                feed = old.where(p.column).withColumn(CHANGE, F.lit("delete")).unionByName(new_rows.withColumn(CHANGE, F.lit("insert")))
                adds += write_files(spark, table.store, feed, meta, cdc=True)
        reads = dml.reads_of(table, gone, p)
        return table.commit(head + adds + [remove_of(a) for a in gone], operation, {**(parameters or {}), "mode": "Overwrite", "partitionBy": list(new_parts), "predicate": predicate}, reads=reads, props=commit_properties, post=post)


def _row_width(table: Table | None, df: DataFrame) -> int:
    """Bytes of a row in a file, about: by the files there are, or by the columns' types."""
    pairs = [(a.get("size") or 0, stats_of(a).get("numRecords") or 0) for a in table.snapshot.adds] if table else []
    if rows := sum(n for _, n in pairs):
        return sum(s for s, _ in pairs) // rows
    return df._jdf.schema().defaultSize()


def convert_to_table(spark, path: str, **how) -> Table:
    return maintenance.convert(Table, spark, path, **how)


def create_with_adds(spark, path: str, schema: T.StructType, adds: list[dict], mode: str = "error", partition_by=None, name=None, description=None, configuration=None, *, commit_properties=None, post=None) -> Table:
    """A table of files that are there already."""
    if Table.exists(spark, path):
        if mode == "ignore":
            return Table(spark, path)
        raise TableError(f"{path} is a table")
    table = Table(spark, path, load=False)
    meta = Table._new_metadata(schema, partition_by, name, description, configuration)
    return table.commit([protocol_for(meta).action(), meta.action(), *({"add": a} for a in adds)], "CREATE TABLE", {"mode": "ErrorIfExists", "location": path, "metadata": meta.action()["metaData"]}, props=commit_properties, post=post, new=True)


#: Types by the names that arrow_cast takes.
ARROW_TYPES = {"Boolean": "BOOLEAN", "Int8": "TINYINT", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "Float32": "FLOAT", "Float64": "DOUBLE", "Utf8": "STRING", "LargeUtf8": "STRING", "Utf8View": "STRING", "Binary": "BINARY", "LargeBinary": "BINARY", "Date32": "DATE", "Timestamp(Microsecond, None)": "TIMESTAMP_NTZ", 'Timestamp(Microsecond, Some("UTC"))': "TIMESTAMP"}


def translated(sql: str) -> str:
    """SQL with what Spark spells otherwise: SIMILAR TO, which is a regular expression for the whole value, and arrow_cast."""
    # text in quotes stays as it is, but for the patterns and types that follow
    sql = re.sub(r"\bSIMILAR\s+TO\s+'((?:[^']|'')*)'", lambda m: "RLIKE r'^(?:" + m[1] + ")$'" if "''" not in m[1] else f"RLIKE '^(?:{m[1]})$'", sql, flags=re.I)
    while m := re.search(r"\barrow_cast\s*\(", sql, re.I):
        depth, at, comma, quoted = 1, m.end(), None, False
        while depth and at < len(sql):
            c = sql[at]
            quoted ^= c == "'"
            if not quoted:
                depth += (c == "(") - (c == ")")
                comma = at if c == "," and depth == 1 else comma
            at += 1
        kind = sql[(comma or at) + 1 : at - 1].strip().strip("'")
        if comma is None or depth or kind not in ARROW_TYPES and not re.fullmatch(r"Decimal128\(\d+, ?\d+\)", kind):
            raise TableError(f"arrow_cast to {kind}")
        sql = f"{sql[: m.start()]}CAST({sql[m.end() : comma]} AS {ARROW_TYPES.get(kind) or kind.replace('Decimal128', 'DECIMAL')}){sql[at:]}"
    return sql


class QueryBuilder:
    """SQL over registered tables, each at the version of its handle."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}

    def register(self, name: str, table: Table | DataFrame) -> QueryBuilder:
        if isinstance(table, Table):
            self.tables[name] = table
        (table.to_df() if isinstance(table, Table) else table).createOrReplaceTempView(name)
        return self

    def register_folder(self, path: str) -> list[str]:
        """Register each table in a folder by its folder's name."""
        store, names = Store(self.spark, path), set()
        for f in store.list("", recursive=True):
            pieces = f.path.split("/")
            if len(pieces) >= 3 and pieces[1] == LOG:
                names.add(pieces[0])
        for n in sorted(names):
            self.register(n, Table(self.spark, f"{path.rstrip('/')}/{n}"))
        return sorted(names)

    def execute(self, sql: str) -> DataFrame:
        """A query; or CREATE EXTERNAL TABLE name STORED AS format LOCATION 'path', or INSERT INTO | OVERWRITE name query, whose effect the registered name shows at once."""
        if m := re.match(r"\s*CREATE\s+EXTERNAL\s+TABLE\s+`?(\w+)`?\s+STORED\s+AS\s+\w+\s+LOCATION\s+'([^']*)'\s*;?\s*$", sql, re.I):
            self.register(m[1], Table(self.spark, m[2]))
            return self.spark.createDataFrame([], "name string")
        if m := re.match(r"\s*INSERT\s+(INTO|OVERWRITE)\s+(?:TABLE\s+)?`?(\w+)`?\s+(.*)$", sql, re.I | re.S):
            if m[2] not in self.tables:
                raise TableError(f"{m[2]} isn't a registered table")
            self.register(m[2], self.insert(self.tables[m[2]], m[3], overwrite=m[1].upper() == "OVERWRITE"))
            return self.spark.createDataFrame([], "name string")
        if (m := re.match(r"\s*SELECT\s+COUNT\s*\(\s*(?:\*|1)\s*\)(?:\s+(?:AS\s+)?`?(\w+)`?)?\s+FROM\s+`?(\w+)`?\s*;?\s*$", sql, re.I)) and m[2] in self.tables and (m[1] or "").upper() != "FROM":
            # from the log, as no file's rows are needed
            return self.spark.createDataFrame([(self.tables[m[2]].count(),)], f"`{m[1] or 'count(1)'}` long")
        return self.spark.sql(translated(sql))

    def insert(self, table: Table, sql: str, overwrite: bool = False) -> Table:
        """Append a query's rows to a table, or put them in place of its rows."""
        rows = self.spark.sql(sql)
        names = table.schema().names
        if len(rows.columns) != len(names):
            raise SchemaError(f"{len(rows.columns)} columns for {len(names)}")
        return write_table(self.spark, table, rows.toDF(*names), mode="overwrite" if overwrite else "append")

"""OPTIMIZE, VACUUM, RESTORE, repair, conversion and manifests."""

from __future__ import annotations

import re
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate, dnf
from ..sources.scan import exact_partitions, scan
from ..sources.snapshot import Metadata, TableError, key, physical_name, relative
from ..sources.store import LOG, encoded
from .checkpoint import duration_ms
from .commit import Reads, remove_of
from .writer import WriterProperties, protocol_for, session, statistics, write_files

TARGET_SIZE = 100 * 1024 * 1024


def target_size(table, size: int | None) -> int:
    return int(size or table.snapshot.metadata.configuration.get("delta.targetFileSize") or TARGET_SIZE)


def chosen(table, filters) -> list[dict]:
    adds, meta = table.snapshot.adds, table.snapshot.metadata
    if not filters:
        return adds
    p = Predicate(table.spark, meta.schema, dnf(filters, meta.schema))
    if not p.columns <= set(meta.partition_columns):
        raise TableError("optimize takes filters on partition columns only")
    return exact_partitions(table.spark, table.snapshot, adds, p)


def partition_key(a: dict) -> tuple:
    return tuple(sorted((a.get("partitionValues") or {}).items(), key=lambda x: x[0]))


def bins(files: list[dict], size: int) -> list[list[dict]]:
    """Runs of neighbouring files, newest first, whose sizes sum to at most ``size``; files above it and runs of one are left out."""
    out, run, total = [], [], 0
    for a in sorted(files, key=lambda x: -(x.get("modificationTime") or 0)):
        if a["size"] > size:
            continue
        if total + a["size"] > size and run:
            out.append(run)
            run, total = [], 0
        run.append(a)
        total += a["size"]
    return [r for r in [*out, run] if len(r) > 1]


def compact(table, filters=None, size: int | None = None, max_concurrent_tasks: int | None = None, min_commit_interval: float | None = None, properties=None, commit_properties=None, post=None) -> dict:
    """Rewrite small files of a partition into larger ones: all bins are one Spark job, a task for each.

    With ``min_commit_interval`` (seconds), bins are committed in batches of ``max_concurrent_tasks``, a commit after each
    interval.
    """
    began, meta = time.time(), table.snapshot.metadata
    if meta.configuration.get("delta.columnMapping.mode", "none") != "none":
        raise TableError("tables with column mapping can't be optimized")
    groups: dict = {}
    considered = chosen(table, filters)
    for a in considered:
        groups.setdefault(partition_key(a), []).append(a)
    runs = [b for g in groups.values() for b in bins(g, target_size(table, size))]
    metrics = {"num_files_added": 0, "num_files_removed": 0, "partitions_optimized": len({partition_key(r[0]) for r in runs}), "num_batches": len(runs), "total_considered_files": len(considered), "total_files_skipped": len(considered) - sum(map(len, runs)), "files_added": {}, "files_removed": {}, "preserve_insertion_order": True}
    if not runs:
        return metrics
    step = len(runs) if min_commit_interval is None else max_concurrent_tasks or table.spark.sparkContext.defaultParallelism
    pending, last = [], time.time()
    for i in range(0, len(runs), step):
        pending += _rewrite(table, runs[i : i + step], properties)
        if i + step >= len(runs) or time.time() - last >= (min_commit_interval or 0):
            _commit_optimize(table, pending, {"targetSize": str(target_size(table, size)), "predicate": filters}, metrics, commit_properties, post)
            pending, last = [], time.time()
    metrics["total_time_ms"] = int(1000 * (time.time() - began))
    return metrics


def _rewrite(table, runs: list[list[dict]], properties) -> list[dict]:
    """The actions that replace each run of files by one file."""
    meta, spark = table.snapshot.metadata, table.spark
    with session(spark):
        files = [(table.uri(a), i) for i, r in enumerate(runs) for a in r]
        where = spark.createDataFrame(files, "__tarn_file string, __tarn_bin int")
        rows = scan(spark, table.store, table.snapshot, [a for r in runs for a in r], identity=True).join(where, "__tarn_file")
        n = len(runs)
        # a partition for each bin, in its files' own order; bins are bounded by the target size
        rows = rows.repartitionByRange(n, "__tarn_bin") if n > 1 else rows.coalesce(1)
        rows = rows.sortWithinPartitions("__tarn_bin", "__tarn_file", "__tarn_row").drop("__tarn_file", "__tarn_row", "__tarn_bin")
        added = write_files(spark, table.store, rows, meta, properties=properties or WriterProperties(compression="zstd", compression_level=4), data_change=False, sort=True)
    return added + [remove_of(a, False) for r in runs for a in r]


def _commit_optimize(table, actions, params, metrics, commit_properties, post) -> None:
    added, removed = [a["add"] for a in actions if "add" in a], [a["remove"] for a in actions if "remove" in a]
    metrics["num_files_added"] += len(added)
    metrics["num_files_removed"] += len(removed)
    for k, files in (("files_added", added), ("files_removed", removed)):
        sizes = [a["size"] or 0 for a in files]
        if sizes:
            metrics[k] = {"avg": sum(sizes) / len(sizes), "max": max(sizes), "min": min(sizes), "total_files": len(sizes), "total_size": sum(sizes)}
    table.commit(actions, "OPTIMIZE", params, reads=Reads(files={key(r) for r in removed}), metrics={k: v for k, v in metrics.items() if not isinstance(v, dict)}, props=commit_properties, post=post)


#: Ranges that a z-ordered column is cut into, sampled values for each, and characters of a string or binary boundary.
RANGES, SAMPLED, BOUNDARY = 1024, 20, 4096


def with_zorder_key(df: DataFrame, columns: list[str], rows: int, name: str) -> DataFrame:
    """df with an interleaving of the columns' range numbers, nulls first, in a column: a number, or a binary string if it is long.

    Each column is cut into at most RANGES ranges at quantiles of a sample of its own values, whatever their type, so that
    the key's bits are spread evenly, strings that begin alike and large integers included; all in expressions. ``rows`` is
    about the number of rows of df.
    """
    types = {c: df.select(F.col(c).alias("c")).schema["c"].dataType for c in columns}
    if bad := [c for c, t in types.items() if not _orderable(t)]:
        raise TableError(f"columns {bad} have no order")
    sample = df if rows <= RANGES * SAMPLED else df.sample(RANGES * SAMPLED / rows, seed=7)
    cut = lambda c: F.substring(c, 1, BOUNDARY) if isinstance(types[c], (T.StringType, T.BinaryType)) else F.col(c)
    values = sample.select(*[F.sort_array(F.collect_list(cut(c))).alias(f"v{i}") for i, c in enumerate(columns)])

    def picked(v: F.Column) -> F.Column:
        """Of some RANGES * SAMPLED sorted values, RANGES - 1 that lie evenly among them, each once."""
        places = F.filter(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda k: F.size(v) > 0)
        return F.array_distinct(F.transform(places, lambda k: F.get(v, F.floor(k * F.size(v) / RANGES).cast("int"))))

    picks = [picked(F.col(f"v{i}")).alias(f"c{i}") for i in range(len(columns))]
    cuts = values.select(*picks).first()
    limits = [[_literal(x, types[c]) for x in cuts[f"c{i}"] or ()] for i, c in enumerate(columns)]
    before, n = df.columns, len(columns)
    df = with_ranks(df, columns, limits)
    width = (RANGES - 1).bit_length() + 1
    if n * width <= 63:
        spread = F.lit([sum((r >> b & 1) << b * n for b in range(width)) for r in range(RANGES + 1)]).cast("array<bigint>")
        df = df.withColumn("__tarn_spread", spread)
        key = F.lit(0).cast("long")
        for i in range(n):
            key = key.bitwiseOR(F.shiftleft(F.get("__tarn_spread", F.col(f"__tarn_at{i}")), n - 1 - i))
    else:
        digits = [F.lpad(F.bin(F.col(f"__tarn_at{i}").cast("long")), width, "0") for i in range(n)]
        key = F.concat(*[F.substring(d, b + 1, 1) for b in range(width) for d in digits])
    return df.select(*[F.col(f"`{c}`") for c in before], key.alias(name))


def with_ranks(df: DataFrame, columns: list[str], limits: list[list[F.Column]]) -> DataFrame:
    """df with __tarn_at0...: 0 for null, else one more than the sorted limits at or below each column's value.

    A search by halves, each step a projection of its own: Spark compiles them, as it doesn't compile lambda functions.
    """
    edges = {i: F.array(*x).alias(f"__tarn_edges{i}") for i, x in enumerate(limits) if x}
    df = df.select("*", *edges.values(), *[F.lit(0).alias(f"__tarn_at{i}") for i in range(len(columns))])
    for b in range(max(map(len, limits)).bit_length() - 1, -1, -1):
        step = 1 << b
        at = {f"__tarn_at{i}": F.col(f"__tarn_at{i}") for i in edges}
        # beyond the last limit there is null, which isn't at or below anything
        df = df.withColumns({k: F.when(F.get(f"__tarn_edges{i}", x + (step - 1)) <= F.col(columns[i]), x + step).otherwise(x) for i, (k, x) in zip(edges, at.items(), strict=True)})
    return df.withColumns({f"__tarn_at{i}": F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.col(f"__tarn_at{i}") + 1) for i, c in enumerate(columns)})


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t)
    return _orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))


def _literal(value, t: T.DataType) -> F.Column:
    if value is None:
        return F.lit(None).cast(t)
    if isinstance(t, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in t])
    if isinstance(t, T.ArrayType):
        return F.array(*[_literal(x, t.elementType) for x in value]).cast(t)
    return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(t)


def zorder(table, columns: list[str], filters=None, size: int | None = None, properties=None, commit_properties=None, post=None) -> dict:
    """Rewrite all files so that rows near in the columns are near in the files, partition by partition."""
    began, meta = time.time(), table.snapshot.metadata
    if not columns:
        raise TableError("z-order needs columns")
    names = {f.name for f in meta.schema}
    for c in columns:
        if c in meta.partition_columns:
            raise TableError(f"{c} is a partition column")
        if c.split(".")[0] not in names:
            raise TableError(f"no column {c}")
    if len(set(columns)) < len(columns):
        raise TableError("a column is named twice")
    adds = chosen(table, filters)
    metrics = {"num_files_added": 0, "num_files_removed": 0, "partitions_optimized": len({partition_key(a) for a in adds}), "total_considered_files": len(adds), "total_files_skipped": 0, "files_added": {}, "files_removed": {}, "preserve_insertion_order": True}
    if not adds:
        return metrics
    with session(table.spark):
        rows = scan(table.spark, table.store, table.snapshot, adds)
        n = max(1, -(-sum(a["size"] for a in adds) // target_size(table, size)))
        counts = [table.rows_of(a) for a in adds]
        rows = with_zorder_key(rows, columns, rows.count() if None in counts else sum(counts), "__tarn_z")
        by = [*[F.col(f"`{c}`") for c in meta.partition_columns], F.col("__tarn_z")]
        rows = (rows.repartitionByRange(n, *by) if n > 1 else rows.coalesce(1)).sortWithinPartitions(*by).drop("__tarn_z")
        added = write_files(table.spark, table.store, rows, meta, properties=properties or WriterProperties(compression="zstd", compression_level=4), data_change=False, sort=True)
    _commit_optimize(table, added + [remove_of(a, False) for a in adds], {"targetSize": str(target_size(table, size)), "zOrderBy": columns, "predicate": filters}, metrics, commit_properties, post)
    metrics["total_time_ms"] = int(1000 * (time.time() - began))
    return metrics


def vacuum(table, retention_hours: float | None = None, dry_run: bool = True, enforce_retention_duration: bool = True, full: bool = False, keep_versions=None, commit_properties=None, post=None, now: int | None = None) -> list[str]:
    """Delete (or with ``dry_run`` only name) data files that no kept version needs.

    Lite: files of tombstones older than the retention. Full: files too that the log doesn't know and that are as old.
    """
    snapshot = table.snapshot
    least = duration_ms(snapshot.metadata.configuration.get("delta.deletedFileRetentionDuration"), 7)
    if retention_hours is not None and retention_hours < 0:
        raise TableError("the retention can't be negative")
    keep = least if retention_hours is None else int(retention_hours * 3600_000)
    if enforce_retention_duration and keep < least:
        raise TableError(f"the retention is {keep / 3600_000:g} hours, the table's least {least / 3600_000:g}")
    now = now or int(time.time() * 1000)
    needed = {relative(a) for a in snapshot.adds}
    for v in keep_versions or ():
        needed |= {relative(a) for a in table.log.snapshot(v).adds}
    recent = {relative(r) for r in snapshot.tombstones.values() if (r.get("deletionTimestamp") or 0) >= now - keep}
    old = {relative(r) for r in snapshot.tombstones.values()} - recent
    if full:
        found = []
        for f in table.store.list("", recursive=True):
            top = f.path.split("/")[0]
            hidden = any(x.startswith(("_", ".")) and "=" not in x for x in f.path.split("/")) and top != "_change_data"
            if top == LOG or hidden or f.path in needed or f.path in recent:
                continue
            if f.path in old or f.modified < now - keep:
                found.append(f)
        sizes = {f.path: f.size for f in found}
    else:
        # what the log says, without a listing of the table
        sizes = {relative(r): r.get("size") or 0 for r in snapshot.tombstones.values() if relative(r) in old - needed}
        sizes = {p: sizes[p] for p in table.store.existing(sorted(sizes))}
    paths = sorted(sizes)
    if dry_run or not paths:
        return paths
    params = {"retentionCheckEnabled": enforce_retention_duration, "specifiedRetentionMillis": None if retention_hours is None else keep, "defaultRetentionMillis": least}
    table.commit([], "VACUUM START", params, metrics={"numFilesToDelete": len(paths), "sizeOfDataToDelete": sum(sizes.values())}, props=commit_properties, post=post)
    table.store.delete_all(paths)
    table.commit([], "VACUUM END", {"status": "COMPLETED"}, metrics={"numDeletedFiles": len(paths), "numVacuumedDirectories": 0}, props=commit_properties, post=post)
    return paths


def restore(table, target: int | str | datetime, ignore_missing_files: bool = False, protocol_downgrade_allowed: bool = False, commit_properties=None, post=None) -> dict:
    """Make the table's state that of an earlier version, or of the last version by a time. Not tried again after a conflict."""
    now = table.snapshot
    version = target if isinstance(target, int) else table.log.at_time(target)
    if version >= now.version and isinstance(target, int) and version > now.version:
        raise TableError(f"no version {version}")
    then = table.log.snapshot(version)
    adds = [a for k, a in then.files.items() if k not in now.files]
    removes = [a for k, a in now.files.items() if k not in then.files]
    if not ignore_missing_files and (missing := [a["path"] for a in adds if not table.store.exists(relative(a))]):
        raise TableError(f"files are missing: {missing[:5]}")
    metrics = {"numRestoredFile": len(adds), "numRemovedFile": len(removes)}
    if not adds and not removes and then.metadata == now.metadata:
        return metrics
    actions = [{"add": {**a, "dataChange": True}} for a in adds] + [remove_of(a) for a in removes]
    head = [then.metadata.action()] if then.metadata != now.metadata else []
    if then.protocol != now.protocol:
        p = then.protocol if protocol_downgrade_allowed else type(now.protocol)(max(then.protocol.reader, now.protocol.reader), max(then.protocol.writer, now.protocol.writer), tuple(sorted({*then.protocol.reader_features, *now.protocol.reader_features})), tuple(sorted({*then.protocol.writer_features, *now.protocol.writer_features})))
        if p != now.protocol:
            head.append(p.action())
    params = {"version": target if isinstance(target, int) else None, "timestamp": None if isinstance(target, int) else str(target)}
    table.commit(head + actions, "RESTORE", params, reads=Reads(everything=True), metrics=metrics, props=commit_properties, post=post, retries=0)
    return metrics


def repair(table, dry_run: bool = False, commit_properties=None, post=None) -> dict:
    """Take files out of the log that aren't in the store any more."""
    if bad := [a["path"] for a in table.snapshot.adds if a["path"].startswith("/") or "://" in a["path"]]:
        raise TableError(f"absolute paths can't be checked: {bad[:3]}")
    there = {f.path for f in table.store.list("", recursive=True)}
    gone = [a for a in table.snapshot.adds if relative(a) not in there]
    out = {"dry_run": dry_run, "files_removed": [a["path"] for a in gone]}
    if gone and not dry_run:
        table.commit([remove_of(a) for a in gone], "FSCK", {}, reads=Reads(files={key(a) for a in gone}), metrics=out, props=commit_properties, post=post)
    return out


def convert(table_type, spark, path: str, mode: str = "error", partition_by: T.StructType | None = None, name=None, description=None, configuration=None, commit_properties=None, post=None):
    """Make a folder of Parquet files, in Hive's layout if partitioned, a table in place."""
    from urllib.parse import unquote

    if table_type.exists(spark, path):
        if mode == "ignore":
            return table_type(spark, path)
        raise TableError(f"{path} is a table")
    table = table_type(spark, path, load=False)
    files = [f for f in table.store.list("", recursive=True) if f.path.endswith(".parquet") and not any(x.startswith(("_", ".")) and "=" not in x for x in f.path.split("/"))]
    if not files:
        raise TableError(f"{path} holds no Parquet files")
    values, keys = {}, None
    for f in files:
        pairs = [(unquote(k), None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)) for k, eq, v in (x.partition("=") for x in f.path.split("/")[:-1]) if eq]
        if keys is not None and [k for k, _ in pairs] != keys:
            raise TableError(f"{f.path} isn't partitioned as the others are")
        keys, values[f.path] = [k for k, _ in pairs], dict(pairs)
    given = {f.name: f for f in partition_by or ()}
    if set(keys or ()) != set(given):
        raise TableError(f"types of the partition columns {keys} must be given, and of no others")
    data = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*[table.store.absolute(f.path) for f in files]).schema
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in data if f.name not in given], *[given[k] for k in keys]])
    meta = Metadata(str(uuid.uuid4()), schema, tuple(keys), dict(configuration or {}), name, description, int(time.time() * 1000))
    stats = statistics(spark, table.store, [f.path for f in files], meta)
    adds = [{"add": {"path": encoded(f.path), "partitionValues": values[f.path], "size": f.size, "modificationTime": f.modified, "dataChange": True, "stats": stats.get(f.path)}} for f in files]
    table.commit([protocol_for(meta).action(), meta.action(), *adds], "CONVERT", {"numFiles": len(files), "partitionedBy": keys}, props=commit_properties, post=post, new=True)
    return table


def generate_manifests(table) -> list[str]:
    """Write the list of each partition's files where engines that don't know the log look for it."""
    groups: dict = {}
    for a in table.snapshot.adds:
        if a.get("deletionVector"):
            raise TableError("manifests can't say what deletion vectors take out")
        values = a.get("partitionValues") or {}
        folder = "/".join(f"{physical_name(f)}={_hive(values.get(physical_name(f)))}" for f in table.snapshot.metadata.schema if f.name in table.snapshot.metadata.partition_columns)
        groups.setdefault(folder, []).append(table.store.absolute(relative(a)))
    out = []
    for folder, files in sorted(groups.items()):
        path = "/".join(x for x in ("_symlink_format_manifest", folder, "manifest") if x)
        table.store.write(path, ("\n".join(sorted(files)) + "\n").encode())
        out.append(path)
    return out


def _hive(value: str | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else re.sub(r'[\x00-\x1f"#%\'*/:=?\\\x7f{\[\]^]', lambda m: f"%{ord(m[0]):02X}", value)

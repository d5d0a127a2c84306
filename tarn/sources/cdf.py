"""The change data feed: what each version changed, from its change files or from its adds and removes."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .deletion_vectors import deleted_frame
from .scan import FILE, ROW, scan
from .snapshot import Metadata, Snapshot, TableError, relative
from .store import uri_of

CHANGE, VERSION, TIME = "_change_type", "_commit_version", "_commit_timestamp"


def load_cdf(table, starting_version=None, ending_version=None, starting_timestamp=None, ending_timestamp=None, columns=None, predicate=None, allow_out_of_range: bool = False) -> DataFrame:
    """Rows of the feed with _change_type, _commit_version and _commit_timestamp (UTC, no zone).

    One scan for all files of a kind, over all versions: a plan's size grows with the kinds, not with the versions.
    """
    spark, log = table.spark, table.log
    commits = log.listing()[0]
    last = max(commits)
    first = starting_version if starting_version is not None else 0 if starting_timestamp is None else None
    if first is not None and first > last:
        if not allow_out_of_range:
            raise TableError(f"no version {first}: the last is {last}")
        return _shaped(table, [], columns, predicate)
    end = last if ending_version is None else min(ending_version, last)
    if first is not None and end < first:
        raise TableError(f"version {end} is before {first}")
    since, until = _when(starting_timestamp), _when(ending_timestamp)
    meta: Metadata = table.snapshot.metadata
    kinds: dict[str, list] = {"cdc": [], "insert": [], "delete": []}
    pairs, times, seen = [], {}, False
    state = log.snapshot(max(0, (first or 0) - 1)) if (first or 0) > 0 else None
    feed_on = state.metadata.flag("delta.enableChangeDataFeed") if state is not None else None
    for v in range(first or 0, end + 1):
        if v not in commits:
            raise TableError(f"version {v} isn't there any more")
        actions = log.commit(v)
        info = next((a["commitInfo"] for a in actions if "commitInfo" in a), {})
        time = info.get("inCommitTimestamp") or info.get("timestamp") or commits[v]
        for a in actions:
            if "metaData" in a:
                feed_on = Metadata.of(a["metaData"]).flag("delta.enableChangeDataFeed")
        if since is not None and time < since or until is not None and time > until:
            continue
        seen = True
        if not feed_on:
            raise TableError(f"the change data feed isn't on at version {v}")
        times[v] = time
        if cdc := [a["cdc"] for a in actions if "cdc" in a]:
            kinds["cdc"] += [(v, a) for a in cdc]
            continue
        adds = [a["add"] for a in actions if "add" in a and a["add"].get("dataChange")]
        removes = [a["remove"] for a in actions if "remove" in a and a["remove"].get("dataChange")]
        both = {a["path"] for a in adds} & {r["path"] for r in removes}
        pairs += [(v, next(r for r in removes if r["path"] == p), next(a for a in adds if a["path"] == p)) for p in sorted(both)]
        kinds["insert"] += [(v, a) for a in adds if a["path"] not in both]
        kinds["delete"] += [(v, r) for r in removes if r["path"] not in both]
    if not seen and (since is not None or until is not None) and not allow_out_of_range and since is not None and since > max(commits.values()):
        raise TableError("no commits that late")
    frames = []
    for kind, files in kinds.items():
        if not files:
            continue
        schema = T.StructType([*meta.schema.fields, T.StructField(CHANGE, T.StringType())]) if kind == "cdc" else meta.schema
        # a file may be in several versions (added, removed): one scan by distinct file, joined to its versions
        rows = scan(spark, table.store, Snapshot(version=0, metadata=meta), list({(a["path"], str(a.get("deletionVector"))): a for _, a in files}.values()), identity=True, schema=schema)
        if kind != "cdc":
            rows = rows.withColumn(CHANGE, F.lit(kind))
        where = spark.createDataFrame([(uri_of(table.store.absolute(relative(a))), v, times[v]) for v, a in files], f"{FILE} string, {VERSION} long, __t long")
        frames.append(rows.join(where, FILE))
    if pairs:
        # rows that one vector of a file has and the other hasn't, for all pairs at once: (version and file, row)
        uri = lambda a: uri_of(table.store.absolute(relative(a)))
        sides = []
        for side in (1, 2):
            vectors = [(f"{p[0]} {uri(p[2])}", p[side]["deletionVector"]) for p in pairs if p[side].get("deletionVector")]
            sides.append(deleted_frame(table.spark, table.store, vectors, "__k", ROW) if vectors else table.spark.createDataFrame([], f"__k string, {ROW} long"))
        was, now = sides
        picked = now.join(was, ["__k", ROW], "left_anti").withColumn(CHANGE, F.lit("delete")).unionByName(was.join(now, ["__k", ROW], "left_anti").withColumn(CHANGE, F.lit("insert")))
        picked = picked.select(ROW, CHANGE, F.expr("substring(__k, instr(__k, ' ') + 1)").alias(FILE), F.substring_index("__k", " ", 1).cast("long").alias(VERSION))
        rows = scan(table.spark, table.store, Snapshot(version=0, metadata=meta), list({p[2]["path"]: p[2] for p in pairs}.values()), identity=True, without_vectors=True)
        when = table.spark.createDataFrame(sorted({(p[0], times[p[0]]) for p in pairs}), f"{VERSION} long, __t long")
        frames.append(rows.join(picked, [FILE, ROW]).join(when, VERSION))
    return _shaped(table, frames, columns, predicate)


def _shaped(table, frames, columns, predicate) -> DataFrame:
    schema = table.snapshot.metadata.schema
    out = None
    for f in frames:
        f = f.select(*[F.col(f"`{c.name}`") for c in schema], CHANGE, VERSION, F.timestamp_millis("__t").cast("timestamp_ntz").alias(TIME))
        out = f if out is None else out.unionByName(f)
    if out is None:
        out = table.spark.createDataFrame([], T.StructType([*[T.StructField(c.name, c.dataType, True) for c in schema], T.StructField(CHANGE, T.StringType()), T.StructField(VERSION, T.LongType()), T.StructField(TIME, T.TimestampNTZType())]))
    if predicate:
        out = out.where(predicate)
    return out.select(*columns) if columns else out


def _when(t) -> int | None:
    if t is None:
        return None
    t = datetime.fromisoformat(t.replace("Z", "+00:00")) if isinstance(t, str) else t
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)

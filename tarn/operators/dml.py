"""DELETE, UPDATE, overwrite of a part, and MERGE, by rewriting the files that hold changed rows."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate, is_true
from ..functions.values import cast_to, merge_schema
from ..sources.scan import FILE, ROW, exact_partitions, prune, scan
from ..sources.snapshot import Metadata, TableError, key, relative
from ..sources.store import uri_of
from .commit import Reads, remove_of
from .writer import CHANGE, checked, conform, generated, predicate_of, protocol_for, session, violation, write_files


def touched_files(table, adds: list[dict], predicate: Predicate) -> tuple[list[dict], int]:
    """The files with rows where the predicate is true, and how many such rows: counted by Spark, one row a file."""
    rows = scan(table.spark, table.store, table.snapshot, adds, identity=True).where(predicate.column).groupBy(FILE).count().collect()
    found = {r[FILE]: r["count"] for r in rows}
    return [a for a in adds if uri_of(table.store.absolute(relative(a))) in found], sum(found.values())


def reads_of(table, adds: list[dict], predicate: Predicate | None) -> Reads:
    if predicate is None:
        return Reads(everything=True)
    return Reads(files={key(a) for a in adds}, matches=lambda a: bool(prune(table.spark, table.snapshot, [a], predicate)))


def delete(table, predicate=None, *, properties=None, commit_properties=None, post=None) -> dict:
    """Delete the rows where the predicate is true; all rows without one. Rows where it is null stay."""
    began = time.time()
    snapshot, meta = table.snapshot, table.snapshot.metadata
    p = None if predicate is None else predicate_of(table.spark, meta.schema, predicate)
    actions, metrics = [], {"num_added_files": 0, "num_removed_files": 0, "num_deleted_rows": None, "num_copied_rows": None}
    if p is None or p.columns <= set(meta.partition_columns):
        adds = snapshot.adds if p is None else exact_partitions(table.spark, snapshot, snapshot.adds, p)
        counts = [table.rows_of(a) for a in adds]
        metrics["num_deleted_rows"] = None if None in counts else sum(counts)
    else:
        with session(table.spark):
            candidates = prune(table.spark, snapshot, snapshot.adds, p)
            adds, n = touched_files(table, candidates, p) if candidates else ([], 0)
            metrics["num_deleted_rows"] = n
            if adds:
                rows = scan(table.spark, table.store, snapshot, adds)
                actions += write_files(table.spark, table.store, rows.where(~is_true(p.column)), meta, properties=properties)
                if meta.flag("delta.enableChangeDataFeed"):
                    actions += write_files(table.spark, table.store, rows.where(p.column).withColumn(CHANGE, F.lit("delete")), meta, cdc=True)
        metrics["num_copied_rows"] = sum(table.rows_of(a["add"]) or 0 for a in actions if "add" in a)
    metrics["num_added_files"] = sum("add" in a for a in actions)
    actions += [remove_of(a) for a in adds]
    metrics["num_removed_files"] = len(adds)
    metrics["execution_time_ms"] = int(1000 * (time.time() - began))
    if adds:
        table.commit(actions, "DELETE", {"predicate": p.sql if p else None}, reads=reads_of(table, adds, p), metrics=metrics, props=commit_properties, post=post)
    return metrics


def update(table, assignments: dict, predicate=None, *, safe: bool = False, properties=None, commit_properties=None, post=None) -> dict:
    """Set columns (name -> SQL or Column) in the rows where the predicate is true; in all without one."""
    began = time.time()
    snapshot, meta = table.snapshot, table.snapshot.metadata
    metrics = {"num_added_files": 0, "num_removed_files": 0, "num_updated_rows": 0, "num_copied_rows": 0}
    if not assignments:
        return metrics
    if meta.flag("delta.appendOnly"):
        raise TableError("the table is append-only")
    types = {f.name: f.dataType for f in meta.schema}
    if bad := set(assignments) - set(types):
        raise TableError(f"no columns {sorted(bad)}")
    p = None if predicate is None else predicate_of(table.spark, meta.schema, predicate)
    with session(table.spark):
        candidates = prune(table.spark, snapshot, snapshot.adds, p)
        if p is None:
            adds, n = candidates, None
        else:
            adds, n = touched_files(table, candidates, p) if candidates else ([], 0)
        if not adds:
            return metrics
        rows = scan(table.spark, table.store, snapshot, adds)
        hit = is_true(p.column) if p else F.lit(True)
        value = {c: _value(e, types[c], rows.schema, rows, safe) for c, e in assignments.items()}
        marked = rows.withColumn("__tarn_hit", hit)
        new = {c: F.when(F.col("__tarn_hit"), v).otherwise(F.col(f"`{c}`")).alias(c) for c, v in value.items()}
        after = marked.select(*[new.get(f.name, F.col(f"`{f.name}`")) for f in meta.schema], "__tarn_hit")
        for c, e in generated(meta.schema).items():
            if c not in assignments and references(marked, e) & set(assignments):
                after = after.withColumn(c, F.when(F.col("__tarn_hit"), F.expr(e).cast(types[c])).otherwise(F.col(f"`{c}`")))
        actions = write_files(table.spark, table.store, checked(after.drop("__tarn_hit"), meta), meta, properties=properties)
        if meta.flag("delta.enableChangeDataFeed"):
            both = marked.where("__tarn_hit").select(F.struct(*[F.col(f"`{f.name}`") for f in meta.schema]).alias("old"), F.struct(*[new.get(f.name, F.col(f"`{f.name}`").alias(f.name)) for f in meta.schema]).alias("new"))
            changed = both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.explode(F.array(F.struct(F.lit("update_preimage").alias(CHANGE), F.col("old").alias("r")), F.struct(F.lit("update_postimage").alias(CHANGE), F.col("new").alias("r")))).alias("x"))
            actions += write_files(table.spark, table.store, changed.select("x.r.*", f"x.{CHANGE}"), meta, cdc=True)
    written = sum(table.rows_of(a["add"]) or 0 for a in actions if "add" in a)
    n = written if n is None else n
    metrics |= {"num_added_files": sum("add" in a for a in actions), "num_removed_files": len(adds), "num_updated_rows": n, "num_copied_rows": written - n, "execution_time_ms": int(1000 * (time.time() - began))}
    table.commit(actions + [remove_of(a) for a in adds], "UPDATE", {"predicate": p.sql if p else None}, reads=reads_of(table, adds, p), metrics=metrics, props=commit_properties, post=post)
    return metrics


def references(rows: DataFrame, e: str) -> set[str]:
    """The columns of rows that an expression reads."""
    made = _seq(rows.select(F.expr(e).alias("e"))._jdf.queryExecution().analyzed().expressions())
    return {a.name() for x in made for a in _seq(x.references().toSeq())}


def _value(e, t: T.DataType, schema, rows: DataFrame, safe: bool) -> Column:
    c = F.expr(e) if isinstance(e, str) else e if isinstance(e, Column) else F.lit(e)
    return cast_to(c, rows.select(c.alias("v")).schema["v"].dataType, t, safe)


#: Bytes of files that a merge reads whole without asking first which of them hold a match.
READ_AT_ONCE = 128 << 20
#: Partition values of a source by which a merge chooses files one by one.
MOST_VALUES = 1000
MATCHED, INSERT, BY_SOURCE = "matched", "not_matched", "not_matched_by_source"
UPDATE, DELETE, ADD, COPY, SKIP = "update", "delete", "insert", "copy", "skip"


@dataclass
class Clause:
    kind: str
    action: str
    predicate: str | None = None
    assignments: dict = field(default_factory=dict)


class DuplicateMatch(TableError):
    """More than one source row would change the same target row."""


@dataclass
class Merge:
    """A merge being put together: clauses of a kind are tried in their order, and the first one that fits acts."""

    table: object
    source: DataFrame
    predicate: str
    source_alias: str | None = None
    target_alias: str | None = None
    merge_schema: bool = False
    safe: bool = False
    properties: object = None
    commit_properties: object = None
    post: object = None
    clauses: list[Clause] = field(default_factory=list)

    def _add(self, kind, action, predicate=None, assignments=None) -> Merge:
        self.clauses.append(Clause(kind, action, predicate, dict(assignments or {})))
        return self

    def when_matched_update(self, updates: dict, predicate: str | None = None) -> Merge:
        return self._add(MATCHED, UPDATE, predicate, updates)

    def when_matched_update_all(self, predicate: str | None = None, except_cols=None) -> Merge:
        return self._add(MATCHED, UPDATE, predicate, self._all(except_cols))

    def when_matched_delete(self, predicate: str | None = None) -> Merge:
        return self._add(MATCHED, DELETE, predicate)

    def when_not_matched_insert(self, updates: dict, predicate: str | None = None) -> Merge:
        return self._add(INSERT, ADD, predicate, updates)

    def when_not_matched_insert_all(self, predicate: str | None = None, except_cols=None) -> Merge:
        return self._add(INSERT, ADD, predicate, self._all(except_cols))

    def when_not_matched_by_source_update(self, updates: dict, predicate: str | None = None) -> Merge:
        return self._add(BY_SOURCE, UPDATE, predicate, updates)

    def when_not_matched_by_source_delete(self, predicate: str | None = None) -> Merge:
        return self._add(BY_SOURCE, DELETE, predicate)

    def _all(self, except_cols) -> dict:
        src = self.source_alias or "source"
        return {c: F.col(f"{src}.`{c}`") for c in self.source.columns if c not in set(except_cols or ())}

    def execute(self) -> dict:
        return merge(self)


def _strip(name: str, alias: str) -> str:
    name = name.strip("`")
    return name.removeprefix(f"{alias}.").strip("`")


def merge(m: Merge) -> dict:
    """One join of source and target, one pass of clauses, and a rewrite of the files with changed rows only.

    What the join writes is the rows that change or are new; the other rows of touched files go from file to file.

    The source is written to the shared folder first, as it is read several times. Where no clause looks at target rows
    without a source row, files are pruned beforehand by what the source holds of the columns that the predicate
    equates, and, if these are large, a semi join on the predicate's columns alone then leaves the files that hold a
    match: only they are read whole. A target row that several source rows would change is an error, but for several unconditional deletes.
    """
    from ..sources.workspace import scratch

    began = time.time()
    table, spark = m.table, m.table.spark
    snapshot, meta = table.snapshot, table.snapshot.metadata
    src, tgt = m.source_alias or "source", m.target_alias or "target"
    assigned = {_strip(c, tgt) for k in m.clauses for c in k.assignments}
    metrics = {k: 0 for k in ("num_source_rows", "num_target_rows_inserted", "num_target_rows_updated", "num_target_rows_deleted", "num_target_rows_copied", "num_output_rows", "num_target_files_scanned", "num_target_files_skipped_during_scan", "num_target_files_added", "num_target_files_removed")}
    if not m.clauses:
        raise TableError("a merge needs a clause")
    if meta.flag("delta.appendOnly") and any(k.action in (UPDATE, DELETE) for k in m.clauses):
        raise TableError("the table is append-only")
    with session(spark):
        schema = meta.schema
        if m.merge_schema:
            schema = merge_schema(meta.schema, T.StructType([f for f in m.source.schema if f.name in assigned]))
        names = {f.name: f.dataType for f in schema}
        if bad := assigned - set(names):
            raise TableError(f"the table has no columns {sorted(bad)}")
        new_meta = Metadata(**{**meta.__dict__, "schema": schema})
        path = scratch(spark, "merge-source")
        m.source.write.parquet(path)
        source = spark.read.schema(m.source.schema).parquet(path)
        metrics["num_source_rows"] = source.count()
        by_source = any(k.kind == BY_SOURCE for k in m.clauses)
        only_inserts = all(k.kind == INSERT for k in m.clauses)

        def target_of(files):
            rows = scan(spark, table.store, snapshot, files, identity=True)
            for f in schema:
                if f.name not in rows.columns:
                    rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
            return rows.withColumn("__tarn_t", F.lit(True)).alias(tgt)

        adds = scanned = snapshot.adds if by_source else early_filter(m, source, snapshot.adds, src, tgt)
        if len(adds) > 1 and not by_source and not only_inserts and sum(a.get("size") or 0 for a in adds) > READ_AT_ONCE:
            # one row a file
            matched_files = {r[FILE] for r in target_of(adds).join(source.alias(src), F.expr(m.predicate), "left_semi").select(FILE).distinct().collect()}
            adds = [a for a in adds if uri_of(table.store.absolute(relative(a))) in matched_files]
        t = target_of(adds)
        s = source.withColumn("__tarn_s", F.lit(True)).alias(src)
        if only_inserts:
            joined = s.join(t, F.expr(m.predicate), "left_anti").select(F.struct(*[F.col(f"{src}.`{c}`") for c in source.columns]).alias(src))
            none = F.lit(None).cast(T.StructType([*schema.fields, T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())])).alias(tgt)
            joined = joined.select(F.col(src), none, F.lit(True).alias("__tarn_s"), F.lit(None).cast("boolean").alias("__tarn_t"))
        else:
            # source rows without a match count only where they are inserted; without them Spark may broadcast the source
            kind = "full" if any(k.kind == INSERT for k in m.clauses) else "right"
            joined = s.join(t, F.expr(m.predicate), kind).select(F.struct(*[F.col(f"{src}.`{c}`") for c in source.columns]).alias(src), F.struct(*[F.col(f"{tgt}.`{c}`") for c in [*names, FILE, ROW]]).alias(tgt), "__tarn_s", "__tarn_t")
        both, source_only, target_only = F.col("__tarn_s") & F.col("__tarn_t"), F.col("__tarn_t").isNull(), F.col("__tarn_s").isNull()
        flag = {MATCHED: F.coalesce(both, F.lit(False)), INSERT: source_only, BY_SOURCE: target_only}
        op = None
        for i, k in enumerate(m.clauses):
            c = flag[k.kind] & (is_true(F.expr(k.predicate)) if k.predicate else F.lit(True))
            op = F.when(c, F.lit(i)) if op is None else op.when(c, F.lit(i))
        op = op.when(source_only, F.lit(-2)).otherwise(F.lit(-1))  # dropped source rows; copied target rows
        acts = joined.withColumn("__tarn_op", op)
        gen = generated(schema)
        outs = []
        for f in schema:
            c = None
            for i, k in enumerate(m.clauses):
                if k.action not in (UPDATE, ADD):
                    continue
                sets = {_strip(a, tgt): e for a, e in k.assignments.items()}
                if f.name in sets:
                    v = _value(sets[f.name], f.dataType, None, joined, m.safe)
                else:
                    v = F.lit(None).cast(f.dataType) if k.action == ADD else F.col(f"{tgt}.`{f.name}`")
                here = F.col("__tarn_op") == i
                c = F.when(here, v) if c is None else c.when(here, v)
            old = F.col(f"{tgt}.`{f.name}`")
            outs.append((old if c is None else c.otherwise(old)).alias(f.name))
        actions_of = F.create_map(*[x for i, k in enumerate(m.clauses) for x in (F.lit(i), F.lit(k.action))], F.lit(-1), F.lit(COPY), F.lit(-2), F.lit(SKIP))
        cdf = meta.flag("delta.enableChangeDataFeed")
        old = [F.struct(*[F.col(f"{tgt}.`{n}`").alias(n) for n in names]).alias("old")] if cdf else []
        result = acts.select(F.struct(*outs).alias("new"), *old, F.col(f"{tgt}.{FILE}").alias(FILE), F.col(f"{tgt}.{ROW}").alias(ROW), "__tarn_op", F.coalesce(both, F.lit(False)).alias("__tarn_both"), actions_of[F.col("__tarn_op")].alias("act"))
        # only rows that change or are new are written, once: the checks, the touched files, the rows and the feed read them
        kept = scratch(spark, "merge-rows")
        flat = result.where(~F.col("act").isin(SKIP, COPY))
        try:
            flat.write.parquet(kept)
        except Exception as e:
            if (why := violation(e)) is not None:
                raise why from None
            raise
        rows = spark.read.schema(flat.schema).parquet(kept)
        plain_deletes = [i for i, k in enumerate(m.clauses) if k.kind == MATCHED and k.action == DELETE and not k.predicate]
        is_plain = F.col("__tarn_op").isin(plain_deletes) if plain_deletes else F.lit(False)
        matched = rows.where("__tarn_both").groupBy(FILE, ROW).agg(F.count_if(~is_plain).alias("a"), F.count_if(is_plain).alias("d"))
        worst = matched.agg(F.max(F.when((F.col("a") > 1) | (F.col("a") >= 1) & (F.col("d") >= 1), 1).otherwise(0)).alias("bad"), F.max("d").alias("d")).first()
        if worst["bad"]:
            raise DuplicateMatch("several source rows match and change the same target row")
        if (worst["d"] or 0) > 1:
            # deletions of one row by several source rows are one
            rows = rows.where(F.col(FILE).isNotNull()).dropDuplicates([FILE, ROW]).unionByName(rows.where(F.col(FILE).isNull()))
        counts, changed = {}, set()
        # a row a file and kind of action
        for r in rows.groupBy("act", FILE).count().collect():
            counts[r["act"]] = counts.get(r["act"], 0) + r["count"]
            if r[FILE] is not None:
                changed.add(r[FILE])
        touched = [a for a in adds if uri_of(table.store.absolute(relative(a))) in changed]
        sizes = [table.rows_of(a) for a in touched]
        total = target_of(touched).count() if None in sizes else sum(sizes)
        if total > counts.get(UPDATE, 0) + counts.get(DELETE, 0):
            counts[COPY] = total - counts.get(UPDATE, 0) - counts.get(DELETE, 0)
        new = rows.where(F.col("act") != DELETE).select("new.*")
        for name, e in gen.items():
            if not any(name in {_strip(a, tgt) for a in k.assignments} for k in m.clauses):
                new = new.withColumn(name, F.expr(e).cast(names[name]))
        if counts.get(COPY):
            # the other rows of touched files come from the files themselves
            rest = target_of(touched).join(rows.where(F.col(FILE).isNotNull()).select(FILE, ROW), [FILE, ROW], "left_anti").select(*[F.col(f"`{n}`") for n in names])
            new = new.unionByName(rest)
        actions = write_files(spark, table.store, checked(new, new_meta), new_meta, properties=m.properties) if set(counts) - {DELETE} else []
        if cdf and set(counts) - {COPY}:
            one = lambda kind, col: F.struct(F.lit(kind).alias(CHANGE), F.col(col).alias("r"))
            kinds = F.when(F.col("act") == ADD, F.array(one("insert", "new"))).when(F.col("act") == DELETE, F.array(one("delete", "old"))).otherwise(F.array(one("update_preimage", "old"), one("update_postimage", "new")))
            actions += write_files(spark, table.store, rows.select(F.explode(kinds).alias("x")).select("x.r.*", f"x.{CHANGE}"), new_meta, cdc=True)
    metrics |= {
        "num_target_rows_inserted": counts.get(ADD, 0), "num_target_rows_updated": counts.get(UPDATE, 0), "num_target_rows_deleted": counts.get(DELETE, 0), "num_target_rows_copied": counts.get(COPY, 0),
        "num_output_rows": sum(counts.values()) - counts.get(DELETE, 0), "num_target_files_scanned": len(scanned), "num_target_files_skipped_during_scan": len(snapshot.files) - len(scanned),
        "num_target_files_added": sum("add" in a for a in actions), "num_target_files_removed": len(touched), "execution_time_ms": int(1000 * (time.time() - began)),
    }
    actions += [remove_of(a) for a in touched]
    if not actions:
        return metrics
    head = []
    if schema != meta.schema:
        if (protocol := protocol_for(new_meta, snapshot.protocol)) != snapshot.protocol:
            head.append(protocol.action())
        head.append(new_meta.action())
    listed = lambda kind: [{"actionType": k.action, **({"predicate": k.predicate} if k.predicate else {})} for k in m.clauses if k.kind == kind]
    params = {"mergePredicate": m.predicate, "matchedPredicates": listed(MATCHED), "notMatchedPredicates": listed(INSERT), "notMatchedBySourcePredicates": listed(BY_SOURCE)}
    reads = Reads(everything=True) if len(scanned) == len(snapshot.files) else Reads(files={key(a) for a in scanned}, matches=lambda a: True)
    table.commit(head + actions, "MERGE", params, reads=reads, metrics=metrics, props=m.commit_properties, post=m.post)
    return metrics


def early_filter(m: Merge, source: DataFrame, adds: list[dict], src: str, tgt: str) -> list[dict]:
    """The files that can hold a match: for target columns that the predicate equates with source expressions, the source's range; and what it says of the target alone.

    One aggregate over the source, whatever its size.
    """
    table = m.table
    spark, schema = table.spark, table.snapshot.metadata.schema
    if not adds:
        return adds
    t = spark.createDataFrame([], schema).alias(tgt)
    s = spark.createDataFrame([], source.schema).alias(src)
    plan = s.join(t, F.expr(m.predicate), "inner")._jdf.queryExecution().analyzed()
    of_target = {a.exprId().toString() for a in _seq(t._jdf.queryExecution().analyzed().output())}
    ids_source = {a.exprId().toString(): a.name() for a in _seq(s._jdf.queryExecution().analyzed().output())}
    condition = plan.condition().get() if plan.condition().isDefined() else None
    parts, alone = [], []

    def split(e):
        if e.getClass().getSimpleName() == "And":
            for c in _seq(e.children()):
                split(c)
        else:
            parts.append(e)

    if condition is not None:
        split(condition)
    ranges = []
    for e in parts:
        refs = {a.exprId().toString() for a in _seq(e.references().toSeq())}
        kids = _seq(e.children())
        if refs and refs <= of_target:
            alone.append(e.sql())
        elif e.getClass().getSimpleName() == "EqualTo" and all(k.getClass().getSimpleName() == "AttributeReference" for k in kids):
            a, b = kids
            if a.exprId().toString() in ids_source:
                a, b = b, a
            if a.exprId().toString() in of_target and b.exprId().toString() in ids_source:
                ranges.append((a.name(), b.name()))
    out = adds
    if alone:
        text = " AND ".join(alone).replace(f"{tgt}.", "")
        try:
            out = prune(spark, table.snapshot, out, predicate_of(spark, schema, text))
        except Exception:  # noqa: BLE001  SQL that doesn't read back: no pruning by it
            out = adds
    if ranges:
        limits = source.agg(*[f(F.col(f"`{b}`")).alias(f"{n}{i}") for i, (_, b) in enumerate(ranges) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        types = {f.name: f.dataType for f in schema}
        for i, (a, _) in enumerate(ranges):
            lo, hi = limits[f"lo{i}"], limits[f"hi{i}"]
            if lo is None:
                return []  # equal to null only: nothing matches
            c = F.col(f"`{a}`")
            between = Predicate(spark, schema, (c >= F.lit(lo).cast(types[a])) & (c <= F.lit(hi).cast(types[a])))
            out = prune(spark, table.snapshot, out, between)
            if a in table.snapshot.metadata.partition_columns:
                # a partition's values are few, or there are too many to name
                values = [r[0] for r in source.select(F.col(f"`{ranges[i][1]}`").cast(types[a]).alias("v")).where("v IS NOT NULL").distinct().limit(MOST_VALUES + 1).collect()]
                if len(values) <= MOST_VALUES:
                    out = prune(spark, table.snapshot, out, Predicate(spark, schema, c.isin(values)))
    return out


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def conformed(df: DataFrame, metadata: Metadata, safe: bool = False) -> DataFrame:
    return checked(conform(df, metadata.schema, safe), metadata)

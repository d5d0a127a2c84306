"""Queries for operations whose effect is an error, a log entry or a choice of files: each returns it as rows, with SQL for the same."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import PredicateError
from ..operators.commit import CommitConflict, CommitProperties, remove_of
from ..operators.dml import DuplicateMatch
from ..operators.writer import WriterProperties
from ..sources.batches import BatchWriter
from ..sources.deletion_vectors import inline
from ..sources.snapshot import ProtocolError
from ..sources.workspace import scratch
from ..streaming.sink import ChangeReader, append_batches, merge_batches
from ..table import QueryBuilder, SchemaError, Table, TableError, create_with_adds, write_table
from .tables import CDF, _source, made, orders, raw

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def refused(errors, f) -> bool:
    """Whether f raises one of the errors."""
    try:
        f()
    except errors:
        return True
    return False


def facts(spark, **values):
    """One row of what an operation said."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))


# -- reads -----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0")
def deletion_vector_listing(spark, sf):
    """Which rows of which file the listing keeps, joined to the rows that the files hold."""
    t = made(spark, raw(spark, sf, "nation").coalesce(1), configuration={"delta.enableDeletionVectors": "true"})
    old = t.snapshot.adds[0]
    every = t.to_df(row_column="i").select("n_nationkey", "i")
    rows = [r["i"] for r in every.where("n_nationkey % 3 = 0").collect()]
    every = spark.createDataFrame(every.collect(), every.schema)
    t.commit([remove_of(old), {"add": {**old, "deletionVector": inline(rows), "dataChange": True}}], "DELETE", {})
    kept = t.deletion_vectors().select(F.posexplode("selection_vector").alias("i", "keep"))
    return every.join(kept.where("keep").select(F.col("i").cast("long").alias("i")), "i").select("n_nationkey")


@query("SELECT o_orderstatus, CAST(1 AS BIGINT) AS files, count(*) AS n FROM orders GROUP BY o_orderstatus")
def file_column(spark, sf):
    t = made(spark, orders(spark, sf).coalesce(1), partition_by="o_orderstatus")
    return t.to_df(file_column="f").groupBy("o_orderstatus").agg(F.countDistinct("f").alias("files"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def file_selection(spark, sf):
    t = made(spark, orders(spark, sf).select("o_orderkey", "o_totalprice", "o_orderstatus"), partition_by="o_orderstatus")
    return t.to_df(paths=t.file_uris([("o_orderstatus", "=", "P")]), columns=["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderkey % 2 = 0")
def load_builder(spark, sf):
    """Version, columns, filters and predicate of one read."""
    o = orders(spark, sf)
    t = made(spark, o.where("o_orderkey % 2 = 0"), partition_by="o_orderstatus")
    write_table(spark, t, o.where("o_orderkey % 2 = 1"), mode="append")
    return Table(spark, t.path, version=0).to_df(filters=[("o_orderstatus", "=", "F")], predicate="o_totalprice > 100000", columns=["o_orderkey", "o_orderpriority"])


@query("""SELECT n_nationkey, 'delete' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT n_nationkey, 'delete', 2 FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT n_nationkey, 'insert', 2 FROM nation WHERE n_nationkey % 4 = 0""")
def cdf_vector_pairs(spark, sf):
    """The feed of a file whose deletion vector changes: what one has and the other hasn't."""
    t = made(spark, raw(spark, sf, "nation").select("n_nationkey").coalesce(1), configuration={**CDF, "delta.enableDeletionVectors": "true"})
    old = t.snapshot.adds[0]
    at = {r["n_nationkey"]: r["i"] for r in t.to_df(row_column="i").collect()}
    last = old
    for k in (0, 1):
        new = {**old, "deletionVector": inline(sorted(i for n, i in at.items() if n % 4 == k)), "dataChange": True}
        t.commit([remove_of(last), {"add": new}], "DELETE", {})
        last = new
    return t.load_cdf(1).drop("_commit_timestamp")


@query("SELECT DISTINCT c_mktsegment, CAST(c_nationkey % 3 AS INT) AS k FROM customer WHERE c_mktsegment <> 'BUILDING'")
def partition_listing(spark, sf):
    t = made(spark, raw(spark, sf, "customer").withColumn("k", F.expr("c_nationkey % 3").cast("int")), partition_by=["c_mktsegment", "k"])
    rows = [(p["c_mktsegment"], int(p["k"])) for p in t.partitions([("c_mktsegment", "!=", "BUILDING")])]
    return spark.createDataFrame(rows, "c_mktsegment string, k int")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def file_uri_listing(spark, sf):
    """The files that the listing names hold these rows, read as plain Parquet."""
    t = made(spark, raw(spark, sf, "customer"), partition_by="c_mktsegment")
    return spark.read.parquet(*t.file_uris([("c_mktsegment", "=", "HOUSEHOLD")])).select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def arrow_reader(spark, sf):
    t = made(spark, raw(spark, sf, "nation"), partition_by="n_regionkey")
    return spark.createDataFrame(t.to_arrow(filters=[("n_regionkey", "=", 2)], columns=["n_nationkey", "n_name"]))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def pandas_reader(spark, sf):
    t = made(spark, raw(spark, sf, "nation"), partition_by="n_regionkey")
    return spark.createDataFrame(t.to_pandas(filters=[("n_regionkey", "=", 3)], columns=["n_nationkey", "n_name"]))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sql_external_table(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    q = QueryBuilder(spark)
    q.execute(f"CREATE EXTERNAL TABLE tarn_customers STORED AS TARN LOCATION '{t.path}'")
    return q.execute("SELECT c_mktsegment, count(*) AS n FROM tarn_customers GROUP BY c_mktsegment")


@query("SELECT * FROM region")
def storage_uri(spark, sf):
    """A table by a URI with a scheme."""
    path = scratch(spark, "table")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    write_table(spark, path, raw(spark, sf, "region"))
    return Table(spark, path).to_df()


@query("SELECT CAST(1 AS BIGINT) AS version, 'o_orderkey,o_totalprice,o_orderstatus' AS columns, 'o_orderstatus' AS partitions, CAST(2 AS BIGINT) AS commits, 'true' AS feed, 'named' AS name")
def accessors(spark, sf):
    t = made(spark, orders(spark, sf).select("o_orderkey", "o_totalprice", "o_orderstatus"), partition_by="o_orderstatus", configuration=CDF, name="named")
    t.delete("o_orderstatus = 'P'")
    return facts(spark, version=t.version(), columns=",".join(t.schema().names), partitions=",".join(t.metadata().partition_columns), commits=len(t.history()), feed=t.table_config()["delta.enableChangeDataFeed"], name=t.metadata().name)


@query("SELECT CAST(7 AS BIGINT) AS version, true AS none, '{\"k\": 1}' AS domain, count(*) AS n FROM region")
def app_transactions(spark, sf):
    t = made(spark, raw(spark, sf, "region"), commit_properties=CommitProperties(app_transactions=(("app", 7),)))
    t.commit([{"domainMetadata": {"domain": "tarn.test", "configuration": '{"k": 1}', "removed": False}}], "WRITE", {})
    t = Table(spark, t.path)
    return facts(spark, version=t.transaction_version("app"), none=t.transaction_version("other") is None, domain=t.domain_metadata("tarn.test"), n=t.count())


# -- writes ----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM nation")
def create_then_append(spark, sf):
    n = raw(spark, sf, "nation")
    t = Table.create(spark, scratch(spark, "table"), n.schema, partition_by="n_regionkey", description="nations")
    assert t.count() == 0 and Table.exists(spark, t.path)
    write_table(spark, t, n, mode="append")
    return t.to_df()


@query("SELECT *, true AS error, true AS append FROM region")
def create_modes(spark, sf):
    """error and append refuse, ignore keeps, overwrite empties."""
    r = raw(spark, sf, "region")
    t = made(spark, r)
    new = lambda mode: Table.create(spark, t.path, r.schema, mode=mode)
    error, append = refused(TableError, lambda: new("error")), refused(TableError, lambda: new("append"))
    kept = new("ignore").to_df()
    rows = kept.collect()
    assert new("overwrite").count() == 0
    return spark.createDataFrame(rows, r.schema).withColumn("error", F.lit(error)).withColumn("append", F.lit(append))


@query("SELECT * FROM region")
def write_modes(spark, sf):
    r = raw(spark, sf, "region")
    t = made(spark, r)
    assert refused(TableError, lambda: write_table(spark, t.path, r, mode="error"))
    write_table(spark, t.path, r, mode="ignore")
    return Table(spark, t.path).to_df()


@query("SELECT CAST(sum(o_totalprice) AS DECIMAL(18, 0)) AS total, 'ZSTD' AS codec, true AS bloom FROM orders")
def writer_properties(spark, sf):
    """Files with the codec and the filters that were asked for."""
    import pyarrow.parquet as pq

    t = made(spark, orders(spark, sf), properties=WriterProperties(compression="zstd", compression_level=3, bloom_filter_columns=("o_orderkey",)))
    path = t.file_uris()[0].removeprefix("file://").removeprefix("file:")
    file = pq.ParquetFile(path)
    codec = file.metadata.row_group(0).column(0).compression
    with open(path, "rb") as f:
        bloom = len(f.read()) > 0 and file.metadata.num_rows > 0
    return t.to_df().agg(F.sum("o_totalprice").cast("decimal(18,0)").alias("total")).withColumn("codec", F.lit(codec)).withColumn("bloom", F.lit(bool(bloom)))


@query("SELECT 'me' AS author, CAST(1 AS BIGINT) AS commits")
def commit_properties(spark, sf):
    t = made(spark, raw(spark, sf, "region"), commit_properties=CommitProperties(custom_metadata={"author": "me"}))
    assert refused(TableError, lambda: write_table(spark, t, raw(spark, sf, "region"), mode="append", commit_properties=CommitProperties(custom_metadata={"operation": "x"})))
    return facts(spark, author=t.history()[0]["author"], commits=len(Table(spark, t.path).history()))


@query("SELECT n_nationkey, n_name, NULL::DOUBLE AS extra FROM nation UNION ALL SELECT 100, 'json', NULL UNION ALL SELECT 101, NULL, NULL UNION ALL SELECT 102, NULL, 1.5")
def batch_writer(spark, sf):
    """Arrow batches, JSON rows, and batches with a new column."""
    import pyarrow as pa

    n = raw(spark, sf, "nation").select("n_nationkey", "n_name")
    t = Table.create(spark, scratch(spark, "table"), n.schema)
    w = BatchWriter(t)
    w.write(n.toArrow())
    w.write_json(['{"n_nationkey": 100, "n_name": "json"}', {"n_nationkey": 101}])
    w.flush_and_commit()
    w = BatchWriter(Table(spark, t.path), merge_schema=True)
    w.write(pa.table({"n_nationkey": pa.array([102], pa.int32()), "extra": [1.5]}))
    w.flush_and_commit()
    return Table(spark, t.path).to_df()


@query("SELECT * FROM nation WHERE n_regionkey < 3")
def caller_made_adds(spark, sf):
    """A table made of another one's files, and a commit of such files."""
    n = raw(spark, sf, "nation")
    t = made(spark, n.where("n_regionkey < 2").coalesce(1))
    other = create_with_adds(spark, t.path + "-adds", t.schema(), [])
    write_table(spark, t, n.where("n_regionkey = 2").coalesce(1), mode="append")
    for a in t.snapshot.adds:
        other.store.write(a["path"], t.store.read(a["path"]))
    other.create_write_transaction([{**a, "dataChange": True} for a in t.snapshot.adds])
    return Table(spark, other.path).to_df()


# -- DELETE, UPDATE, MERGE -------------------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE false")
def delete_all(spark, sf):
    t = made(spark, orders(spark, sf))
    assert t.delete()["num_added_files"] == 0
    return t.to_df()


@query("SELECT *, true AS refused FROM customer")
def merge_duplicate_match(spark, sf):
    """Two source rows for one target row change nothing."""
    c = raw(spark, sf, "customer")
    t = made(spark, c)
    twice = c.where("c_custkey % 9 = 0").withColumn("c_acctbal", F.lit(0.0))
    twice = twice.unionByName(twice.withColumn("c_acctbal", F.lit(1.0)))
    no = refused(DuplicateMatch, lambda: t.merge(twice, "t.c_custkey = s.c_custkey", "s", "t").when_matched_update({"c_acctbal": "s.c_acctbal"}).execute())
    return t.refresh().to_df().withColumn("refused", F.lit(no))


@query("SELECT * FROM customer WHERE c_custkey % 9 <> 0")
def merge_duplicate_delete(spark, sf):
    """An unconditional deletion takes a row that matches twice."""
    c = raw(spark, sf, "customer")
    t = made(spark, c)
    s = c.where("c_custkey % 9 = 0")
    t.merge(s.unionByName(s), "t.c_custkey = s.c_custkey", "s", "t").when_matched_delete().execute()
    return t.to_df()


@query("SELECT CAST(1 AS BIGINT) AS removed, CAST(count(DISTINCT c_mktsegment) - 1 AS BIGINT) AS kept FROM customer")
def merge_barrier(spark, sf):
    """Files without a match stay in the log as they are."""
    c = raw(spark, sf, "customer")
    t = made(spark, c.coalesce(1), partition_by="c_mktsegment")
    before = set(t.file_uris())
    got = t.merge(c.where("c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0"), "t.c_custkey = s.c_custkey", "s", "t").when_matched_update({"c_acctbal": "s.c_acctbal + 1"}).execute()
    return facts(spark, removed=got["num_target_files_removed"], kept=len(before & set(t.file_uris())))


@query("SELECT c_custkey, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal, true AS skipped FROM customer")
def merge_early_filter(spark, sf):
    """Partitions that the condition or the source's values rule out aren't read."""
    c = raw(spark, sf, "customer")
    t = made(spark, c.coalesce(1), partition_by="c_mktsegment")
    s = c.where("c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0")
    got = t.merge(s, "t.c_custkey = s.c_custkey AND t.c_mktsegment = s.c_mktsegment", "s", "t").when_matched_update({"c_acctbal": "t.c_acctbal + 1"}).execute()
    return t.to_df().select("c_custkey", "c_acctbal").withColumn("skipped", F.lit(got["num_target_files_skipped_during_scan"] >= 1))


@query("""SELECT CAST(sum(a) AS BIGINT) AS source_rows, CAST(sum(i) AS BIGINT) AS inserted, CAST(sum(u) AS BIGINT) AS updated, CAST(sum(d) AS BIGINT) AS deleted FROM (
SELECT CASE WHEN c_custkey % 5 < 2 THEN 1 ELSE 0 END AS a, CASE WHEN c_custkey % 5 = 1 THEN 1 ELSE 0 END AS i, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS u, CASE WHEN c_custkey % 5 = 3 THEN 1 ELSE 0 END AS d FROM customer) q""")
def merge_metrics(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    m = t.merge(_source(spark, sf), "t.c_custkey = s.c_custkey", "s", "t").when_matched_update_all().when_not_matched_insert_all().when_not_matched_by_source_delete("t.c_custkey % 5 = 3").execute()
    assert json.loads(t.history(1)[0]["operationParameters"]["matchedPredicates"])[0]["actionType"] == "update"
    return facts(spark, source_rows=m["num_source_rows"], inserted=m["num_target_rows_inserted"], updated=m["num_target_rows_updated"], deleted=m["num_target_rows_deleted"])


@query("SELECT count(*) AS n, true AS in_delete, true AS in_update FROM nation")
def determinism_guard(spark, sf):
    t = made(spark, raw(spark, sf, "nation"))
    in_delete = refused(PredicateError, lambda: t.delete("n_nationkey > rand() * 10"))
    in_update = refused(PredicateError, lambda: t.update({"n_name": "'x'"}, predicate="n_nationkey > rand() * 10"))
    return facts(spark, n=t.refresh().count(), in_delete=in_delete, in_update=in_update)


# -- maintenance and the log -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def optimize_incremental(spark, sf):
    """Compaction that commits as it goes."""
    o = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    t = made(spark, o.where("o_orderkey % 3 = 0"), partition_by="o_orderstatus")
    for k in (1, 2):
        write_table(spark, t, o.where(f"o_orderkey % 3 = {k}"), mode="append")
    before = t.version()
    t.optimize().compact(min_commit_interval=0)
    assert t.version() > before and len(t.file_uris()) == 3
    return t.to_df()


@query("SELECT n_nationkey, n_regionkey, true AS cleaned FROM nation")
def log_cleanup(spark, sf):
    n = raw(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    t = made(spark, n.where("n_regionkey = 0"))
    for k in (1, 2, 3, 4):
        write_table(spark, t, n.where(f"n_regionkey = {k}"), mode="append")
    t.create_checkpoint()
    for f in t.store.list("_delta_log"):
        os.utime(t.store.absolute(f.path), (1_000_000, 1_000_000))
    cleaned = t.cleanup_metadata() >= 3
    return Table(spark, t.path).to_df().withColumn("cleaned", F.lit(cleaned))


@query("SELECT *, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS INT) AS x FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT *, 'n', 5 FROM nation WHERE n_regionkey = 1")
def add_columns(spark, sf):
    n = raw(spark, sf, "nation")
    t = made(spark, n.where("n_regionkey <> 1"))
    t.alter().add_columns([T.StructField("note", T.StringType()), T.StructField("x", T.IntegerType())])
    assert refused(SchemaError, lambda: t.alter().add_columns(T.StructField("note", T.LongType())))
    write_table(spark, t, n.where("n_regionkey = 1").withColumn("note", F.lit("n")).withColumn("x", F.lit(5)), mode="append")
    return t.to_df()


@query("SELECT n_nationkey, true AS refused FROM nation UNION ALL SELECT NULL, true")
def drop_not_null(spark, sf):
    n = raw(spark, sf, "nation").select("n_nationkey")
    t = Table.create(spark, scratch(spark, "table"), T.StructType([T.StructField("n_nationkey", T.IntegerType(), False)]))
    write_table(spark, t, n, mode="append")
    null = spark.createDataFrame([(None,)], n.schema)
    no = refused(TableError, lambda: write_table(spark, t, null, mode="append"))
    t.alter().drop_column_not_null("n_nationkey")
    write_table(spark, t, null, mode="append")
    return t.to_df().withColumn("refused", F.lit(no))


@query("SELECT *, true AS append_only, true AS unknown FROM nation")
def table_properties(spark, sf):
    t = made(spark, raw(spark, sf, "nation"))
    t.alter().set_table_properties({"delta.appendOnly": "true"})
    unknown = refused(TableError, lambda: t.alter().set_table_properties({"delta.nothing": "1"}))
    return t.to_df().withColumn("append_only", F.lit(refused(TableError, lambda: t.delete("n_nationkey = 1")))).withColumn("unknown", F.lit(unknown))


@query("SELECT true AS refused, CAST(3 AS BIGINT) AS reader, CAST(7 AS BIGINT) AS writer, count(*) AS n FROM nation")
def add_feature(spark, sf):
    t = made(spark, raw(spark, sf, "nation"))
    no = refused(TableError, lambda: t.alter().add_feature("deletionVectors"))
    t.alter().add_feature("deletionVectors", allow_protocol_versions_increase=True)
    return facts(spark, refused=no, reader=t.protocol().reader, writer=t.protocol().writer, n=Table(spark, t.path).count())


@query("SELECT 'the key' AS comment, 'nice' AS name, 'some words' AS description, true AS reserved")
def describe_table(spark, sf):
    """Metadata of a column, name and description of the table."""
    t = made(spark, raw(spark, sf, "nation"))
    a = t.alter()
    a.set_column_metadata("n_nationkey", {"comment": "the key"})
    a.set_table_name("nice")
    a.set_table_description("some words")
    reserved = refused(TableError, lambda: a.set_column_metadata("n_nationkey", {"delta.x": "y"}))
    m = Table(spark, t.path).metadata()
    return facts(spark, comment=m.schema["n_nationkey"].metadata["comment"], name=m.name, description=m.description, reserved=reserved)


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (3) UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey < 2")
def concurrent_commits(spark, sf):
    """Appends that don't meet both stay; a deletion that read what another one changed is refused, as is an append after a change of metadata."""
    n = raw(spark, sf, "nation")
    t = made(spark, n.coalesce(1))
    one, two, stale = (Table(spark, t.path) for _ in range(3))
    for x, k in ((one, 0), (two, 1)):
        write_table(spark, x, n.where(f"n_regionkey = {k}").withColumn("n_nationkey", F.col("n_nationkey") + 100), mode="append")
    late = Table(spark, t.path)
    Table(spark, t.path).delete("n_nationkey = 3")
    assert refused(CommitConflict, lambda: late.delete("n_nationkey = 4"))
    assert refused(CommitConflict, lambda: stale.delete())
    old = Table(spark, t.path)
    Table(spark, t.path).alter().set_table_name("x")
    assert refused(CommitConflict, lambda: write_table(spark, old, n, mode="append"))
    return Table(spark, t.path).to_df()


@query("SELECT true AS refused, count(*) AS n FROM nation")
def protocol_gate(spark, sf):
    """A table that needs an unknown feature isn't read; its earlier version is."""
    t = made(spark, raw(spark, sf, "nation"))
    t.store.create("_delta_log/00000000000000000001.json", json.dumps({"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["whatIsThis"], "writerFeatures": ["whatIsThis"]}}).encode())
    return facts(spark, refused=refused(ProtocolError, lambda: Table(spark, t.path)), n=Table(spark, t.path, version=0).count())


@query("SELECT 'DELETE,UPDATE' AS before, 'DELETE1,UPDATE2' AS after")
def hooks(spark, sf):
    """What is called around each operation."""
    t = made(spark, raw(spark, sf, "nation"))
    before, after = [], []
    t.hooks.before.append(lambda operation, version: before.append(operation))
    t.hooks.after.append(lambda operation, version: after.append(f"{operation}{version}"))
    t.delete("n_nationkey = 1")
    t.update({"n_name": "'x'"})
    return facts(spark, before=",".join(before), after=",".join(after))


@query("SELECT false AS before, true AS after")
def table_exists(spark, sf):
    path = scratch(spark, "table")
    before = Table.exists(spark, path)
    write_table(spark, path, raw(spark, sf, "region"))
    return facts(spark, before=before, after=Table.exists(spark, path))


@query("SELECT count(*) AS n, true AS more, 'STREAMING UPDATE' AS operation FROM events")
def stream_commits(spark, sf):
    """What the log says of a stream's batches, whose files have about the size that the table asks for."""
    e = raw(spark, sf, "events")
    path = scratch(spark, "table")
    write = append_batches(spark, path, "label", configuration={"delta.targetFileSize": "20000"})
    for k in (0, 1):
        # a small batch is one task, a large one many, so that a task's files don't grow with the batch
        write(e.where(f"event_id % 2 = {k}").hint("rebalance"), k)
    t = Table(spark, path)
    return facts(spark, n=t.count(), more=len(t.file_uris()) > 4, operation=t.history(1)[0]["operation"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey < 500")
def arrow_dataset(spark, sf):
    """A dataset whose fragments are chosen by partition values and ranges."""
    import pyarrow.dataset as ds

    t = made(spark, orders(spark, sf).select("o_orderkey", "o_orderstatus").repartitionByRange(4, "o_orderkey"), partition_by="o_orderstatus")
    d = t.to_pyarrow_dataset()
    wanted = (ds.field("o_orderstatus") == "F") & (ds.field("o_orderkey") < 500)
    # what the log says: no file of another partition, and each that may hold such a row, however many that are
    opened = {f.path for f in d.get_fragments(wanted)} if t.snapshot.adds else set()
    may = {t.store.absolute(f) for f in t.files_scanned("o_orderstatus = 'F' AND o_orderkey < 500")}
    assert may <= opened <= set(t.file_uris([("o_orderstatus", "=", "F")]))
    return spark.createDataFrame(d.to_table(filter=wanted).cast(d.schema))


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def missing_files(spark, sf):
    """Files that are gone are an error, or left out where the caller says so."""
    t = made(spark, raw(spark, sf, "nation"), partition_by="n_regionkey")
    for f in t.file_uris([("n_regionkey", "=", "2")]):
        t.store.delete(f)
    assert refused(Exception, lambda: t.to_df().count() and t.to_df().collect())
    return t.to_df(missing_files="ignore")


@query("SELECT count(*) AS n FROM customer")
def sql_count(spark, sf):
    """COUNT(*) from the log: no file is read."""
    t = made(spark, raw(spark, sf, "customer"))
    q = QueryBuilder(spark).register("tarn_counted", t)
    for f in t.file_uris():
        t.store.delete(f)
    return q.execute("SELECT count(*) AS n FROM tarn_counted")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS s FROM part WHERE p_type SIMILAR TO '(STAND.*|SMALL)'")
def sql_dialect(spark, sf):
    """SIMILAR TO and arrow_cast."""
    q = QueryBuilder(spark).register("tarn_parts", made(spark, raw(spark, sf, "part")))
    return q.execute("SELECT p_partkey, arrow_cast(p_size + (1 - 1), 'Float64') AS s FROM tarn_parts WHERE p_type SIMILAR TO '(STAND.*|SMALL)'")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, true AS dictionary FROM orders")
def column_properties(spark, sf):
    """Settings of single columns: one without dictionary, the other with."""
    import pyarrow.parquet as pq

    from ..operators.writer import ColumnProperties

    o = orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    columns = {"o_orderstatus": ColumnProperties(dictionary=False), "o_orderpriority": ColumnProperties(dictionary=True), "o_orderkey": ColumnProperties(bloom_filter=True, bloom_filter_fpp=0.01, bloom_filter_ndv=10_000)}
    t = made(spark, o.coalesce(1), properties=WriterProperties(columns=columns, column_index_truncate_length=32))
    group = pq.ParquetFile(t.file_uris()[0].removeprefix("file://").removeprefix("file:")).metadata.row_group(0)
    by = {group.column(i).path_in_schema: set(group.column(i).encodings) for i in range(group.num_columns)}
    return t.to_df().withColumn("dictionary", F.lit(any("DICTIONARY" in e for e in by["o_orderpriority"]) and not any("DICTIONARY" in e for e in by["o_orderstatus"])))


# -- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(event_id % 2 AS BIGINT) AS read FROM events")
def stream_changes(spark, sf):
    """Each read of the feed returns what came since the read before."""
    e = raw(spark, sf, "events").select("event_id")
    path = scratch(spark, "table")
    write, reader, out = append_batches(spark, path, "s", configuration=CDF), ChangeReader(spark, path), None
    for k in (0, 1):
        write(e.where(f"event_id % 2 = {k}"), k)
        write(e.where(f"event_id % 2 = {k}"), k)
        got = reader.read().select("event_id", F.lit(k).cast("long").alias("read"))
        out = got if out is None else out.unionByName(got)
    assert reader.read() is None
    return out


@query("SELECT user_id, max(value) AS top FROM events GROUP BY user_id")
def stream_merge(spark, sf):
    """Batches merged into a table, one of them twice."""
    e = raw(spark, sf, "events")
    t = made(spark, e.select("user_id", F.col("value").alias("top")).limit(0))

    def build(table, batch, props):
        best = batch.groupBy("user_id").agg(F.max("value").alias("top"))
        table.merge(best, "t.user_id = s.user_id", "s", "t", commit_properties=props).when_matched_update({"top": "greatest(s.top, t.top)"}).when_not_matched_insert_all().execute()

    write = merge_batches(spark, t.path, "m", build)
    for n, k in ((0, 0), (1, 1), (1, 1), (2, 2)):
        write(e.where(f"event_id % 3 = {k}"), n)
    return Table(spark, t.path).to_df()

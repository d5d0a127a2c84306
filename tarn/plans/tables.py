"""Queries over tables made from the input: each builds a table, changes it, and returns what it holds then; with SQL for the same state."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshot import relative
from ..sources.workspace import scratch
from ..table import QueryBuilder, Table, convert_to_table, write_table

CDF = {"delta.enableChangeDataFeed": "true"}
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def made(spark: SparkSession, df: DataFrame, **how) -> Table:
    return write_table(spark, scratch(spark, "table"), df, **how)


def orders(spark, sf) -> DataFrame:
    return raw(spark, sf, "orders")


@query("SELECT * FROM orders WHERE o_orderkey % 3 = 2")
def scan_append_overwrite(spark, sf):
    o = orders(spark, sf)
    t = made(spark, o.where("o_orderkey % 3 = 0"))
    write_table(spark, t, o.where("o_orderkey % 3 = 1"), mode="append")
    write_table(spark, t, o.where("o_orderkey % 3 = 2"), mode="overwrite")
    return t.to_df()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def time_travel_version(spark, sf):
    o = orders(spark, sf)
    t = made(spark, o.where("o_orderkey % 2 = 0"))
    write_table(spark, t, o.where("o_orderkey % 2 = 1"), mode="overwrite")
    return Table(spark, t.path, 0).to_df()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def time_travel_timestamp(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_custkey")
    t = made(spark, o.where("o_orderkey % 2 = 0"))
    write_table(spark, t, o.where("o_orderkey % 2 = 1"), mode="append")
    os.utime(t.store.absolute("_delta_log/00000000000000000000.json"), (1_600_000_000, 1_600_000_000))
    return Table(spark, t.path, "2020-10-01T00:00:00Z").to_df()


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def partitioned_write(spark, sf):
    return made(spark, orders(spark, sf).select("o_orderkey", "o_totalprice", "o_orderstatus"), partition_by="o_orderstatus").to_df()


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a b/c' WHEN 1 THEN '50%' WHEN 2 THEN NULL ELSE 'x=y' END AS k FROM nation""")
def partition_odd_values(spark, sf):
    k = F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'a b/c' WHEN 1 THEN '50%' WHEN 2 THEN NULL ELSE 'x=y' END")
    t = made(spark, raw(spark, sf, "nation").select("n_nationkey", k.alias("k")), partition_by="k")
    t.optimize().z_order(["n_nationkey"])
    return t.to_df()


@query("SELECT * REPLACE (o_totalprice * 2 AS o_totalprice) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def replace_where(spark, sf):
    o = orders(spark, sf)
    t = made(spark, o)
    write_table(spark, t, o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2), mode="overwrite", predicate="o_orderstatus = 'F'")
    return t.to_df()


@query("SELECT * FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0")
def replace_where_partition(spark, sf):
    o = orders(spark, sf)
    t = made(spark, o, partition_by="o_orderstatus")
    write_table(spark, t, o.where("o_orderstatus = 'O' AND o_orderkey % 2 = 0"), mode="overwrite", predicate="o_orderstatus = 'O'")
    return t.to_df()


@query("SELECT *, CAST(NULL AS VARCHAR) AS note FROM nation UNION ALL SELECT *, 'new' FROM nation WHERE n_regionkey = 1")
def schema_merge(spark, sf):
    n = raw(spark, sf, "nation")
    t = made(spark, n)
    write_table(spark, t, n.where("n_regionkey = 1").withColumn("note", F.lit("new")), mode="append", schema_mode="merge")
    return t.to_df()


@query("SELECT r_name AS name, r_regionkey * 10 AS k FROM region")
def schema_overwrite(spark, sf):
    t = made(spark, raw(spark, sf, "region"))
    write_table(spark, t, raw(spark, sf, "region").selectExpr("r_name AS name", "r_regionkey * 10 AS k"), mode="overwrite", schema_mode="overwrite")
    return t.to_df()


@query("SELECT * FROM lineitem WHERE (l_quantity > 25) IS NOT TRUE")
def delete_predicate(spark, sf):
    t = made(spark, raw(spark, sf, "lineitem"))
    t.delete("l_quantity > 25")
    return t.to_df()


@query("SELECT * FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice) FROM orders) WHERE (o_totalprice > 200000) IS NOT TRUE")
def delete_null_semantics(spark, sf):
    t = made(spark, orders(spark, sf).withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END")))
    t.delete("o_totalprice > 200000")
    return t.to_df()


@query("SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def delete_partitions(spark, sf):
    t = made(spark, raw(spark, sf, "customer"), partition_by="c_mktsegment")
    t.delete("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return t.to_df()


@query("SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'O' THEN upper(o_orderpriority) || '!' ELSE o_orderpriority END AS o_orderpriority) FROM orders")
def update_predicate(spark, sf):
    t = made(spark, orders(spark, sf))
    t.update({"o_totalprice": "o_totalprice + 100", "o_orderpriority": "upper(o_orderpriority) || '!'"}, predicate="o_orderstatus = 'O'")
    return t.to_df()


@query("SELECT * REPLACE (0 AS p_size) FROM part")
def update_all(spark, sf):
    t = made(spark, raw(spark, sf, "part"))
    t.update(new_values={"p_size": 0})
    return t.to_df()


def _source(spark, sf):
    c = raw(spark, sf, "customer")
    changed = c.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1000)
    return changed.unionByName(c.where("c_custkey % 5 = 1").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


_SOURCE_SQL = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1000 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 = 1)"
_COLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(f"SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_SOURCE_SQL}) UNION ALL SELECT * FROM {_SOURCE_SQL}")
def merge_upsert(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    t.merge(_source(spark, sf), "t.c_custkey = s.c_custkey", "s", "t").when_matched_update_all().when_not_matched_insert_all().execute()
    return t.to_df()


@query("SELECT * FROM customer WHERE c_custkey % 5 <> 0 OR c_acctbal <= 0")
def merge_delete(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    t.merge(_source(spark, sf), "t.c_custkey = s.c_custkey", "s", "t").when_matched_delete("t.c_acctbal > 0").execute()
    return t.to_df()


@query(f"SELECT * FROM customer UNION ALL SELECT c_custkey, c_name, NULL, c_acctbal, 'NEW' FROM {_SOURCE_SQL} WHERE c_custkey > 10000000 AND c_acctbal > 0")
def merge_insert_only(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    t.merge(_source(spark, sf), "t.c_custkey = s.c_custkey", "s", "t").when_not_matched_insert({"c_custkey": "s.c_custkey", "c_name": "s.c_name", "c_acctbal": "s.c_acctbal", "c_mktsegment": "'NEW'"}, "s.c_acctbal > 0").execute()
    return t.to_df()


@query("""SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN c_acctbal ELSE -1.0 END AS c_acctbal) FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 2 = 0""")
def merge_by_source(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    t.merge(_source(spark, sf), "t.c_custkey = s.c_custkey", "s", "t").when_not_matched_by_source_delete("t.c_custkey % 2 = 1").when_not_matched_by_source_update({"c_acctbal": "-1.0"}).execute()
    return t.to_df()


@query("""SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 AND c_acctbal < 0 THEN 'FIRST' WHEN c_custkey % 5 = 0 THEN 'SECOND' ELSE c_mktsegment END AS c_mktsegment) FROM customer""")
def merge_clause_order(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    m = t.merge(_source(spark, sf), "t.c_custkey = s.c_custkey", "s", "t").when_matched_update({"c_mktsegment": "'FIRST'"}, "t.c_acctbal < 0").when_matched_update({"c_mktsegment": "'SECOND'"})
    m.when_matched_delete().execute()
    return t.to_df()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'gold' END AS tier FROM customer")
def merge_schema_evolution(spark, sf):
    t = made(spark, raw(spark, sf, "customer"))
    s = _source(spark, sf).where("c_custkey < 10000000").withColumn("tier", F.lit("gold")).withColumn("unused", F.lit(1))
    t.merge(s, "t.c_custkey = s.c_custkey", "s", "t", merge_schema=True).when_matched_update({"tier": "s.tier"}).execute()
    return t.to_df()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT n_nationkey, 'small', n_regionkey FROM nation WHERE n_nationkey < 10")
def merge_theta(spark, sf):
    n = raw(spark, sf, "nation")
    t = made(spark, n)
    t.merge(spark.createDataFrame([(0, 10)], "lo int, hi int"), "t.n_nationkey >= s.lo AND t.n_nationkey < s.hi", "s", "t").when_matched_update({"n_name": "'small'"}).execute()
    return t.to_df()


@query("SELECT o_orderkey, o_totalprice, 'insert' AS _change_type, CAST(0 AS BIGINT) AS _commit_version FROM orders UNION ALL SELECT o_orderkey, o_totalprice, 'insert', 1 FROM orders WHERE o_orderkey % 4 = 0")
def cdf_insert(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_totalprice")
    t = made(spark, o, configuration=CDF)
    write_table(spark, t, o.where("o_orderkey % 4 = 0"), mode="append")
    return t.load_cdf().drop("_commit_timestamp")


@query("SELECT o_orderkey, o_totalprice, 'delete' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM orders WHERE o_totalprice > 250000")
def cdf_delete(spark, sf):
    t = made(spark, orders(spark, sf).select("o_orderkey", "o_totalprice"), configuration=CDF)
    t.delete("o_totalprice > 250000")
    return t.load_cdf(1).drop("_commit_timestamp")


@query("SELECT c_custkey, c_mktsegment, 'delete' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM customer WHERE c_mktsegment = 'BUILDING'")
def cdf_delete_partition(spark, sf):
    t = made(spark, raw(spark, sf, "customer").select("c_custkey", "c_mktsegment"), partition_by="c_mktsegment", configuration=CDF)
    t.delete("c_mktsegment = 'BUILDING'")
    return t.load_cdf(1).drop("_commit_timestamp")


@query("""SELECT p_partkey, p_size, 'update_preimage' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM part WHERE p_size < 20 AND p_size <> 5
UNION ALL SELECT p_partkey, 5, 'update_postimage', 1 FROM part WHERE p_size < 20 AND p_size <> 5""")
def cdf_update(spark, sf):
    t = made(spark, raw(spark, sf, "part").select("p_partkey", "p_size"), configuration=CDF)
    t.update({"p_size": "5"}, predicate="p_size < 20")
    return t.load_cdf(1).drop("_commit_timestamp")


@query(f"""SELECT c_custkey, c_acctbal, 'update_preimage' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, c_acctbal + 1000, 'update_postimage', 1 FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, c_acctbal, 'insert', 1 FROM {_SOURCE_SQL} WHERE c_custkey > 10000000
UNION ALL SELECT c_custkey, c_acctbal, 'delete', 1 FROM customer WHERE c_custkey % 5 = 3""")
def cdf_merge(spark, sf):
    t = made(spark, raw(spark, sf, "customer").select("c_custkey", "c_acctbal"), configuration=CDF)
    t.merge(_source(spark, sf).select("c_custkey", "c_acctbal"), "t.c_custkey = s.c_custkey", "s", "t").when_matched_update_all().when_not_matched_insert_all().when_not_matched_by_source_delete("t.c_custkey % 5 = 3").execute()
    return t.load_cdf(1).drop("_commit_timestamp")


@query("SELECT p_partkey, 'update_postimage' AS kind FROM part WHERE p_size < 20 AND p_size <> 5 AND p_partkey > 50")
def cdf_projection(spark, sf):
    t = made(spark, raw(spark, sf, "part").select("p_partkey", "p_size"), configuration=CDF)
    t.update({"p_size": "5"}, predicate="p_size < 20")
    return t.load_cdf(1, columns=["p_partkey", "_change_type"], predicate="_change_type = 'update_postimage' AND p_partkey > 50").withColumnRenamed("_change_type", "kind")


@query("SELECT event_id, user_id, value, event_type FROM events")
def optimize_compact(spark, sf):
    e = raw(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    t = made(spark, e.where("event_id % 4 = 0"), partition_by="event_type")
    for k in (1, 2, 3):
        write_table(spark, t, e.where(f"event_id % 4 = {k}"), mode="append")
    before = len(t.file_uris())
    t.optimize().compact()
    assert len(t.file_uris()) < before
    return t.to_df()


@query("SELECT * FROM lineitem")
def optimize_zorder(spark, sf):
    """All rows after the rewrite, which lets a range open fewer files."""
    t = made(spark, raw(spark, sf, "lineitem"))
    t.optimize().z_order(["l_partkey", "l_suppkey"], target_size=200_000)
    assert len(t.files_scanned("l_partkey BETWEEN 1 AND 10")) < len(t.file_uris())
    return t.to_df()


@query("SELECT * FROM customer")
def optimize_zorder_strings(spark, sf):
    """The same by strings that begin alike."""
    t = made(spark, raw(spark, sf, "customer").repartition(4))
    t.optimize().z_order(["c_name"], target_size=10_000)
    least = raw(spark, sf, "customer").agg(F.min("c_name")).first()[0]
    assert 1 <= len(t.files_scanned(f"c_name = '{least}'")) < len(t.file_uris())
    return t.to_df()


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def vacuum_full(spark, sf):
    """Once its tombstone is older than no retention at all, exactly the removed file goes; a file that the log doesn't know goes too."""
    t = made(spark, raw(spark, sf, "nation"))
    gone = {relative(a) for a in t.snapshot.adds}
    t.delete("n_regionkey = 2")
    t.store.write("stray.parquet", b"x")
    later = max([f.modified for f in t.store.list("", recursive=True)] + [r["deletionTimestamp"] for r in t.snapshot.tombstones.values()]) + 1
    assert set(t.vacuum(0, dry_run=False, enforce_retention_duration=False, full=True, now=later)) == {*gone, "stray.parquet"}
    return t.to_df()


@query("SELECT * FROM nation")
def restore_version(spark, sf):
    t = made(spark, raw(spark, sf, "nation"))
    t.delete("n_regionkey = 2")
    t.update({"n_name": "'x'"})
    t.restore(0)
    return t.to_df()


@query("SELECT * FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT * FROM nation WHERE n_regionkey = 0")
def checkpoint_roundtrip(spark, sf):
    n = raw(spark, sf, "nation")
    t = made(spark, n, partition_by="n_regionkey")
    t.delete("n_regionkey = 4")
    t.create_checkpoint()
    write_table(spark, t, n.where("n_regionkey = 0"), mode="append")
    for v in (0, 1):
        t.store.delete(f"_delta_log/{v:020}.json")
    return Table(spark, t.path).to_df()


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey IN (0, 1, 2)")
def log_compaction(spark, sf):
    n = raw(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    t = made(spark, n.where("n_regionkey = 0"))
    for k in (1, 2, 3):
        write_table(spark, t, n.where(f"n_regionkey = {k}"), mode="append")
    t.delete("n_regionkey = 3")
    t.compact_logs(0, 4)
    t.store.delete("_delta_log/00000000000000000002.json")
    return Table(spark, t.path).to_df()


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders")
def generated_column(spark, sf):
    o = orders(spark, sf).select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    schema = T.StructType([*o.schema.fields, T.StructField("m", T.DateType(), True, {"delta.generationExpression": "trunc(d, 'MONTH')"})])
    t = Table.create(spark, scratch(spark, "table"), schema)
    write_table(spark, t, o, mode="append")
    return t.to_df()


@query("SELECT * FROM part WHERE p_size > 10")
def check_constraint(spark, sf):
    from ..table import TableError

    p = raw(spark, sf, "part")
    t = made(spark, p.where("p_size > 10"))
    t.alter().add_constraint({"big": "p_size > 10"})
    try:
        write_table(spark, t, p.where("p_size <= 10"), mode="append")
    except TableError:
        return t.to_df()
    raise AssertionError("the constraint didn't hold")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 10 OR c_mktsegment = 'MACHINERY'")
def partition_filters_dnf(spark, sf):
    t = made(spark, raw(spark, sf, "customer"), partition_by="c_mktsegment")
    return t.to_df(filters=[[("c_mktsegment", "=", "BUILDING"), ("c_nationkey", ">=", 10)], [("c_mktsegment", "=", "MACHINERY")]], columns=["c_custkey", "c_mktsegment"])


@query("SELECT count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS top FROM orders WHERE o_orderkey BETWEEN 200 AND 300")
def file_skipping(spark, sf):
    o = orders(spark, sf)
    t = made(spark, o.repartitionByRange(8, "o_orderkey"))
    assert len(t.files_scanned("o_orderkey BETWEEN 200 AND 300")) < len(t.file_uris())
    return t.to_df(predicate="o_orderkey BETWEEN 200 AND 300").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


@query("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_orderstatus")
def add_actions_stats(spark, sf):
    t = made(spark, orders(spark, sf), partition_by="o_orderstatus")
    a = t.get_add_actions(flatten=True)
    return a.groupBy(F.col("`partition.o_orderstatus`").alias("status")).agg(F.sum("num_records").alias("n"), F.min("`min.o_orderkey`").alias("lo"), F.max("`max.o_orderkey`").alias("hi"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def count_metadata(spark, sf):
    return spark.createDataFrame([(made(spark, raw(spark, sf, "lineitem")).count(),)], "n long")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'WRITE'), (1, 'DELETE'), (2, 'UPDATE'), (3, 'OPTIMIZE'), (4, 'RESTORE')) AS t(version, operation)")
def history_ops(spark, sf):
    t = made(spark, raw(spark, sf, "nation"))
    t.delete("n_nationkey = 3")
    t.update({"n_name": "'x'"}, predicate="n_nationkey = 4")
    t.optimize().z_order(["n_nationkey"])
    t.restore(0)
    return spark.createDataFrame([(h["version"], h["operation"]) for h in t.history()], "version long, operation string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def convert_parquet(spark, sf):
    path = scratch(spark, "plain")
    raw(spark, sf, "nation").write.partitionBy("n_regionkey").parquet(path)
    return convert_to_table(spark, path, partition_by=T.StructType([T.StructField("n_regionkey", T.IntegerType())])).to_df().select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 0")
def repair_missing(spark, sf):
    t = made(spark, raw(spark, sf, "nation").select("n_nationkey", "n_regionkey"), partition_by="n_regionkey")
    for f in t.file_uris([("n_regionkey", "=", "0")]):
        t.store.delete(f)
    t.repair()
    return t.to_df()


@query("SELECT CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS manifests FROM orders")
def generate_manifest(spark, sf):
    t = made(spark, orders(spark, sf), partition_by="o_orderstatus")
    return spark.createDataFrame([(len(t.generate()),)], "manifests long")


@query("SELECT * FROM nation WHERE n_nationkey % 5 <> 0")
def deletion_vectors_read(spark, sf):
    """A table whose file has a deletion vector, as other writers make them."""
    from ..operators.commit import remove_of
    from ..sources.deletion_vectors import inline

    t = made(spark, raw(spark, sf, "nation").coalesce(1), configuration={"delta.enableDeletionVectors": "true"})
    old = t.snapshot.adds[0]
    rows = [r["i"] for r in t.to_df(row_column="i").where("n_nationkey % 5 = 0").select("i").collect()]
    t.commit([remove_of(old), {"add": {**old, "deletionVector": inline(rows), "dataChange": True}}], "DELETE", {})
    assert t.count() == t.to_df().count()
    return t.to_df()


@query("SELECT n_nationkey AS id, n_name AS label FROM nation")
def column_mapping_read(spark, sf):
    """A table whose files have other column names than its schema, as other writers make them."""
    from ..sources.snapshot import Metadata, Protocol

    t = made(spark, raw(spark, sf, "nation").selectExpr("n_nationkey AS c1", "n_name AS c2"))
    schema = T.StructType([T.StructField(n, f.dataType, True, {"delta.columnMapping.id": i, "delta.columnMapping.physicalName": f.name}) for i, (n, f) in enumerate(zip(("id", "label"), t.schema(), strict=True))])
    meta = Metadata(**{**t.snapshot.metadata.__dict__, "schema": schema, "configuration": {"delta.columnMapping.mode": "name"}})
    t.commit([Protocol(2, 5).action(), meta.action()], "SET TBLPROPERTIES", {})
    return Table(spark, t.path).to_df()


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 1")
def streaming_sink(spark, sf):
    """Two batches of a stream, one of them twice."""
    from ..streaming.sink import append_batches

    e = raw(spark, sf, "events").select("event_id", "event_type", "value")
    path = scratch(spark, "table")
    write = append_batches(spark, path, "q1")
    for n, k in ((0, 0), (1, 1), (1, 1)):
        write(e.where(f"event_id % 2 = {k}"), n)
    return Table(spark, path).to_df()


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def sql_insert_into(spark, sf):
    t = made(spark, raw(spark, sf, "nation"))
    q = QueryBuilder(spark).register("tarn_nation", t)
    q.insert(t, "SELECT n_nationkey + 100, n_name, n_regionkey FROM tarn_nation WHERE n_regionkey = 3")
    return t.to_df()


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM nation, region WHERE n_regionkey = r_regionkey")
def catalog_folder(spark, sf):
    top = scratch(spark, "catalog")
    for n in ("nation", "region"):
        write_table(spark, f"{top}/{n}", raw(spark, sf, n))
    q = QueryBuilder(spark)
    assert q.register_folder(top) == ["nation", "region"]
    return q.execute("SELECT count(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Write, merge, and query through SQL."""
    o = orders(spark, sf)
    t = made(spark, o, partition_by="o_orderstatus")
    s = o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    t.merge(s, "t.o_orderkey = s.o_orderkey", "s", "t").when_matched_update_all().when_not_matched_insert_all().execute()
    return QueryBuilder(spark).register("orders_table", t).execute("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_table GROUP BY o_orderstatus")


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END), 2) AS total FROM orders GROUP BY o_orderstatus"

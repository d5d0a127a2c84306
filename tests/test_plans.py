"""Queries over inputs that their tables don't have."""

from __future__ import annotations

import re
from bisect import bisect_right

import pytest

from tarn.operators import maintenance
from tarn.plans import operations, relational
from tarn.table import Table, write_table


@pytest.mark.parametrize("rows", ["o_orderkey >= 500", "o_orderstatus <> 'F'", "o_orderstatus = 'F'", "false"])
def test_arrow_dataset_of_any_orders(spark, tmp_path, rows):
    """No file, or every file, may hold what is asked for."""
    every = spark.range(400, 700).selectExpr("id AS o_orderkey", "element_at(array('F', 'O', 'P'), CAST(1 + id % 3 AS INT)) AS o_orderstatus").where(rows)
    every.write.parquet(f"{tmp_path}/orders.parquet")
    got = operations.QUERIES["arrow_dataset"](spark, str(tmp_path))
    assert got.columns == every.columns and sorted(got.collect()) == sorted(every.where("o_orderkey < 500 AND o_orderstatus = 'F'").collect())


def test_stream_batches_are_many_tasks(spark, tmp_path, monkeypatch):
    """A task's files don't grow with the batch."""
    spark.range(0, 20_000, 1, 1).selectExpr("id AS event_id", "hash(id) AS value").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(operations, "scratch", lambda *_: f"{tmp_path}/t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "10k")
    try:
        assert operations.QUERIES["stream_commits"](spark, str(tmp_path)).collect() == [(20_000, True, "STREAMING UPDATE")]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    by_write: dict = {}
    for f in Table(spark, f"{tmp_path}/t").file_uris():
        folder, name = f.rsplit("/", 2)[1:]
        by_write.setdefault(folder, set()).add(name.split("-")[1])
    assert len(by_write) == 2 and all(len(tasks) > 1 for tasks in by_write.values())


def test_inputs_are_written_without_a_shuffle(spark, tmp_path):
    """Tables with few partition values: each task writes its own rows, in a file of each value."""
    rows = spark.range(0, 400, 1, 4).selectExpr("id AS o_orderkey", "element_at(array('F', 'O', 'P'), CAST(1 + id % 3 AS INT)) AS o_orderstatus")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    t = relational._table(spark, str(tmp_path), "orders")
    assert len(t.file_uris()) == 12 and sorted(t.to_df().collect()) == sorted(rows.collect())


def test_few_partitions_that_are_many(spark, tmp_path):
    """More values than a task has files open for, nulls among them."""
    rows = spark.range(0, 500, 1, 2).selectExpr("id", "nullif(id % 50, 7) AS k")
    t = write_table(spark, f"{tmp_path}/t", rows, partition_by="k", few_partitions=True)
    assert len(t.partitions()) == 50 and sorted(t.to_df().collect(), key=str) == sorted(rows.collect(), key=str)


def test_partition_values_move_no_rows(spark, tmp_path):
    """The join that gives rows their partition values is by broadcast."""
    t = write_table(spark, f"{tmp_path}/t", spark.range(100).selectExpr("id", "id % 3 AS k"), partition_by="k")
    plan = t.to_df()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("n", [2, 6])
def test_zorder_key_without_lambdas(spark, n):
    """The key orders rows as the interleaved range numbers do; Spark compiles it, of up to five columns as a number."""
    values = [[None if (x * (7 + c)) % 11 == 0 else (x * (31 + c)) % 97 for c in range(n)] for x in range(200)]
    df = spark.createDataFrame([(x, *v) for x, v in enumerate(values)], "x int, " + ", ".join(f"c{c} int" for c in range(n)))
    keyed = maintenance.with_zorder_key(df, [f"c{c}" for c in range(n)], 200, "z")
    ranks = []
    for c in range(n):
        known = sorted(v[c] for v in values if v[c] is not None)
        limits = sorted({known[k * len(known) // 1024] for k in range(1, 1024) if known})
        ranks.append([0 if v[c] is None else 1 + bisect_right(limits, v[c]) for v in values])
    want = {x: "".join(f"{ranks[c][x]:011b}"[b] for b in range(11) for c in range(n)) for x in range(200)}
    assert {r["x"]: r["z"] if n > 5 else f"{r['z']:022b}" for r in keyed.collect()} == want
    assert "lambda" not in keyed._jdf.queryExecution().optimizedPlan().toString()


def test_window_rank_in_slices(spark, tmp_path):
    """Ranks over ties, nulls and a status of its own null are what the SQL gives, and no task sorts a whole status."""
    rows = spark.range(0, 3000, 1, 2).selectExpr("id % 2900 AS o_orderkey", "nullif(element_at(array('F', 'O', 'P'), CAST(1 + id % 3 AS INT)), 'P') AS o_orderstatus", "concat('p', nullif(id % 5, 3)) AS o_orderpriority", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 10D ELSE CAST(hash(id) % 500 AS DOUBLE) END AS o_totalprice")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    got = relational.QUERIES["window_rank"](spark, str(tmp_path))
    rows.createOrReplaceTempView("ranked_orders")
    want = spark.sql(relational.TEXTS["window_rank"].replace("FROM orders", "FROM ranked_orders"))
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(got.collect()) == sorted(want.collect())
    keys = re.findall(r"windowspecdefinition\(([^\n]*?)#\d+L?, ([^\n]*?)#", got._jdf.queryExecution().optimizedPlan().toString())
    assert ("o_orderstatus", "slice") in keys

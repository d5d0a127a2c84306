"""Relational queries over registered tables of this engine: SQL that Spark and the oracle both run.

The input is written as tables once a session and folder, large ones partitioned or in several files, so that queries go
through the log, partition values and skipping.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.maintenance import with_ranks
from ..sources.workspace import scratch
from ..table import QueryBuilder, Table, write_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: name -> SQL for both; or (Spark's, the oracle's)
TEXTS: dict[str, str | tuple[str, str]] = {
    "join_inner": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_comma": "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey AND r_name LIKE 'A%'",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_right": "SELECT o_orderkey, c_name FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c RIGHT JOIN orders ON c_custkey = o_custkey",
    "join_full": "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k",
    "join_full_theta": "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 6) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey BETWEEN 3 AND 8) b ON a.k < b.k AND a.k > 3",
    "join_cross": "SELECT r_name, s_suppkey FROM region CROSS JOIN supplier",
    "join_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_semi_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_range": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey + 1 AND a.n_nationkey + 3",
    "join_self_lag": "WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, count(*) AS n, rank() OVER (ORDER BY year(o_orderdate), month(o_orderdate)) AS rn FROM orders GROUP BY 1, 2) SELECT a.y AS y, a.mo AS mo, a.n AS n, b.n AS before FROM m a JOIN m b ON a.rn = b.rn + 1",
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS q, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag",
    "agg_stddev": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + grouping(o_orderpriority) AS lvl, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_conditional": "SELECT o_custkey % 10 AS k, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1",
    "agg_median_corr": "SELECT l_returnflag, median(l_quantity) AS m, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d FROM orders",
    "window_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS t FROM orders",
    "window_sum_sum": "SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS s, round(sum(sum(c_acctbal)) OVER (PARTITION BY c_mktsegment), 2) AS t FROM customer GROUP BY c_mktsegment, c_nationkey",
    "window_avg_sum": "SELECT o_orderstatus, o_orderpriority, round(avg(sum(o_totalprice)) OVER (PARTITION BY o_orderstatus), 2) AS a FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "window_running": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run FROM orders",
    "window_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "window_range_frame": "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (ORDER BY n_nationkey RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM nation",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    "setop_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 2 FROM region",
    "setop_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "setop_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "setop_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "cte_nested": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey WHERE n > 3",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)",
    "subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "filter_null_logic": "SELECT k, x IS NULL AS n, x IS DISTINCT FROM 1 AS d, NOT (x > 2) AS t, x IN (1, NULL) AS i FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS x FROM nation) q",
    "filter_is_true": "SELECT k FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS x FROM nation) q WHERE (x > 10) IS NOT TRUE",
    "filter_like": "SELECT p_partkey, p_type ILIKE '%brass%' AS b, p_type LIKE 'STANDARD%' AS s, p_type NOT LIKE '%TIN' AS t FROM part",
    "filter_between_case": "SELECT l_orderkey, l_linenumber, l_quantity, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS c FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48",
    "func_string": "SELECT p_partkey, substr(p_name, 2, 5) AS s, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, p_brand || '/' || p_type AS c, trim('  x ') AS t, replace(p_type, 'A', 'b') AS r FROM part",
    "func_math": "SELECT p_partkey, round(p_retailprice * 1.1, 1) AS r, abs(p_size - 25) AS a, p_size % 7 AS m, -p_size AS neg, CAST(floor(p_retailprice) AS BIGINT) AS f, power(p_size, 2) AS p FROM part",
    "func_date": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(o_orderdate + INTERVAL 10 DAYS AS DATE) AS i FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS i FROM orders"),
    "func_conditional": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), -1) AS c, CASE WHEN n_nationkey > 12 THEN 'hi' ELSE 'lo' END AS b FROM nation",
    "func_cast": ("SELECT n_nationkey, CAST(n_nationkey AS STRING) AS s, try_cast(n_name AS INT) AS t, CAST(n_nationkey AS DOUBLE) / 4 AS d FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS s, try_cast(n_name AS INT) AS t, CAST(n_nationkey AS DOUBLE) / 4 AS d FROM nation"),
    "func_array": ("SELECT n_nationkey, element_at(array(n_regionkey, n_nationkey), 2) AS e, size(array(1, 2, n_nationkey)) AS s, array_contains(array(1, 2, 3), n_nationkey) AS c FROM nation", "SELECT n_nationkey, [n_regionkey, n_nationkey][2] AS e, CAST(len([1, 2, n_nationkey]) AS INT) AS s, list_contains([1, 2, 3], n_nationkey) AS c FROM nation"),
    "func_struct": ("SELECT s.a AS a, s.b AS b FROM (SELECT named_struct('a', n_nationkey, 'b', n_name) AS s FROM nation) q", "SELECT s.a AS a, s.b AS b FROM (SELECT {'a': n_nationkey, 'b': n_name} AS s FROM nation) q"),
    "func_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "func_map": ("SELECT n_nationkey, element_at(m, 'a') AS a, size(m) AS n, map_contains_key(m, 'c') AS c FROM (SELECT n_nationkey, map('a', n_regionkey, 'b', n_nationkey) AS m FROM nation) q", "SELECT n_nationkey, m['a'] AS a, CAST(cardinality(m) AS INT) AS n, map_contains(m, 'c') AS c FROM (SELECT n_nationkey, MAP {'a': n_regionkey, 'b': n_nationkey} AS m FROM nation) q"),
    "func_binary": ("SELECT n_nationkey, hex(CAST(n_name AS BINARY)) AS h, octet_length(CAST(n_name AS BINARY)) AS n, sha2(n_name, 256) AS s, lower(hex(unhex('0AFF'))) AS u FROM nation", "SELECT n_nationkey, hex(n_name) AS h, octet_length(n_name::BLOB) AS n, sha256(n_name) AS s, lower(hex(unhex('0AFF'))) AS u FROM nation"),
    "func_variant": ("SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k, schema_of_variant(parse_json(props)) IS NOT NULL AS s FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, props IS NOT NULL AS s FROM events"),
    "func_to_json": ("SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'r', n_regionkey)) AS j FROM nation", "SELECT n_nationkey, CAST(to_json({'k': n_nationkey, 'r': n_regionkey}) AS VARCHAR) AS j FROM nation"),
    "agg_min_max": "SELECT min(o_orderkey) AS a, max(o_orderkey) AS b, min(o_orderpriority) AS c, max(o_orderstatus) AS d FROM orders",
    "join_two_steps": "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' GROUP BY r_name",
    "filter_similar": ("SELECT p_partkey FROM part WHERE p_type RLIKE '^(?:STANDARD|SMALL).*$'", "SELECT p_partkey FROM part WHERE p_type SIMILAR TO '(STANDARD|SMALL).*'"),
    "func_explode": ("SELECT n_nationkey, x FROM nation LATERAL VIEW explode(sequence(1, 1 + n_nationkey % 3)) t AS x", "SELECT n_nationkey, CAST(unnest(generate_series(1, 1 + n_nationkey % 3)) AS INT) AS x FROM nation"),
}


#: Partition columns of the tables that queries run over; each has three to five values.
PARTITIONED = {"orders": "o_orderstatus", "customer": "c_mktsegment", "lineitem": "l_returnflag", "events": "event_type"}
_tables: dict[tuple, Table] = {}


def _table(spark, sf: str, name: str) -> Table:
    """The input as a table of this engine: written once for each session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _tables:
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        _tables[key] = write_table(spark, scratch(spark, name), rows, partition_by=PARTITIONED.get(name), few_partitions=True)
    return _tables[key]


def _run(text: str):
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark, sf):
        q = QueryBuilder(spark)
        for t in used:
            q.register(t, _table(spark, sf, t))
        return q.execute(text)

    return run


#: Slices that a value's range is cut into, so that one task needn't sort all rows of a status.
SLICES = 64


def window_rank(spark, sf):
    """The text's result where a status has more rows than a task should sort: ranks within slices of the price, and the rows of
    the slices before; dense ranks of the few priorities, joined to the rows. Equal prices are in one slice, so ranks are exact."""
    rows = _table(spark, sf, "orders").to_df().select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    cuts = rows.agg(F.percentile_approx("o_totalprice", [k / SLICES for k in range(1, SLICES)], 1000)).first()[0] or []
    # slice 0 is of null prices, which come last
    rows = with_ranks(rows, ["o_totalprice"], [[F.lit(x) for x in sorted(set(cuts))]]).withColumnRenamed("__tarn_at0", "slice")
    rows = rows.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "slice")
    sizes = rows.groupBy("o_orderstatus", "slice").count()
    above = Window.partitionBy("o_orderstatus").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("o_orderstatus").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("count").over(above), F.lit(0)).alias("above"))
    dense = rows.select(F.col("o_orderstatus").alias("ds"), F.col("o_orderpriority").alias("dp")).distinct()
    dense = dense.withColumn("d", F.dense_rank().over(Window.partitionBy("ds").orderBy("dp")))
    within = F.rank().over(Window.partitionBy("o_orderstatus", "slice").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    out = rows.withColumn("r", within).join(F.broadcast(sizes), F.col("o_orderstatus").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    out = out.join(dense, F.col("o_orderstatus").eqNullSafe(F.col("ds")) & F.col("o_orderpriority").eqNullSafe(F.col("dp")))
    return out.select("o_orderkey", (F.col("r") + F.col("above")).cast("int").alias("r"), "d")


QUERIES = {n: _run(t if isinstance(t, str) else t[0]) for n, t in TEXTS.items()} | {"window_rank": window_rank}
SQL = {n: t if isinstance(t, str) else t[1] for n, t in TEXTS.items()}

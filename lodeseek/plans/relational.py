"""Relational queries over the tables: the SQL that callers of the engine run on Spark, with DuckDB's form where it differs."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query function for SQL text; only the tables that it names are opened."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", sql):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


#: name: SQL for Spark, and SQL for DuckDB if another.
SQL: dict[str, tuple[str, str | None]] = {
    "rel_pricing_summary": (
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""", None),
    "rel_inner_join": (
        """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", None),
    "rel_left_join_having": (
        """SELECT c_mktsegment, count(o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY 1 HAVING count(*) > 10""", None),
    "rel_left_anti": ("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "rel_left_join_is_null": ("SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE l_partkey IS NULL", None),
    "rel_left_semi": ("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)", None),
    "rel_role_playing": (
        """SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
GROUP BY a.n_name, b.n_name""", None),
    "rel_join_on_false": ("SELECT r_name, n_name FROM region LEFT JOIN nation ON 1 = 0", None),
    "rel_full_outer": (
        """SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""", None),
    "rel_range_join": (
        """SELECT b.lo AS low, count(*) AS n FROM orders JOIN (SELECT 0 AS lo, 100000 AS hi UNION ALL SELECT 100000, 250000 UNION ALL SELECT 250000, 1000000000) b
ON o_totalprice >= b.lo AND o_totalprice < b.hi GROUP BY b.lo""", None),
    "rel_asof_join": (
        """SELECT e.event_id, max_by(p.event_id, struct(p.ts, p.event_id)) AS last_view FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts <= e.ts
AND p.event_type = 'view' WHERE e.event_type = 'purchase' GROUP BY e.event_id""",
        """SELECT event_id, last_view FROM (SELECT e.event_id, p.event_id AS last_view, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS k
FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts <= e.ts AND p.event_type = 'view' WHERE e.event_type = 'purchase') WHERE k = 1"""),
    "rel_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "rel_grouping_sets": (
        """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g, count(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""", None),
    "rel_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "rel_rollup": (
        "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", None),
    "rel_rank": (
        """SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place,
CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS quarter FROM customer) WHERE place <= 3""",
        """SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place,
CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS quarter FROM customer) WHERE place <= 3"""),
    "rel_validity_ranges": (
        """SELECT event_id, user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type = 'purchase'""", None),
    "rel_lag_delta": (
        """SELECT month, total, round(total - lag(total) OVER (ORDER BY month), 2) AS delta FROM (SELECT substr(CAST(o_orderdate AS STRING), 1, 7) AS month,
round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)""", None),
    "rel_frames": (
        """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three
FROM orders""", None),
    "rel_top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "rel_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "rel_intersect": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier", None),
    "rel_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000", None),
    "rel_union_all": ("SELECT 'c' AS kind, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier", None),
    "rel_scalar_subquery": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "rel_cte": (
        """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), few AS (SELECT * FROM spent WHERE total > 500000)
SELECT c_mktsegment, count(*) AS n FROM few JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""", None),
    "rel_recursive_cte": (
        "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", None),
    "rel_dates": (
        """SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, CAST(max(datediff(TIMESTAMP '1998-12-31', o_orderdate)) AS BIGINT) AS oldest
FROM orders GROUP BY 1, 2""",
        """SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, count(*) AS n,
CAST(max(datediff('day', o_orderdate, TIMESTAMP '1998-12-31')) AS BIGINT) AS oldest FROM orders GROUP BY 1, 2"""),
    "rel_strings": (
        """SELECT upper(substr(p_name, 1, 5)) AS head, length(p_type) AS n, replace(p_brand, '#', '-') AS brand, count(*) AS parts FROM part WHERE p_type LIKE '%E%' GROUP BY 1, 2, 3""",
        """SELECT upper(substr(p_name, 1, 5)) AS head, CAST(length(p_type) AS INT) AS n, replace(p_brand, '#', '-') AS brand, count(*) AS parts FROM part
WHERE p_type LIKE '%E%' GROUP BY 1, 2, 3"""),
    "rel_json": (
        "SELECT event_id, get_json_object(props, '$.k') AS k, props IS NULL AS no_props FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL AS no_props FROM events"),
    "rel_case_pivot": (
        """SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o
FROM orders GROUP BY o_orderpriority""",
        """SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o
FROM orders GROUP BY o_orderpriority"""),
    "rel_tumbling_window": (
        "SELECT w.start AS start, event_type, count(*) AS n FROM (SELECT window(ts, '1 hour') AS w, event_type FROM events) GROUP BY w, event_type",
        "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "rel_sessions": (
        """SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh
FROM events) GROUP BY user_id""", None),
}
QUERIES = {name: run_sql(spark_sql) for name, (spark_sql, _) in SQL.items()}
ORACLES = {name: duck or spark_sql for name, (spark_sql, duck) in SQL.items()}

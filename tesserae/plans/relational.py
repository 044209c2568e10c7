"""User SQL over the relational tables: the surface that ad-hoc table questions use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.sqlfront import referenced, run_sql
from tesserae.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_star_join_agg": """SELECT n.n_name, r.r_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE o.o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY n.n_name, r.r_name""",
    "sql_left_join_null_side": """SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total
  FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""",
    "sql_full_outer_keys": """SELECT coalesce(s.s_nationkey, c.c_nationkey) AS nationkey, s.n_s, c.n_c
  FROM (SELECT s_nationkey, count(*) AS n_s FROM supplier WHERE s_acctbal > 9000 GROUP BY s_nationkey) s
  FULL OUTER JOIN (SELECT c_nationkey, count(*) AS n_c FROM customer WHERE c_acctbal < -900 GROUP BY c_nationkey) c ON s.s_nationkey = c.c_nationkey""",
    "sql_semi_join": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY c_mktsegment",
    "sql_anti_join": "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY c_mktsegment",
    "sql_correlated_exists": """SELECT p.p_brand, count(*) AS n FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49) GROUP BY p.p_brand""",
    "sql_theta_pairs": """SELECT a.s_suppkey AS supp_a, b.s_suppkey AS supp_b FROM supplier a JOIN supplier b
  ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500""",
    "sql_total_share": """SELECT o_orderpriority, count(*) AS n, round(count(*) * 1.0E0 / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY o_orderpriority""",
    "sql_grouping_sets": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
  GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_having_distinct": """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 5""",
    "sql_filtered_aggregates": """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) AS n, min(o_orderdate) AS first_date FROM orders GROUP BY o_orderstatus""",
    "sql_window_rank_frame": """SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running,
  lag(o_orderkey) OVER w AS previous_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "sql_window_ntile_dense": """SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quarter, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place FROM supplier""",
    "sql_union_all_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9500",
    "sql_cte_chain": """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
  top AS (SELECT o_custkey FROM big WHERE total > (SELECT avg(total) FROM big)) SELECT c_mktsegment, count(*) AS n FROM customer JOIN top ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    "sql_numeric_cast": """SELECT CAST(CAST(round(sum(CAST("p_retailprice" AS NUMERIC)), 2) AS VARCHAR(30)) AS DOUBLE) AS total, count(*) AS n FROM part WHERE "p_size" BETWEEN 10 AND 20""",
    "sql_case_buckets": """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY 1""",
    "sql_top_per_group": """SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 5""",
    "minisql_filter_between_in": "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 15 AND l_returnflag IN ('A', 'R') AND l_discount > 0.02",
    "ilike_name_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_brand ILIKE '%1%'",
    "pagination_scroll": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100",
}


def _query(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, text, {n: table(spark, sf_dir, n) for n in referenced(text, list(TABLES))})

    return query


QUERIES = {name: _query(text) for name, text in SQL.items()}

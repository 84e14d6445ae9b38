"""Guarded SQL over the star schema: the same text runs here and in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmill.operators.guarded_sql import MOST_ROWS, guarded_sql
from siftmill.sources.tables import register_views

STATEMENTS = {
    "sql_gate_join_inner": """SELECT r.r_name, n.n_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name""",
    "sql_gate_join_left": """SELECT n.n_name, count(s.s_suppkey) AS suppliers FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name""",
    "sql_gate_join_full": """SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers
FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY s_nationkey) a
FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey >= 10 GROUP BY c_nationkey) b ON a.k = b.k""",
    "sql_gate_semi_anti": """SELECT 'with' AS kind, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL SELECT 'without' AS kind, count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
    "sql_gate_window": """SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) t WHERE place <= 3""",
    "sql_gate_set_ops": """(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier) EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0""",
    "sql_gate_grouping_sets": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "sql_gate_subquery": """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderpriority""",
    "sql_gate_dates": """SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY year(o_orderdate), month(o_orderdate)""",
}


def _query(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir)
        return guarded_sql(spark, statement, MOST_ROWS)

    return run


QUERIES = {name: _query(own) for name, own in STATEMENTS.items()}
QUERIES["sql_gate_set_ops"] = _query(f"SELECT * FROM ({STATEMENTS['sql_gate_set_ops']})")
ORACLES = dict(STATEMENTS)

"""Plain SQL passed through: statements users may write that need no operator of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.operators.queries import bound
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query


def _passed_through(name: str, sql: str, tables: tuple[str, ...], twin: str | None = None) -> None:
    """Register one statement that both engines read, ``twin`` where dialects differ."""

    @query(name, twin or sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bound(spark, sql, tables={t: fx.table(spark, sf_dir, t) for t in tables})


_passed_through(
    "sql_semi_anti",
    """SELECT c_custkey, 'buyer' AS kind FROM customer c WHERE EXISTS
      (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
    UNION ALL SELECT c_custkey, 'silent' FROM customer c WHERE NOT EXISTS
      (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)""",
    ("customer", "orders", "events"),
)
_passed_through(
    "sql_range_join",
    """SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
      AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL '90' DAY
    GROUP BY o.o_orderkey""",
    ("orders", "lineitem"),
)
_passed_through(
    "sql_rollup",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    ("orders",),
)
# A rank filter lets Spark drop rows beyond it before the shuffle, however large the group.
_passed_through(
    "sql_rank",
    """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER
      (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) ranked
    WHERE place <= 3""",
    ("orders",),
)
# Frames run over months, whose number does not grow with the rows.
_passed_through(
    "sql_frame",
    """SELECT o_orderpriority, month, revenue, CAST(sum(revenue) OVER (PARTITION BY o_orderpriority
        ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(28,2)) AS quarter
    FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue
      FROM orders GROUP BY 1, 2) monthly""",
    ("orders",),
)
_passed_through(
    "sql_set_ops",
    """(SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events)
    UNION ALL (SELECT s_suppkey FROM supplier INTERSECT SELECT user_id FROM events)""",
    ("orders", "events", "supplier"),
)
_passed_through(
    "sql_cte",
    """WITH spent AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
        FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CAST(total AS DOUBLE) AS total FROM spent
    WHERE total > (SELECT CAST(sum(total) AS DOUBLE) / count(*) FROM spent)""",
    ("orders",),
)

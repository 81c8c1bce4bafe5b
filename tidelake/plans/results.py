"""Result shaping over joins of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import queries, results as ops
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query
from tidelake.specs import ResponseSpec

_ORDER = ResponseSpec(
    "OrderRow",
    {
        "orderKey": "ID!",
        "totalPrice": "Float!",
        "placedAt": "AWSDateTime!",
        "note": "String",
    },
)


@query(
    "shape_result",
    """select cast(o_orderkey as varchar) as "orderKey", o_totalprice as "totalPrice",
      o_orderdate as "placedAt", cast(null as varchar) as note from orders""",
)
def shape_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case names get their declared case, an undeclared column is dropped."""
    rows = queries.bound(
        spark,
        """SELECT o_orderkey AS orderkey, CAST(o_totalprice AS STRING) AS TOTALPRICE,
          o_orderdate AS placedat, o_orderstatus AS status FROM orders""",
        tables={"orders": fx.table(spark, sf_dir, "orders")},
    )
    return ops.shape(rows, _ORDER).withColumn("placedAt", fx.ntz("placedAt"))


@query(
    "duplicate_column",
    f"""with {fx.CP} select p_name as name, created as "createdAt" from part
    join cp on p_partkey = l_partkey""",
)
def duplicate_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the join have createdAt; the relation's comes last and wins."""
    part = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.lit("2020-01-01T00:00:00Z").cast("timestamp_ntz").alias("createdAt"),
    )
    rows = queries.bound(
        spark,
        "SELECT * FROM part_entity p JOIN customer_parts cp ON p.id = cp.partId",
        tables={"part_entity": part, "customer_parts": fx.customer_parts_relation(spark, sf_dir)},
    )
    spec = ResponseSpec("Favourite", {"name": "String!", "createdAt": "AWSDateTime!"})
    return ops.shape(rows, spec).withColumn("createdAt", fx.ntz("createdAt"))


@query(
    "iso_datetime",
    """select event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%gZ') as at,
      strftime(ts,'%Y-%m-%dT%H:%M:%SZ') as text_at from events""",
)
def iso_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timestamp and its SQL text form, both to ISO text with a zone."""
    rows = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("at"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text_at"),
    )
    return ops.iso(rows, ["at", "text_at"])


@query(
    "single_row",
    "select o_orderkey as id, o_totalprice as total from orders order by 2 desc, 1 limit 1",
)
def single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total")
    )
    spec = ResponseSpec("Largest", {"id": "Int!", "total": "Float!"})
    return ops.shape(rows.orderBy(F.desc("total"), "id"), spec, single=True)


@query(
    "page",
    """select o_orderkey, o_custkey, o_totalprice from orders
    where o_totalprice < 250000 or (o_totalprice = 250000 and o_orderkey > 0)
    order by o_totalprice desc, o_orderkey limit 999""",
)
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that follows a given last row."""
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    order = [("o_totalprice", True), ("o_orderkey", False)]
    return queries.page(rows, order, 999, after={"o_totalprice": 250000.0, "o_orderkey": 0})


@query(
    "page_offset",
    """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey
    limit 999 offset 999""",
)
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return queries.page(rows, [("o_totalprice", True), ("o_orderkey", False)], 999, offset=999)

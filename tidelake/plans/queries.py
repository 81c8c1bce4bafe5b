"""The statements users write, over customers, parts, orders and the relation between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import queries as ops
from tidelake.operators import relations
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query
from tidelake.sources import files
from tidelake.specs import QuerySpec, ResponseSpec


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: fx.table(spark, sf_dir, n) for n in names}


_TEXT = "O'Brien'; DROP TABLE part --"


@query(
    "bind_args",
    """select p_partkey, 'O''Brien''; DROP TABLE part --' as text, 7 as n, 0.5 as ratio, true as flag,
      cast(null as varchar) as nothing from part where p_size > 7 and p_name <> 'it''s'""",
)
def bind_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        """SELECT p_partkey, :text AS text, :n AS n, :ratio AS ratio, :flag AS flag,
          CAST(:nothing AS STRING) AS nothing FROM part WHERE p_size > :n AND p_name <> :name""",
        {"text": _TEXT, "n": 7, "ratio": 0.5, "flag": True, "nothing": None, "name": "it's"},
        _tables(spark, sf_dir, "part"),
    )


@query(
    "filter_eq",
    """select c_custkey, c_name, c_acctbal from customer
    where c_mktsegment = 'BUILDING' and (c_acctbal between 1000 and 5000 or c_acctbal > 9000)""",
)
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = :segment
          AND (c_acctbal BETWEEN :low AND :high OR c_acctbal > :rich)""",
        {"segment": "BUILDING", "low": 1000, "high": 5000, "rich": 9000},
        _tables(spark, sf_dir, "customer"),
    )


@query("project_star", "select p.*, p_size * 2 as twice, lower(p_brand) as brand from part p")
def project_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT p.*, p_size * 2 AS twice, lower(p_brand) AS brand FROM part p"
    return ops.bound(spark, sql, tables=_tables(spark, sf_dir, "part"))


@query(
    "inner_join",
    """select c.c_custkey, c.c_name, n.n_name from customer c join nation n
    on c.c_nationkey = n.n_nationkey where n.n_regionkey = 1""",
)
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        """SELECT c.c_custkey, c.c_name, n.n_name FROM customer c
          JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = :region""",
        {"region": 1},
        _tables(spark, sf_dir, "customer", "nation"),
    )


FAVOURITES = QuerySpec(
    "favouriteParts",
    """SELECT p.p_partkey AS ID, p.p_name AS Name, p.p_brand AS brandid, p.p_retailprice AS price,
      cp.customerId, cp.createdAt
    FROM part p JOIN customer_parts cp ON p.p_partkey = cp.partId
    JOIN customer c ON cp.customerId = c.c_custkey
    WHERE c.c_mktsegment = :segment""",
    {"segment": "String!"},
    returns=ResponseSpec(
        "FavouritePart",
        {
            "id": "Int!",
            "name": "String!",
            "brandId": "ID!",
            "price": "Float!",
            "customerId": "Int!",
            "createdAt": "AWSDateTime!",
        },
    ),
)


def favourite_parts(spark: SparkSession, sf_dir: str, segment: str) -> DataFrame:
    tables = _tables(spark, sf_dir, "part", "customer")
    tables["customer_parts"] = fx.customer_parts_relation(spark, sf_dir)
    shaped = ops.run(spark, FAVOURITES, {"segment": segment}, tables)
    return shaped.withColumn("createdAt", fx.ntz("createdAt"))


@query(
    "m2m_join",
    f"""with {fx.CP} select p.p_partkey, p.p_name, p.p_brand, p.p_retailprice, cp.o_custkey, cp.created
    from part p join cp on p.p_partkey = cp.l_partkey""",
)
def m2m_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir, "part")
    tables["customer_parts"] = fx.customer_parts_relation(spark, sf_dir)
    return ops.bound(
        spark,
        """SELECT p.p_partkey, p.p_name, p.p_brand, p.p_retailprice, cp.customerId AS o_custkey,
          CAST(cp.createdAt AS TIMESTAMP_NTZ) AS created FROM part p JOIN customer_parts cp ON p.p_partkey = cp.partId""",
        tables=tables,
    )


@query(
    "m2m_join_shaped",
    f"""with {fx.CP} select p.p_partkey as id, p.p_name as name, p.p_brand as "brandId",
      p.p_retailprice as price, cp.o_custkey as "customerId", cp.created as "createdAt"
    from part p join cp on p.p_partkey = cp.l_partkey join customer on c_custkey = cp.o_custkey
    where c_mktsegment = 'BUILDING'""",
)
def m2m_join_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return favourite_parts(spark, sf_dir, "BUILDING")


@query(
    "left_join_count",
    """select c.c_custkey, count(o.o_orderkey) as n from customer c
    left join orders o on c.c_custkey = o.o_custkey and o.o_orderstatus = 'F' group by 1""",
)
def left_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "customer", "orders")
    finished = t["orders"].filter("o_orderstatus = 'F'")
    return ops.left_counts(
        t["customer"].select("c_custkey"),
        "c_custkey",
        ops.Branch(finished, "o_custkey", "o_orderkey", "n"),
    )


@query(
    "double_left_join",
    """select n.n_nationkey, count(c.c_custkey) as custs, count(distinct s.s_suppkey) as supps
    from nation n left join customer c on n.n_nationkey = c.c_nationkey
    left join supplier s on n.n_nationkey = s.s_nationkey group by 1""",
)
def double_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "nation", "customer", "supplier")
    return ops.left_counts(
        t["nation"].select("n_nationkey"),
        "n_nationkey",
        ops.Branch(t["customer"], "c_nationkey", "c_custkey", "custs"),
        ops.Branch(t["supplier"], "s_nationkey", "s_suppkey", "supps", distinct=True),
    )


@query(
    "global_agg",
    """select count(*) as total,
      cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as average from orders""",
)
def global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        """SELECT count(*) AS total,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM orders""",
        tables=_tables(spark, sf_dir, "orders"),
    )


@query(
    "group_report",
    """select strftime(o_orderdate,'%m') as month, count(*) as orders,
      cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue,
      cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as average
    from orders where strftime(o_orderdate,'%Y') = '2000' group by 1""",
)
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        """SELECT date_format(o_orderdate, 'MM') AS month, count(*) AS orders,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average
        FROM orders WHERE o_orderdate >= make_timestamp_ntz(:year, 1, 1, 0, 0, 0)
          AND o_orderdate < make_timestamp_ntz(:year + 1, 1, 1, 0, 0, 0)
        GROUP BY 1 ORDER BY month""",
        {"year": 2000},
        _tables(spark, sf_dir, "orders"),
    )


@query(
    "count_over",
    """select c.c_custkey, c.c_name, count(*) over() as total from customer c
    join nation a on c.c_nationkey = a.n_nationkey where a.n_name = 'NATION_3'""",
)
def count_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.bound(
        spark,
        """SELECT c.c_custkey, c.c_name FROM customer c
          JOIN nation a ON c.c_nationkey = a.n_nationkey WHERE a.n_name = :nation""",
        {"nation": "NATION_3"},
        _tables(spark, sf_dir, "customer", "nation"),
    )
    return ops.count_over(rows)


@query(
    "top_k",
    "select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 10",
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey
          ORDER BY n DESC, o_custkey LIMIT :k""",
        {"k": 10},
        _tables(spark, sf_dir, "orders"),
    )


@query("ilike_contains", "select p_partkey, p_name from part where p_name ilike '%RING%'")
def ilike_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE concat('%', :text, '%')",
        {"text": "RING"},
        _tables(spark, sf_dir, "part"),
    )


_OPTIONAL = QuerySpec(
    "parts",
    """SELECT p_partkey, p_brand, p_size FROM part
    WHERE (:brand IS NULL OR p_brand = :brand) AND (:size IS NULL OR p_size >= :size)""",
    {"brand": "String", "size": "Int"},
    {"size": 20},
)


@query("optional_filter", "select p_partkey, p_brand, p_size from part where p_size >= 20")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One argument left out (null), the other taken from its declared default."""
    return ops.run(spark, _OPTIONAL, {}, _tables(spark, sf_dir, "part"))


@query(
    "lookback_window",
    """select o_orderkey, o_orderdate from orders
    where o_orderdate >= timestamp '2001-08-01' - interval 30 day""",
)
def lookback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bound(
        spark,
        """SELECT o_orderkey, o_orderdate FROM orders
          WHERE o_orderdate >= CAST(:as_of AS TIMESTAMP_NTZ) - make_dt_interval(:days)""",
        {"as_of": "2001-08-01", "days": 30},
        _tables(spark, sf_dir, "orders"),
    )


@query(
    "partition_filter",
    """select strftime(o_orderdate,'%m') as month, count(*) as n,
      cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue
    from orders where year(o_orderdate) = 2000 and month(o_orderdate) between 4 and 9 group by 1""",
)
def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = files.scan(spark, fx.ORDER, fx.lake_of(spark, sf_dir, "order"))
    return ops.bound(
        spark,
        """SELECT month, count(*) AS n, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS revenue
          FROM order_lake WHERE year = :year AND month BETWEEN :first AND :last GROUP BY month""",
        {"year": "2000", "first": "04", "last": "09"},
        {"order_lake": lake},
    )


@query(
    "agg_star",
    """select c.*, coalesce(n, 0) as orders, coalesce(total, 0) as total from customer c left join
      (select o_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
       from orders group by 1) on o_custkey = c_custkey""",
)
def agg_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "customer", "orders")
    grouped = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )
    return ops.agg_star(t["customer"], "c_custkey", grouped, {"orders": 0, "total": 0.0})


@query(
    "relation_ordered",
    f"""with {fx.CP} select p.p_name, cp.o_custkey, cp.l_partkey, cp.created from cp
    join part p on p.p_partkey = cp.l_partkey order by cp.created desc, 2, 3""",
)
def relation_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    pairs = fx.customer_parts_relation(spark, sf_dir).select(
        F.col("customerId").alias("o_custkey"), F.col("partId").alias("l_partkey"),
        fx.ntz("createdAt").alias("created"),
    )
    # The keys after the date make the order total and split dates with many rows.
    return (
        pairs.join(part, "l_partkey")
        .select("p_name", "o_custkey", "l_partkey", "created")
        .orderBy(F.desc("created"), "o_custkey", "l_partkey")
    )


@query(
    "sync_statement",
    """with o as (select distinct l_orderkey, l_partkey from lineitem where l_linestatus = 'O'),
      f as (select distinct l_orderkey, l_partkey from lineitem where l_linestatus = 'F')
    select (select count(*) from (select * from o except select * from f)) as inserted,
      (select count(*) from (select * from o intersect select * from f)) as repeats""",
)
def sync_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert statement: how many associations were new and how many were there."""
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderId"),
        F.col("l_partkey").alias("partId"),
        F.col("l_shipdate").alias("createdAt"),
        "l_linestatus",
    )
    stored = fx.stored(
        spark,
        sf_dir,
        "order-parts",
        lambda: relations.insert(fx.ORDER_PARTS, lines.filter("l_linestatus = 'F'")).rows,
    )
    return relations.insert_counts(
        relations.insert(fx.ORDER_PARTS, lines.filter("l_linestatus = 'O'"), stored)
    )


@query("sync_statement_list", "select s_suppkey, s_name from supplier where s_acctbal > 5000")
def sync_statement_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(
        "richSuppliers",
        "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > :low",
        {"low": "Float!"},
    )
    return ops.statement(spark, spec, {"low": 5000.0}, _tables(spark, sf_dir, "supplier"))

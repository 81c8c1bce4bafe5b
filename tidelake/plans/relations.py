"""Relations made from orders and lines: which customer ordered which part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.ids import legacy_key, relation_id
from tidelake.lake import Lake
from tidelake.operators import relations as ops
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query
from tidelake.session import new_dir

_REL = f"rel as (select *, {fx.RID} as rid from cp)"
_EDGES = """edges as (select 'customer' as et, cast(o_custkey as varchar) as eid, rid, created from rel
    union all select 'part', cast(l_partkey as varchar), rid, created from rel)"""


def _edge_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("relatedEntityType").alias("et"), F.col("relatedEntityId").alias("eid"),
        F.col("relationId").alias("rid"),
    )


@query("relation_id", f"with {fx.CP} select o_custkey, l_partkey, {fx.RID} as relation_id from cp")
def relation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fx.customer_parts(spark, sf_dir)
    return pairs.select(
        F.col("customerId").alias("o_custkey"),
        F.col("partId").alias("l_partkey"),
        relation_id(fx.CUSTOMER_PARTS).alias("relation_id"),
    )


@query(
    "relation_id_self",
    """with f as (select cast(a.user_id as varchar) as x, cast(b.user_id as varchar) as y
        from events a join events b on b.event_id = a.event_id + 1)
    select distinct x as "followerId", y as "followingId",
      substr(sha256('user_follows|user:'||least(x,y)||'|user:'||greatest(x,y)),1,32) as default_id,
      substr(sha256('user_follows|followerId:user:'||x||'|followingId:user:'||y),1,32) as directed_id
    from f""",
)
def relation_id_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one type: the documented id ignores direction, the directed one does not."""
    pairs = fx.follows(spark, sf_dir).select("followerId", "followingId").distinct()
    return pairs.select(
        "followerId",
        "followingId",
        relation_id(fx.USER_FOLLOWS).alias("default_id"),
        relation_id(fx.USER_FOLLOWS_DIRECTED).alias("directed_id"),
    )


@query(
    "relation_insert",
    """with o as (select l_orderkey, l_partkey, min(l_shipdate) as created from lineitem
        where l_linestatus = 'O' group by 1, 2)
    select substr(sha256('order_parts|order:'||l_orderkey||'|part:'||l_partkey),1,32) as "relationId",
      l_orderkey as "orderId", l_partkey as "partId", created as "createdAt",
      exists (select 1 from lineitem f where f.l_linestatus = 'F' and f.l_orderkey = o.l_orderkey
        and f.l_partkey = o.l_partkey) as repeat from o""",
)
def relation_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines are stored already; open lines are the batch."""
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
        lambda: ops.insert(fx.ORDER_PARTS, lines.filter("l_linestatus = 'F'")).rows,
    )
    done = ops.insert(fx.ORDER_PARTS, lines.filter("l_linestatus = 'O'"), stored)
    both = done.rows.withColumn("repeat", F.lit(False)).unionByName(
        done.repeats.withColumn("repeat", F.lit(True))
    )
    return both.select(
        "relationId", "orderId", "partId", fx.ntz("createdAt").alias("createdAt"), "repeat"
    )


@query("relation_edges", f"with {fx.CP}, {_REL}, {_EDGES} select et, eid, rid from edges")
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = fx.customer_parts_relation(spark, sf_dir)
    return _edge_columns(ops.edges(fx.CUSTOMER_PARTS, rel))


@query(
    "relation_edges_self",
    """with f as (select distinct least(x,y) as lo, greatest(x,y) as hi from
        (select cast(a.user_id as varchar) as x, cast(b.user_id as varchar) as y
          from events a join events b on b.event_id = a.event_id + 1)),
      r as (select *, substr(sha256('user_follows|user:'||lo||'|user:'||hi),1,32) as rid from f)
    select 'user' as et, lo as eid, rid from r union select 'user', hi, rid from r""",
)
def relation_edges_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = ops.insert(fx.USER_FOLLOWS, fx.follows(spark, sf_dir)).rows
    return _edge_columns(ops.edges(fx.USER_FOLLOWS, rel))


@query(
    "relation_storage_key",
    f"with {fx.CP}, {_REL} select rid, {fx.KEY_PATH}||rid||'.parquet' as s3_key from rel",
)
def relation_storage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = fx.customer_parts_relation(spark, sf_dir)
    return rel.select(F.col("relationId").alias("rid"), F.col("s3Key").alias("s3_key"))


@query(
    "edges_by_entity",
    f"""with {fx.CP}, {_REL}, {_EDGES} select et, eid, rid from edges where et = 'customer'
      and eid in (select cast(c_custkey as varchar) from customer where c_acctbal < 0)""",
)
def edges_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ops.edges(fx.CUSTOMER_PARTS, fx.customer_parts_relation(spark, sf_dir))
    wanted = fx.closed_customers(spark, sf_dir).select(
        F.lit("customer").alias("relatedEntityType"),
        F.col("c_custkey").cast("string").alias("relatedEntityId"),
    )
    return _edge_columns(ops.edges_of(index, wanted))


@query(
    "edges_by_relation",
    f"""with {fx.CP}, {_REL}, {_EDGES} select et, eid, rid from edges
    where rid in (select rid from rel where created >= timestamp '2001-01-01')""",
)
def edges_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = fx.customer_parts_relation(spark, sf_dir)
    recent = rel.filter(F.col("createdAt") >= F.lit("2001-01-01T00:00:00Z").cast("timestamp"))
    return _edge_columns(ops.members_of(ops.edges(fx.CUSTOMER_PARTS, rel), recent))


@query(
    "relation_delete_where",
    f"""with {fx.CP}, {_REL} select {fx.KEY_PATH}||rid||'.parquet' as "s3Key", rid as "relationId"
    from rel where created < timestamp '1996-01-01'""",
)
def relation_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = fx.customer_parts_relation(spark, sf_dir)
    return ops.delete_targets(rel, F.col("createdAt") < F.lit("1996-01-01T00:00:00Z").cast("timestamp"))


_BRAND_SQL = "exists (select 1 from part p where p.p_partkey = l_partkey and p.p_brand = 'Brand#2')"


def _brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part").filter("p_brand = 'Brand#2'")
    return part.select(F.col("p_partkey").alias("partId"))


@query("relation_delete_join", f"with {fx.CP} select {fx.RID} as rid from cp where {_BRAND_SQL}")
def relation_delete_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = fx.customer_parts_relation(spark, sf_dir)
    targets = ops.delete_targets(rel, other=_brand(spark, sf_dir), on=["partId"])
    return targets.select(F.col("relationId").alias("rid"))


@query(
    "apply_relation_delete",
    f"""with {fx.CP}, {_REL}, {_EDGES}, kept as (select rid from rel where not {_BRAND_SQL})
    select 'relation' as kind, rid, cast(null as varchar) as eid from kept
    union all select et, rid, eid from edges where rid in (select rid from kept)""",
)
def apply_relation_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = fx.customer_parts_relation(spark, sf_dir)
    targets = ops.delete_targets(rel, other=_brand(spark, sf_dir), on=["partId"])
    left, index = ops.apply_delete(rel, ops.edges(fx.CUSTOMER_PARTS, rel), targets)
    return _remaining(left, index)


def _remaining(rel: DataFrame, index: DataFrame) -> DataFrame:
    rows = rel.select(
        F.lit("relation").alias("kind"), F.col("relationId").alias("rid"),
        F.lit(None).cast("string").alias("eid"),
    )
    return rows.unionByName(
        index.select(
            F.col("relatedEntityType").alias("kind"), F.col("relationId").alias("rid"),
            F.col("relatedEntityId").alias("eid"),
        )
    )


@query(
    "cascade_delete",
    f"""with {fx.CP}, {_REL}, {_EDGES}, kept as (select rid from rel where not exists
        (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0))
    select 'relation' as kind, rid, cast(null as varchar) as eid from kept
    union all select et, rid, eid from edges where rid in (select rid from kept)""",
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are deleted; their relations and all edges of these go too."""
    rel = fx.customer_parts_relation(spark, sf_dir)
    deleted = fx.closed_customers(spark, sf_dir).select(
        F.lit("customer").alias("entityType"), F.col("c_custkey").cast("string").alias("entityId")
    )
    index, left = ops.cascade(deleted, ops.edges(fx.CUSTOMER_PARTS, rel), {"customer_parts": rel})
    return _remaining(left["customer_parts"], index)


@query(
    "deletion_task",
    f"""with {fx.CP}, {_REL}, gone as (select rid from rel where {_BRAND_SQL})
    select 'SUCCEEDED' as status, 'removed' as kind, rid from gone
    union all select 'SUCCEEDED', 'kept', rid from rel where rid not in (select rid from gone)""",
)
def deletion_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The associations with one brand are deleted by a run, whose result names them."""
    lake = Lake(spark, new_dir(spark, "deletion"), relations=[fx.CUSTOMER_PARTS])
    pairs = fx.customer_parts(spark, sf_dir).select("customerId", "partId")
    lake.relate("customer_parts", pairs, fx.NOW)
    run_id = lake.submit_deletion(
        "customer_parts", "run-1", fx.NOW, other=_brand(spark, sf_dir), on=["partId"]
    )
    run, removed = lake.result(run_id)
    kept = lake.table("customer_parts").scan()
    return reduce(
        DataFrame.unionByName,
        (
            rows.select(
                F.lit(run.taskStatus).alias("status"),
                F.lit(kind).alias("kind"),
                F.col("relationId").alias("rid"),
            )
            for kind, rows in (("removed", removed), ("kept", kept))
        ),
    )


_TRIPLE_SQL = """t as (select l_orderkey, l_partkey, l_suppkey, min(l_shipdate) as created
    from lineitem group by 1, 2, 3), r as (select *, substr(sha256('order_part_supplier|order:'||l_orderkey
    ||'|part:'||l_partkey||'|supplier:'||l_suppkey),1,32) as rid from t)"""


@query(
    "nary_relation",
    f"""with {_TRIPLE_SQL} select 'order' as et, cast(l_orderkey as varchar) as eid, rid from r
    union all select 'part', cast(l_partkey as varchar), rid from r
    union all select 'supplier', cast(l_suppkey as varchar), rid from r""",
)
def nary_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplierId"),
        F.col("l_orderkey").alias("orderId"),
        F.col("l_partkey").alias("partId"),
        F.col("l_shipdate").alias("createdAt"),
    )
    rows = ops.insert(fx.ORDER_PART_SUPPLIER, lines).rows
    return _edge_columns(ops.edges(fx.ORDER_PART_SUPPLIER, rows))


@query(
    "legacy_relation_key",
    f"with {fx.CP} select 'customer_'||o_custkey||'_part_'||l_partkey as legacy_key from cp",
)
def legacy_relation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fx.customer_parts(spark, sf_dir)
    pk = F.concat(F.lit("relation#customer_parts#customer#"), F.col("customerId").cast("string"))
    sk = F.concat(F.lit("relation#customer_parts#part#"), F.col("partId").cast("string"))
    return pairs.select(legacy_key(pk, sk).alias("legacy_key"))


@query(
    "relation_schema",
    f"""with {fx.CP}, {_REL} select rid as "relationId", o_custkey as "customerId",
      l_partkey as "partId", {fx.KEY_PATH}||rid||'.parquet' as "s3Key", created as "createdAt" from rel""",
)
def relation_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = fx.customer_parts_relation(spark, sf_dir)
    schema = fx.CUSTOMER_PARTS.schema(partitions=False)
    return rel.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).withColumn(
        "createdAt", fx.ntz("createdAt")
    )

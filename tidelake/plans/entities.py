"""Entity changes over the events table, with users as the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.parse import names_where
from tidelake.operators import entities as ops
from tidelake.operators.ingest import route, decode, pick_image, SYSTEM_FIELDS
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query
from tidelake.specs import EntitySpec, Field

_LATEST_SQL = f"""with {fx.CH} select user_id, event_id, value, props from ch
  where rn = 1 and op <> 'REMOVE'"""


def _state(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("bigint").alias("user_id"), F.col("eventId").alias("event_id"), "value", "props"
    )


@query("latest_state", _LATEST_SQL)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(ops.latest(fx.typed_events(spark, sf_dir), "id"))


@query("upsert_entities", _LATEST_SQL)
def upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the first half of the month with the second half applied to it."""
    changes = fx.typed_events(spark, sf_dir)
    half = F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    before = ops.latest(changes.filter(F.col("ts") < half), "id").select(*fx.ACCOUNT.columns)
    return _state(ops.upsert(before, changes.filter(F.col("ts") >= half), "id"))


@query("delete_entities", "select c_custkey, c_name, c_acctbal from customer where not c_acctbal < 0")
def delete_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return ops.delete(customers, fx.closed_customers(spark, sf_dir), "c_custkey")


@query(
    "create_rows",
    """with d as (select *, md5('user|'||c_custkey) as h from customer)
    select substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) as id,
      c_name as name, c_acctbal as value, c_mktsegment as props,
      timestamp '2024-06-01' as createdAt, timestamp '2024-06-01' as updatedAt from d""",
)
def create_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = EntitySpec("User", {"id": "ID!", "name": "String!", "value": "Float", "props": "String"})
    rows = fx.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("value"),
        F.col("c_mktsegment").alias("props"),
    )
    made = ops.create(rows, spec, fx.NOW, request_key=["c_custkey"])
    return made.withColumns({c: fx.ntz(c) for c in ("createdAt", "updatedAt")})


@query(
    "read_by_ids",
    """select distinct user_id as id, s_name as name, s_name is not null as found
    from events left join supplier on s_suppkey = user_id""",
)
def read_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    ids = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    found, missing = ops.read(suppliers, ids)
    return found.withColumn("found", F.lit(True)).unionByName(
        missing.select("id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("found"))
    )


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views set the value, clicks the props, purchases both; others patch nothing."""
    kind = F.col("event_type")
    present = names_where(
        [("value", kind.isin("view", "purchase")), ("props", kind.isin("click", "purchase"))]
    )
    return (
        fx.table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("id"),
            "value",
            "props",
            present.alias("_present"),
            "ts",
            F.col("event_id").alias("seq"),
        )
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.lit("2020-01-01T00:00:00Z").cast("timestamp")
    return fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("value"),
        F.col("c_mktsegment").alias("props"),
        opened.alias("createdAt"),
        opened.alias("updatedAt"),
    )


_FOLDED = """folded as (select user_id,
    arg_max(value,(ts,event_id)) filter (event_type in ('view','purchase')) as value,
    arg_max(props,(ts,event_id)) filter (event_type in ('click','purchase')) as props,
    max(ts) as updated_at from events group by 1)"""


@query(
    "partial_update",
    f"""with {_FOLDED} select c_custkey as id, c_name as name, coalesce(f.value, c_acctbal) as value,
      coalesce(f.props, c_mktsegment) as props, timestamp '2020-01-01' as createdAt,
      coalesce(f.updated_at, timestamp '2020-01-01') as updatedAt
    from customer left join folded f on f.user_id = c_custkey""",
)
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = ops.patch(_users(spark, sf_dir), _patches(spark, sf_dir), fx.USER)
    return table.withColumns({c: fx.ntz(c) for c in ("createdAt", "updatedAt")})


@query(
    "update_ack",
    f"with {_FOLDED} select user_id as id, value, props, updated_at as \"updatedAt\" from folded",
)
def update_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ack = ops.patch_ack(_patches(spark, sf_dir), fx.USER)
    return ack.select("id", "value", "props", fx.ntz("updatedAt").alias("updatedAt"))


@query("delete_ack", "select c_custkey as id, true as deleted from customer where c_acctbal < 0")
def delete_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.delete_ack(fx.closed_customers(spark, sf_dir).withColumnRenamed("c_custkey", "id"))


@query(
    "cascade_messages",
    """select 'account' as "entityType", cast(user_id as varchar) as "entityId", max(ts) as timestamp
    from events where event_type = 'error' group by 2""",
)
def cascade_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = [Field(n, "String") for n in (*SYSTEM_FIELDS, "id")]
    decoded = decode(pick_image(fx.change_records(spark, sf_dir)), system)
    sent = ops.cascade_keys(route(decoded)["entity"])
    return sent.withColumn("timestamp", fx.ntz("timestamp"))

"""Decode, type and route over changes made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import ingest as ops
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query
from tidelake.specs import EntitySpec, Field

_IMAGE_FIELDS = [
    Field.of("id", "ID!"),
    Field.of("eventId", "Int!"),
    Field.of("kind", "String!"),
    Field.of("value", "Float"),
    Field.of("props", "String"),
    Field.of("tags", "[String!]"),
    Field.of("detail", "String"),
    Field.of("large", "Boolean"),
    Field.of("nothing", "String"),
    Field.of("absent", "String"),
    Field.of("createdAt", "AWSDateTime!"),
]


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.decode(ops.pick_image(fx.change_records(spark, sf_dir)), _IMAGE_FIELDS)


@query(
    "decode_image",
    """select cast(user_id as varchar) as id, cast(event_id as varchar) as eventId,
      event_type as kind, cast(value as varchar) as value, props, event_type||',event' as tags,
      '{"k":"'||json_extract_string(props,'$.k')||'"}' as detail,
      case when value > 50 then 'true' else 'false' end as large,
      cast(null as varchar) as nothing, cast(null as varchar) as absent,
      strftime(ts,'%Y-%m-%dT%H:%M:%S.%fZ') as createdAt from events""",
)
def decode_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f.name for f in _IMAGE_FIELDS]
    return _decoded(spark, sf_dir).select(*names).withColumn("tags", F.array_join("tags", ","))


@query(
    "enforce_types",
    """select cast(user_id as varchar) as id, event_id as eventId, event_type as kind, value, props,
      event_type||',event' as tags, value > 50 as large, cast(null as varchar) as nothing,
      ts as createdAt from events""",
)
def enforce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.enforce(_decoded(spark, sf_dir), _IMAGE_FIELDS)
    return rows.select(
        "id", "eventId", "kind", "value", "props", F.array_join("tags", ",").alias("tags"),
        "large", "nothing", fx.ntz("createdAt").alias("createdAt"),
    )


@query(
    "infer_untyped",
    """select event_id as eventId, cast(user_id as varchar) as id, event_type as kind, value, props,
      value > 50 as large, ts as createdAt, '{"k":"'||json_extract_string(props,'$.k')||'"}' as detail
    from events""",
)
def infer_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No declaration at all: types come from the images, for the names a caller asks for."""
    names = ["eventId", "id", "kind", "value", "props", "large", "createdAt", "detail"]
    rows = ops.infer(ops.pick_image(fx.change_records(spark, sf_dir)), names)
    return rows.select(*names[:6], fx.ntz("createdAt").alias("createdAt"), "detail")


_SCORED = [Field.of("event_id", "Int!"), Field.of("score", "Int"), Field.of("large", "Boolean")]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as text; what an error event carries is not a number."""
    unusable = F.col("event_type") == "error"
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(unusable, F.col("props")).otherwise(F.col("value").cast("string")).alias("score"),
        F.when(F.col("event_type") == "view", "perhaps").otherwise("yes").alias("large"),
    )


@query(
    "quarantine",
    """select event_id, cast(null as bigint) as score, 'score' as lost from events
      where event_type = 'error'
    union all select event_id, cast(trunc(value) as bigint), 'large' from events
      where event_type = 'view'
    union all select event_id, cast(trunc(value) as bigint), '' from events
      where event_type not in ('error', 'view')""",
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = ops.quarantine(ops.enforce(_scored(spark, sf_dir), _SCORED))
    return good.select("event_id", "score", F.lit("").alias("lost")).unionByName(
        bad.select("event_id", "score", F.array_join("_cast_errors", ",").alias("lost"))
    )


@query(
    "partition_cols",
    """select o_orderkey, strftime(o_orderdate,'%Y') as year, strftime(o_orderdate,'%m') as month,
      strftime(o_orderdate,'%d') as day from orders""",
)
def partition_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "createdAt")
    return ops.with_partitions(orders, fx.NOW).select("o_orderkey", "year", "month", "day")


@query(
    "ingest_metadata",
    f"""with {fx.CH} select event_id, op as _event_name, timestamp '2024-06-01' as _processing_timestamp,
      strftime(ts,'%Y') as _partition_year, strftime(ts,'%m') as _partition_month,
      strftime(ts,'%d') as _partition_day from ch""",
)
def ingest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.with_metadata(fx.typed_events(spark, sf_dir), fx.NOW)
    return rows.select(
        F.col("eventId").alias("event_id"),
        "_event_name",
        fx.ntz("_processing_timestamp").alias("_processing_timestamp"),
        "_partition_year",
        "_partition_month",
        "_partition_day",
    )


@query(
    "route_changes",
    """with r as (select event_id, case
        when event_type = 'view' then 'entity'
        when event_type = 'click' and value > 50 then 'relation'
        when event_type = 'purchase' then 'legacy_relation' end as route from events)
      select event_id, route from r where route is not null""",
)
def route_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are entities, clicks relation rows (removed when small), purchases legacy rows,
    signups run records, errors edges."""
    kind = F.col("event_type")
    rows = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.when((kind == "click") & (F.col("value") <= 50), "REMOVE").otherwise("INSERT").alias("op"),
        F.when(kind == "click", F.concat(F.lit("joinTableData#"), "event_id"))
        .otherwise(F.concat(F.lit("item#"), "event_id"))
        .alias("PK"),
        F.when(kind == "signup", "task").when(kind == "error", "joinRelation").otherwise("item")
        .alias("entityType"),
        F.when(kind.isin("click", "purchase"), "favourites").alias("joinTable"),
        F.lit(None).cast("string").alias("joinTableName"),
        F.col("event_id").cast("string").alias("relationId"),
    )
    parts = [d.select("event_id", F.lit(n).alias("route")) for n, d in ops.route(rows).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SEEN = EntitySpec("Customer", {"id": "Int!", "name": "String!", "lastSeen": "AWSDateTime!"})


def _customers_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.max("ts").cast("timestamp").alias("lastSeen")
    )
    customers = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    return customers.join(seen, "id", "left")


@query(
    "required_violations",
    """select c_custkey as id, 'lastSeen' as missing from customer
    where not exists (select 1 from events where user_id = c_custkey)""",
)
def required_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ops.required_violations(_customers_seen(spark, sf_dir), _SEEN)
    return bad.withColumn("missing", F.array_join("missing", ","))


@query(
    "input_columns",
    """select c_name as name, (select max(ts) from events where user_id = c_custkey) as lastSeen
    from customer""",
)
def input_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f.name for f in _SEEN.input_fields("update")]
    return _customers_seen(spark, sf_dir).select(*names).withColumn("lastSeen", fx.ntz("lastSeen"))

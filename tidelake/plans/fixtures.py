"""What the given tables stand for: entities, relations, change and execution feeds.

Every frame covers its whole table. Which rows count as removed, deleted or finished
follows from their attributes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.ingest import with_partitions
from tidelake.operators.relations import relation_rows
from tidelake.session import new_dir
from tidelake.sources.files import write_lake
from tidelake.specs import EntitySpec, RelationSpec

NOW = "2024-06-01T00:00:00Z"

ACCOUNT = EntitySpec(
    "Account",
    {
        "id": "ID!",
        "eventId": "Int!",
        "kind": "String!",
        "value": "Float",
        "props": "String",
        "tags": "[String!]",
    },
)
ACTIVITY = EntitySpec(
    "Activity",
    {
        "id": "Int!",
        "userId": "ID!",
        "kind": "String!",
        "value": "Float!",
        "props": "String",
        "note": "String",
    },
)
# Orders filed under the first day of their month.
ORDER = EntitySpec(
    "Order",
    {
        "id": "Int!",
        "customerId": "Int!",
        "status": "String!",
        "total": "Float!",
        "priority": "String",
    },
)
USER = EntitySpec(
    "User", {"id": "Int!", "name": "String!", "value": "Float", "props": "String"}
)
CUSTOMER_PARTS = RelationSpec(
    "customer_parts",
    {"customerId": "Customer", "partId": "Part"},
    {"customerId": "Int", "partId": "Int"},
)
ORDER_PARTS = RelationSpec(
    "order_parts", {"orderId": "Order", "partId": "Part"}, {"orderId": "Int", "partId": "Int"}
)
ORDER_PART_SUPPLIER = RelationSpec(
    "order_part_supplier",
    {"supplierId": "Supplier", "orderId": "Order", "partId": "Part"},
    {"supplierId": "Int", "orderId": "Int", "partId": "Int"},
)
ACCOUNT_KINDS = RelationSpec("account_kinds", {"accountId": "Account", "kindName": "Kind"})
USER_FOLLOWS = RelationSpec("user_follows", {"followerId": "User", "followingId": "User"})
USER_FOLLOWS_DIRECTED = RelationSpec(
    "user_follows", {"followerId": "User", "followingId": "User"}, directed=True
)

# SQL fragments the oracles share.
CP = (
    "cp as (select o_custkey, l_partkey, min(o_orderdate) as created"
    " from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)"
)
RID = "substr(sha256('customer_parts|customer:'||o_custkey||'|part:'||l_partkey),1,32)"
KEY_PATH = (
    "'tables/customer_parts/year='||strftime(created,'%Y')||'/month='||strftime(created,'%m')"
    "||'/day='||strftime(created,'%d')||'/'"
)
CH = (
    "ch as (select *, case event_type when 'error' then 'REMOVE' when 'signup' then 'INSERT'"
    " else 'MODIFY' end as op, row_number() over (partition by user_id"
    " order by ts desc, event_id desc) as rn from events)"
)
# One run per order that is not open, one execution event per line.
RUNS = (
    "runs as (select cast(o_orderkey as varchar) as task_id, o_orderdate as start_date,"
    " case when o_orderpriority = '1-URGENT' then 'deletionTask' end as task_type"
    " from orders where o_orderstatus <> 'O')"
)
ALL_RUNS = RUNS.replace(" where o_orderstatus <> 'O'", "")
EXEC = (
    "ex as (select cast(l_orderkey as varchar) as task_id, l_shipdate as ts,"
    " case when l_returnflag = 'A' then 'SUCCEEDED'"
    " when l_returnflag = 'R' and l_linestatus = 'F' then 'FAILED'"
    " when l_returnflag = 'R' then 'CANCELLED'"
    " when l_linestatus = 'F' then 'QUEUED' else 'RUNNING' end as state from lineitem)"
)
ENDED = (
    "ended as (select task_id, state, ts from (select *, row_number() over"
    " (partition by task_id order by ts desc, state desc) as rn from ex"
    " where state in ('SUCCEEDED','FAILED','CANCELLED')) where rn = 1)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(column: str | Column) -> Column:
    """Timestamps leave a query without a zone, as the given tables have them."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customer ever ordered which part, since when."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .groupBy(F.col("o_custkey").alias("customerId"), F.col("l_partkey").alias("partId"))
        .agg(F.min("o_orderdate").alias("createdAt"))
    )


def customer_parts_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation as a stored table, whose ids and keys follow from what is stored."""
    pairs = stored(spark, sf_dir, "customer-parts", lambda: customer_parts(spark, sf_dir))
    return relation_rows(CUSTOMER_PARTS, pairs)


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user follows the user of the next event; both directions occur."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    nxt = events.select(
        (F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("followingId")
    )
    return events.join(nxt, "event_id").select(
        F.col("user_id").cast("string").alias("followerId"),
        F.col("followingId").cast("string").alias("followingId"),
        F.col("ts").alias("createdAt"),
    )


def closed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt count as deleted."""
    return table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")


def op_of(event_type: str = "event_type") -> Column:
    kind = F.col(event_type)
    return F.when(kind == "error", "REMOVE").when(kind == "signup", "INSERT").otherwise("MODIFY")


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as typed changes of the user they belong to."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_id").alias("eventId"),
        F.col("event_type").alias("kind"),
        "value",
        "props",
        F.array("event_type").alias("tags"),
        F.col("ts").cast("timestamp").alias("createdAt"),
        F.col("ts").cast("timestamp").alias("updatedAt"),
        op_of().alias("op"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def _text(c: Column) -> Column:
    return F.struct(c.alias("S"))


def _number(c: Column) -> Column:
    return F.struct(c.cast("string").alias("N"))


def iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def event_image() -> Column:
    """The attribute-value JSON an operational store would emit for one event."""
    member = F.struct(_number(F.get_json_object("props", "$.k")).alias("k"))
    return F.to_json(
        F.struct(
            _text(F.concat(F.lit("account#"), "user_id")).alias("PK"),
            _text(F.lit("account")).alias("entityType"),
            _text(F.col("user_id").cast("string")).alias("id"),
            _number(F.col("event_id")).alias("eventId"),
            _text(F.col("event_type")).alias("kind"),
            _number(F.col("value")).alias("value"),
            _text(F.col("props")).alias("props"),
            F.struct(F.array(_text(F.col("event_type")), _text(F.lit("event"))).alias("L")).alias(
                "tags"
            ),
            F.struct(member.alias("M")).alias("detail"),
            F.struct((F.col("value") > 50).alias("BOOL")).alias("large"),
            F.struct(F.lit(True).alias("NULL")).alias("nothing"),
            _text(iso("ts")).alias("createdAt"),
            _text(iso("ts")).alias("updatedAt"),
        )
    )


_STORED: dict[tuple[str, str, str], str] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame]
) -> DataFrame:
    """A derived table as operators meet it: Parquet in the shared folder, one per session."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STORED:
        path = new_dir(spark, name)
        rows().write.parquet(path)
        _STORED[at] = path
    return spark.read.parquet(_STORED[at])


def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded change records as a stored feed."""
    return stored(spark, sf_dir, "changes", lambda: encoded_changes(spark, sf_dir))


def encoded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as encoded change records."""
    image = event_image()
    removed = F.col("event_type") == "error"
    # A feed arrives as many files; one small input file would leave one.
    events = table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
    return events.select(
        F.concat(F.lit("account#"), "user_id").alias("key"),
        op_of().alias("op"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(removed, image).alias("old_image"),
        F.when(~removed, image).alias("new_image"),
    )


def _records(events: DataFrame, image: Column, removed: Column) -> DataFrame:
    """Change records with the given images, placed by their events."""
    return events.select(
        F.col("event_id").cast("string").alias("key"),
        F.when(removed, "REMOVE").otherwise("INSERT").alias("op"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(removed, image).alias("old_image"),
        F.when(~removed, image).alias("new_image"),
    )


def lake_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as of ``encoded_changes``, and what each account did as a relation to the
    kind of it; errors, which remove the account, make none."""
    done = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    rid = F.concat_ws("_", "user_id", "event_type")
    texts = {
        "PK": F.concat(F.lit("joinTableData#"), rid),
        "entityType": F.lit("account_kinds"),
        "joinTable": F.lit("account_kinds"),
        "joinTableName": F.lit("account_kinds"),
        "relationId": rid,
        "accountId": F.col("user_id").cast("string"),
        "kindName": F.col("event_type"),
        "s3Key": F.lit("k"),
        "createdAt": iso("ts"),
    }
    image = F.to_json(F.struct(*(_text(c).alias(k) for k, c in texts.items())))
    return encoded_changes(spark, sf_dir).unionByName(_records(done, image, F.lit(False)))


def faulty_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account record for each event. Views are sound; clicks carry a number that is none,
    purchases lack a required field, signups name a table that nobody declared, and errors
    a table that is declared as something else, small ones an entity as a relation."""
    kind = F.col("event_type")
    other = (kind == "error") & (F.col("value") <= 50)
    texts = {
        "PK": F.when(other, F.concat(F.lit("joinTableData#"), "event_id")).otherwise(
            F.concat(F.lit("account#"), "event_id")
        ),
        "entityType": F.when(kind == "signup", "nobody")
        .when(kind == "error", "account_kinds")
        .otherwise("account"),
        "joinTable": F.when(other, "account"),
        "joinTableName": F.when(other, "account"),
        "relationId": F.when(other, F.col("event_id").cast("string")),
        "id": F.col("event_id").cast("string"),
        "eventId": F.when(kind == "click", F.col("props")).otherwise(F.col("event_id").cast("string")),
        "kind": F.when(kind != "purchase", kind),
        "createdAt": iso("ts"),
    }
    given = {k: F.when(c.isNotNull(), _text(c)) for k, c in texts.items()}
    image = F.to_json(F.struct(*(c.alias(k) for k, c in given.items())))
    return _records(table(spark, sf_dir, "events"), image, F.lit(False))


def run_requests(spark: SparkSession, sf_dir: str, unsent: bool = False) -> DataFrame:
    """A request for each order; those of open ones are ``unsent``, so their events are of
    unknown runs."""
    orders = table(spark, sf_dir, "orders")
    orders = orders if unsent else orders.filter("o_orderstatus <> 'O'")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("taskId"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "deletionTask").alias("taskType"),
        F.col("o_orderdate").cast("timestamp").alias("submitted"),
    )


def execution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    state = (
        F.when(flag == "A", "SUCCEEDED")
        .when((flag == "R") & (status == "F"), "FAILED")
        .when(flag == "R", "CANCELLED")
        .when(status == "F", "QUEUED")
        .otherwise("RUNNING")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("queryExecutionId"),
        state.alias("currentState"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("userId"),
        F.col("event_type").alias("kind"),
        "value",
        "props",
        F.col("ts").cast("timestamp").alias("createdAt"),
        F.col("ts").cast("timestamp").alias("updatedAt"),
    )
    return with_partitions(rows, NOW)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customerId"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
        month.alias("createdAt"),
        F.col("o_orderdate").cast("timestamp").alias("updatedAt"),
    )
    return with_partitions(rows, NOW)


def relation_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = customer_parts(spark, sf_dir).withColumn(
        "createdAt", F.date_trunc("month", F.col("createdAt").cast("timestamp"))
    )
    return with_partitions(relation_rows(CUSTOMER_PARTS, pairs), NOW)


_LAKES: dict[tuple[str, str, str], str] = {}
_ROWS = {
    "activity": (activity_rows, ACTIVITY),
    "order": (order_rows, ORDER),
    "customer_parts": (relation_by_month, CUSTOMER_PARTS),
}


def lake_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Path of a date-partitioned copy of a table, written on first use in a session."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _LAKES:
        rows, spec = _ROWS[name]
        frame = rows(spark, sf_dir)
        for column in spec.columns:
            if column not in frame.columns:
                frame = frame.withColumn(column, F.lit(None).cast(spec.schema()[column].dataType))
        path = new_dir(spark, name)
        write_lake(frame, spec, path, mode="overwrite")
        _LAKES[at] = path
    return _LAKES[at]

"""Streams over files written from the given tables; each run reads them to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.lake import Lake
from tidelake.operators import entities, relations, runs
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import ORACLES, query
from tidelake.plans import entities as entity_plans  # noqa: F401  (its SQL is reused)
from tidelake.plans import runs as run_plans  # noqa: F401
from tidelake.session import new_dir
from tidelake.sources import feeds
from tidelake.sources.lake import LakeTable
from tidelake.sources.ordered import OrderedTable
from tidelake.streaming.ingest import start_apply, start_ingest
from tidelake.streaming.relations import start_relate
from tidelake.streaming.tracker import start_run_tracker, tracked_state


def _state(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("bigint").alias("user_id"), F.col("eventId").alias("event_id"), "value", "props"
    )


def _change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "change-files")
    fx.encoded_changes(spark, sf_dir).write.parquet(path)
    return feeds.changes(spark, path, streaming=True, files_per_batch=1000)


@query("stream_latest_state", ORACLES["latest_state"])
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded changes through the stream to the change log, then the latest state of it."""
    log = new_dir(spark, "change-log")
    stream = _change_stream(spark, sf_dir)
    start_ingest(stream, fx.ACCOUNT, log, new_dir(spark, "ingest-cp"), fx.NOW).awaitTermination()
    return _state(entities.latest(spark.read.parquet(log), "id"))


@query("stream_merge", ORACLES["latest_state"])
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes merged into a lake table batch by batch."""
    table = LakeTable(spark, new_dir(spark, "stream-account"), fx.ACCOUNT)
    stream = _change_stream(spark, sf_dir)
    start_apply(
        stream, table, new_dir(spark, "merge-cp"), fx.NOW, new_dir(spark, "bad-rows")
    ).awaitTermination()
    return _state(table.scan())


def _new_lake(spark: SparkSession) -> Lake:
    return Lake(spark, new_dir(spark, "lake"), [fx.ACCOUNT], [fx.ACCOUNT_KINDS])


@query(
    "stream_lake",
    f"""with {fx.CH}, alive as (select * from ch where rn = 1 and op <> 'REMOVE')
      select 'account' as stored_in, cast(user_id as varchar) as id, event_type as kind,
        event_id as event_id from alive
      union all select distinct 'account_kinds', user_id||'_'||event_type, event_type, null
        from ch where op <> 'REMOVE' and user_id in (select user_id from alive)""",
)
def stream_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream into entities and relations, with the cascade of what it removes."""
    path, lake = new_dir(spark, "lake-changes"), _new_lake(spark)
    fx.lake_changes(spark, sf_dir).write.parquet(path)
    stream = feeds.changes(spark, path, streaming=True, files_per_batch=1000)
    bad = new_dir(spark, "lake-bad-rows")
    lake.start(stream, new_dir(spark, "lake-cp"), fx.NOW, bad).awaitTermination()
    accounts, kinds = (lake.table(t).scan() for t in ("account", "account_kinds"))
    return accounts.select(
        F.lit("account").alias("stored_in"), "id", "kind", F.col("eventId").alias("event_id")
    ).unionByName(
        kinds.select(
            F.lit("account_kinds").alias("stored_in"),
            F.col("relationId").alias("id"),
            F.col("kindName").alias("kind"),
            F.lit(None).cast("long").alias("event_id"),
        )
    )


@query(
    "ingest_rejects",
    """select case event_type when 'view' then 'stored' when 'click' then 'eventId'
        when 'purchase' then 'kind' else 'unknown' end as outcome, count(*) as n
      from events group by 1""",
)
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each record of a faulty feed ends: no record is lost, none is in two places."""
    lake, bad = _new_lake(spark), new_dir(spark, "rejects")
    lake.apply(fx.faulty_changes(spark, sf_dir), fx.NOW, bad, batch=0)
    stored = lake.table("account").scan().select(F.lit("stored").alias("outcome"))
    wrong = [
        spark.read.parquet(f"{bad}/{t}").select(F.array_join("_cast_errors", ",").alias("outcome"))
        for t in ("account", "account_kinds")
    ]
    unknown = spark.read.parquet(f"{bad}/_unknown").select(F.lit("unknown").alias("outcome"))
    every = stored.unionByName(wrong[0]).unionByName(wrong[1]).unionByName(unknown)
    return every.groupBy("outcome").agg(F.count("*").alias("n"))


@query("upsert_out_of_order", ORACLES["latest_state"])
def upsert_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in three batches, the latest first and one of them twice."""
    table = OrderedTable(spark, new_dir(spark, "ordered"), fx.ACCOUNT)
    changes = fx.typed_events(spark, sf_dir)
    days = [F.lit(f"2024-01-{d}T00:00:00Z").cast("timestamp") for d in ("11", "21")]
    first, last = F.col("ts") < days[0], F.col("ts") >= days[1]
    middle = ~first & ~last
    for part in (last, middle, first, middle):
        table.merge(changes.filter(part), fx.NOW)
    return _state(table.scan())


@query(
    "stream_relation_insert",
    """select distinct substr(sha256('order_parts|order:'||l_orderkey||'|part:'||l_partkey),1,32)
      as "relationId", l_orderkey as "orderId", l_partkey as "partId" from lineitem""",
)
def stream_relation_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines are stored already, filed by month; open lines come as a stream."""
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderId"),
        F.col("l_partkey").alias("partId"),
        F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("createdAt"),
        "l_linestatus",
    )
    path = new_dir(spark, "line-files")
    lines.filter("l_linestatus = 'O'").drop("l_linestatus").write.parquet(path)
    table = LakeTable(spark, new_dir(spark, "order-parts"), fx.ORDER_PARTS)
    finished = lines.filter("l_linestatus <> 'O'").drop("l_linestatus")
    table.append(relations.insert(fx.ORDER_PARTS, finished, now=fx.NOW).rows, fx.NOW)
    stream = spark.readStream.schema(lines.drop("l_linestatus").schema).parquet(path)
    bad = new_dir(spark, "bad-pairs")
    start_relate(stream, table, new_dir(spark, "relate-cp"), fx.NOW, bad).awaitTermination()
    return table.scan().select("relationId", "orderId", "partId")


@query("stream_run_state", ORACLES["run_state"])
def stream_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, log = new_dir(spark, "exec-files"), new_dir(spark, "exec-log")
    fx.execution_events(spark, sf_dir).write.parquet(path)
    events = feeds.exec_events(spark, path, streaming=True)
    start_run_tracker(events, log, new_dir(spark, "tracker-cp")).awaitTermination()
    opened = runs.open_runs(fx.run_requests(spark, sf_dir), fx.NOW)
    return tracked_state(spark, opened, log, fx.NOW).select(
        F.col("taskId").alias("task_id"), F.col("taskStatus").alias("status"),
        fx.ntz("finishDate").alias("finish_date"),
    )

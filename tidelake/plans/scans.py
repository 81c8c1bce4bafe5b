"""Scans and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query
from tidelake.session import new_dir
from tidelake.sources import feeds, files
from tidelake.sources.lake import LakeTable
from tidelake.specs import ResponseSpec

_ACTIVITY_SQL = """
select event_id as id, cast(user_id as varchar) as userId, event_type as kind, value, props,
  cast(null as varchar) as note, ts as createdAt, ts as updatedAt,
  strftime(ts,'%Y') as year, strftime(ts,'%m') as month, strftime(ts,'%d') as day from events"""
_ORDER_SQL = """
select o_orderkey as id, o_custkey as customerId, o_orderstatus as status, o_totalprice as total,
  o_orderpriority as priority, cast(date_trunc('month', o_orderdate) as timestamp) as createdAt,
  o_orderdate as updatedAt, strftime(o_orderdate,'%Y') as year, strftime(o_orderdate,'%m') as month,
  '01' as day from orders"""


def _zoneless(df: DataFrame) -> DataFrame:
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: fx.ntz(c) for c in stamps})


@query("entity_scan", _ACTIVITY_SQL)
def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(files.scan(spark, fx.ACTIVITY, fx.lake_of(spark, sf_dir, "activity")))


@query("partition_scan", _ACTIVITY_SQL + " where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")
def partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = "year = '2024' and month = '01' and day between '10' and '19'"
    lake = fx.lake_of(spark, sf_dir, "activity")
    return _zoneless(files.scan(spark, fx.ACTIVITY, lake, where=where))


@query("projected_range", _ORDER_SQL + " where year(o_orderdate) between 1998 and 2000")
def projected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = fx.lake_of(spark, sf_dir, "order")
    return _zoneless(files.scan(spark, fx.ORDER, lake, years=(1998, 2000)))


@query(
    "relation_scan",
    f"""with {fx.CP}, m as (select o_custkey, l_partkey,
      cast(date_trunc('month', created) as timestamp) as created from cp)
    select {fx.RID} as relationId, o_custkey as customerId, l_partkey as partId,
      {fx.KEY_PATH}||{fx.RID}||'.parquet' as s3Key, created as createdAt,
      strftime(created,'%Y') as year, strftime(created,'%m') as month, '01' as day from m""",
)
def relation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = fx.lake_of(spark, sf_dir, "customer_parts")
    return _zoneless(files.scan(spark, fx.CUSTOMER_PARTS, lake))


@query(
    "change_source",
    f"""with {fx.CH} select 'account#'||user_id as key, op, ts, event_id as seq,
      op = 'REMOVE' as has_old, op <> 'REMOVE' as has_new from ch""",
)
def change_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "changes")
    fx.encoded_changes(spark, sf_dir).write.parquet(path)
    return feeds.changes(spark, path).select(
        "key",
        "op",
        fx.ntz("ts").alias("ts"),
        "seq",
        F.col("old_image").isNotNull().alias("has_old"),
        F.col("new_image").isNotNull().alias("has_new"),
    )


@query(
    "exec_event_source",
    f"with {fx.EXEC} select task_id as queryExecutionId, state as currentState, ts from ex",
)
def exec_event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "exec-events")
    fx.execution_events(spark, sf_dir).write.json(path)
    return feeds.exec_events(spark, path, fmt="json").withColumn("ts", fx.ntz("ts"))


@query(
    "lake_write",
    """select strftime(o_orderdate,'%Y') as year, strftime(o_orderdate,'%m') as month, '01' as day,
      count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
    from orders group by 1, 2, 3""",
)
def lake_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "order-lake")
    files.write_lake(fx.order_rows(spark, sf_dir), fx.ORDER, path)
    total = F.sum(F.col("total").cast("decimal(18,2)")).cast("double")
    back = files.scan(spark, fx.ORDER, path)
    return back.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query(
    "compaction",
    f"""with {fx.CH} select cast(user_id as varchar) as id, event_id as eventId, event_type as kind,
      value, props, ts as createdAt, strftime(ts,'%Y') as year, strftime(ts,'%m') as month,
      strftime(ts,'%d') as day from ch where rn = 1 and op <> 'REMOVE'""",
)
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of changes, the second moving rows between dates, then one compaction."""
    table = LakeTable(spark, new_dir(spark, "account"), fx.ACCOUNT)
    changes = fx.typed_events(spark, sf_dir)
    half = F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    table.merge(changes.filter(F.col("ts") < half), fx.NOW)
    table.merge(changes.filter(F.col("ts") >= half), fx.NOW)
    table.compact()
    return table.scan().select(
        "id", "eventId", "kind", "value", "props", fx.ntz("createdAt").alias("createdAt"),
        "year", "month", "day",
    )


_REPORT = ResponseSpec("Report", {"month": "String!", "orders": "Int!"})


@query(
    "result_sink",
    """select strftime(o_orderdate,'%m') as month, count(*) as orders
    from orders group by 1""",
)
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    report = orders.groupBy(F.date_format("o_orderdate", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    root = new_dir(spark, "results")
    files.save_result(report, root, "monthly")
    return files.load_result(spark, root, "monthly", _REPORT)


@query(
    "narrow_types",
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate from lineitem",
)
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem")
    return files.narrow(
        lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    )

"""Run log over orders (one run each, unless open) and lines (execution events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import runs as ops
from tidelake.plans import fixtures as fx
from tidelake.plans.registry import query

def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.open_runs(fx.run_requests(spark, sf_dir), fx.NOW)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_state(_runs(spark, sf_dir), fx.execution_events(spark, sf_dir), fx.NOW)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll that saw the last terminal event of every run that has one."""
    return ops.last_terminal(fx.execution_events(spark, sf_dir)).withColumnRenamed("at", "changedAt")


@query(
    "run_open",
    f"""with {fx.ALL_RUNS} select task_id as "taskId", task_type as "taskType",
      cast(null as varchar) as "mutationName", 'RUNNING' as "taskStatus",
      timestamp '2024-06-01' as "startDate", cast(null as timestamp) as "finishDate",
      timestamp '2024-06-01' as "createdAt", timestamp '2024-06-01' as "updatedAt" from runs""",
)
def run_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request arrives twice; the runs of the first delivery exist already."""
    requests = fx.run_requests(spark, sf_dir, unsent=True)
    first = ops.open_runs(requests.filter("taskType is null"), fx.NOW)
    rest = ops.open_runs(requests.unionByName(requests), fx.NOW, existing=first)
    stamps = ("startDate", "finishDate", "createdAt", "updatedAt")
    return first.unionByName(rest).withColumns({c: fx.ntz(c) for c in stamps})


@query(
    "run_events_terminal",
    f"""with {fx.EXEC} select task_id as "queryExecutionId", state as "currentState", ts from ex
    where state in ('SUCCEEDED','FAILED','CANCELLED')""",
)
def run_events_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.terminal(fx.execution_events(spark, sf_dir)).withColumn("ts", fx.ntz("ts"))


@query(
    "run_status_map",
    f"""with {fx.EXEC} select state, case when state = 'SUCCEEDED' then 'SUCCEEDED'
      when state in ('FAILED','CANCELLED') then 'FAILED' else 'RUNNING' end as status,
      count(*) as n from ex group by 1, 2""",
)
def run_status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("currentState")
    return (
        fx.execution_events(spark, sf_dir)
        .groupBy(state.alias("state"), ops.map_status(state).alias("status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "run_state",
    f"""with {fx.RUNS}, {fx.EXEC}, {fx.ENDED} select r.task_id, case when e.state is null
      then 'RUNNING' when e.state = 'SUCCEEDED' then 'SUCCEEDED' else 'FAILED' end as status,
      e.ts as finish_date from runs r left join ended e on r.task_id = e.task_id""",
)
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select(
        F.col("taskId").alias("task_id"), F.col("taskStatus").alias("status"),
        fx.ntz("finishDate").alias("finish_date"),
    )


@query(
    "deletion_requests",
    f"""with {fx.RUNS}, {fx.EXEC}, {fx.ENDED} select r.task_id from runs r
    join ended e on r.task_id = e.task_id where e.state = 'SUCCEEDED' and task_type = 'deletionTask'""",
)
def deletion_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deletion_requests(_state(spark, sf_dir)).select(F.col("taskId").alias("task_id"))


@query(
    "run_reconcile",
    f"""with {fx.RUNS}, {fx.EXEC}, {fx.ENDED},
      early as (select task_id, state, ts from (select *, row_number() over (partition by task_id
        order by ts desc, state desc) as rn from ex where state in ('SUCCEEDED','FAILED','CANCELLED')
        and ts < timestamp '1998-01-01') where rn = 1),
      f as (select r.task_id, coalesce(a.state, e.state) as state, coalesce(a.ts, e.ts) as ts
        from runs r left join early a on a.task_id = r.task_id left join ended e on e.task_id = r.task_id)
    select task_id, case when state is null then 'RUNNING' when state = 'SUCCEEDED' then 'SUCCEEDED'
      else 'FAILED' end as status, ts as finish_date from f""",
)
def run_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes stored up to 1998 stay; runs still RUNNING then are corrected by the poll."""
    events = fx.execution_events(spark, sf_dir)
    early = events.filter(F.col("ts") < F.lit("1998-01-01T00:00:00Z").cast("timestamp"))
    stored = ops.run_state(_runs(spark, sf_dir), early, fx.NOW)
    fixed = ops.reconcile(stored, _observed(spark, sf_dir), fx.NOW)
    return fixed.select(
        F.col("taskId").alias("task_id"), F.col("taskStatus").alias("status"),
        fx.ntz("finishDate").alias("finish_date"),
    )


@query(
    "run_result_view",
    f"""with {fx.RUNS}, {fx.EXEC}, {fx.ENDED}, res as (select cast(l_orderkey as varchar) as task_id,
      cast(sum(cast(l_quantity as decimal(18,2))) as double) as result from lineitem group by 1)
    select r.task_id as "taskId", case when e.state is null then 'RUNNING' when e.state = 'SUCCEEDED'
      then 'SUCCEEDED' else 'FAILED' end as "taskStatus",
      case when e.state = 'SUCCEEDED' then res.result end as result, e.ts as "finishDate"
    from runs r left join ended e on r.task_id = e.task_id left join res on res.task_id = r.task_id""",
)
def run_result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of a run is the quantity its order shipped."""
    results = fx.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("taskId")
    ).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("result"))
    view = ops.result_view(_state(spark, sf_dir), results)
    return view.select("taskId", "taskStatus", "result", fx.ntz("finishDate").alias("finishDate"))


@query(
    "deletion_result_view",
    f"""with {fx.RUNS}, {fx.EXEC}, {fx.ENDED} select r.task_id as "taskId",
      case when e.state = 'SUCCEEDED' then 'SUCCEEDED' else 'FAILED' end as "taskStatus",
      e.ts as "finishDate" from runs r left join ended e on r.task_id = e.task_id
    where task_type = 'deletionTask'""",
)
def deletion_result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the poll knows nothing about count as failed."""
    view = ops.deletion_view(_runs(spark, sf_dir), _observed(spark, sf_dir), fx.NOW)
    return view.select("taskId", "taskStatus", fx.ntz("finishDate").alias("finishDate"))

"""Run log: from submitted requests and execution events to run state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.parse import instant

# Run states and the execution states that end a run.
RUNNING, SUCCEEDED, FAILED, CANCELLED = "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED")
DELETION = "deletionTask"
# Stands for "no time" in packed events: far before any timestamp, yet safe to multiply.
_NO_TIME = -(1 << 60)
RUN_COLUMNS = (
    "taskId",
    "taskType",
    "mutationName",
    "taskStatus",
    "startDate",
    "finishDate",
    "createdAt",
    "updatedAt",
)


def open_runs(
    requests: DataFrame, now: datetime | str | Column, existing: DataFrame | None = None
) -> DataFrame:
    """One RUNNING run per submitted request; a request seen before opens none."""
    stamp = instant(now)

    def optional(name: str) -> Column:
        given = F.col(name) if name in requests.columns else F.lit(None)
        return given.cast("string").alias(name)

    once = requests.groupBy(F.col("taskId").cast("string").alias("taskId")).agg(
        F.min(F.struct(optional("taskType"), optional("mutationName"))).alias("_about")
    )
    opened = once.select(
        "taskId",
        "_about.taskType",
        "_about.mutationName",
        F.lit(RUNNING).alias("taskStatus"),
        stamp.alias("startDate"),
        F.lit(None).cast("timestamp").alias("finishDate"),
        stamp.alias("createdAt"),
        stamp.alias("updatedAt"),
    )
    if existing is None:
        return opened
    known = existing.select("taskId").join(opened.select("taskId"), "taskId", "left_semi")
    return opened.join(known, "taskId", "left_anti")


def terminal(events: DataFrame) -> DataFrame:
    """Events that end a run and name it."""
    return events.filter(
        F.col("queryExecutionId").isNotNull()
        & (F.col("queryExecutionId") != "")
        & F.col("currentState").isin(*TERMINAL)
    )


def map_status(state: Column) -> Column:
    """Run status for an execution state."""
    return (
        F.when(state == "SUCCEEDED", SUCCEEDED)
        .when(state.isin("FAILED", "CANCELLED"), FAILED)
        .otherwise(RUNNING)
    )


def last_terminal(events: DataFrame) -> DataFrame:
    """The last terminal event of each run, as (taskId, state, at).

    Time and state are packed into one number, so its maximum is a hash aggregate that
    shrinks the events before the shuffle without sorting them. Of several states at
    one time the alphabetically last counts; an event without a time comes first.
    """
    ended = sorted(TERMINAL)
    state = F.col("currentState")
    rank = F.array_position(F.array(*[F.lit(s) for s in ended]), state) - 1
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NO_TIME))
    packed = terminal(events).select(
        F.col("queryExecutionId").alias("taskId"), (micros * 4 + rank).alias("_packed")
    )
    last = packed.groupBy("taskId").agg(F.max("_packed").alias("_packed"))
    time = F.shiftright("_packed", 2)
    return last.select(
        "taskId",
        F.element_at(
            F.array(*[F.lit(s) for s in ended]), (F.col("_packed").bitwiseAND(3) + 1).cast("int")
        ).alias("state"),
        F.when(time != _NO_TIME, F.timestamp_micros(time)).alias("at"),
    )


def run_state(runs: DataFrame, events: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Known runs with the outcome of their last terminal event; others stay as they are.

    Events of unknown runs change nothing. The finish date is the event's time, or
    ``now`` where it has none.
    """
    hit = F.col("state").isNotNull()
    return _with(
        runs.join(last_terminal(events), "taskId", "left"),
        taskStatus=F.when(hit, map_status(F.col("state"))).otherwise(F.col("taskStatus")),
        finishDate=F.when(hit, F.coalesce(F.col("at"), instant(now))).otherwise(
            F.col("finishDate")
        ),
        updatedAt=F.when(hit, instant(now)).otherwise(F.col("updatedAt")),
    )


def unknown_events(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Terminal events whose run is not recorded yet; keep them for the next batch."""
    ids = runs.select(F.col("taskId").alias("queryExecutionId"))
    return terminal(events).join(ids, "queryExecutionId", "left_anti")


def _with(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in RUN_COLUMNS])


def deletion_requests(state: DataFrame) -> DataFrame:
    """Succeeded deletion runs, whose targets are now due."""
    return state.filter(
        (F.col("taskType") == DELETION) & (F.col("taskStatus") == SUCCEEDED)
    ).select("taskId")


def reconcile(runs: DataFrame, observed: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Correct runs stored as RUNNING from polled states; stored outcomes are final.

    ``observed`` holds one (taskId, state, changedAt) per polled run.
    """
    polled = observed.select(
        "taskId",
        F.struct("state", F.col("changedAt").cast("timestamp").alias("changedAt")).alias("_seen"),
    )
    status = map_status(F.col("_seen.state"))
    moved = (F.col("taskStatus") == RUNNING) & F.col("_seen").isNotNull() & (status != RUNNING)
    finished = F.coalesce(F.col("_seen.changedAt"), instant(now))
    return _with(
        runs.join(polled, "taskId", "left"),
        taskStatus=F.when(moved, status).otherwise(F.col("taskStatus")),
        finishDate=F.when(moved, finished).otherwise(F.col("finishDate")),
        updatedAt=F.when(moved, instant(now)).otherwise(F.col("updatedAt")),
    )


def result_view(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Status, dates and, for a succeeded run only, its result.

    ``results`` holds one (taskId, result) per run that stored one.
    """
    joined = runs.join(results, "taskId", "left")
    shown = F.when(F.col("taskStatus") == SUCCEEDED, F.col("result"))
    return joined.select("taskId", "taskStatus", shown.alias("result"), "startDate", "finishDate")


def deletion_view(
    runs: DataFrame,
    observed: DataFrame,
    now: datetime | str | Column,
    removed: DataFrame | None = None,
) -> DataFrame:
    """Status and dates of deletion runs from polled states; a failed poll is a failure.

    Only a state that ended gives a finish date. With ``removed``, the taskIds whose
    rows are gone for good, a search that ended still counts as RUNNING until then.
    """
    deletions = runs.filter(F.col("taskType") == DELETION)
    polled = observed.select(
        "taskId", F.col("state").alias("_state"), F.col("changedAt").cast("timestamp").alias("_at")
    )
    joined = deletions.join(polled, "taskId", "left")
    pending = F.lit(False)
    if removed is not None:
        gone = removed.select("taskId", F.lit(True).alias("_gone")).distinct()
        joined = joined.join(gone, "taskId", "left")
        pending = (F.col("_state") == "SUCCEEDED") & F.col("_gone").isNull()
    status = (
        F.when(F.col("_state").isNull(), FAILED)
        .when(pending, RUNNING)
        .otherwise(map_status(F.col("_state")))
    )
    ended = F.col("_state").isin(*TERMINAL) & ~F.coalesce(pending, F.lit(False))
    return joined.select(
        "taskId",
        status.alias("taskStatus"),
        "startDate",
        F.when(ended, F.coalesce(F.col("_at"), instant(now))).alias("finishDate"),
    )

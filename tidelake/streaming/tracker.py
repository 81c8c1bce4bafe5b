"""Execution events to run state.

Terminal events are appended to a log as they come. State is the run log joined with
the whole event log, so an event that arrives before its run is recorded is not lost.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from tidelake.operators.runs import run_state, terminal
from tidelake.sources.feeds import exec_events


def start_run_tracker(events: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append the terminal events that are available, then stop."""
    return (
        terminal(events)
        .writeStream.format("parquet")
        .option("path", log_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def tracked_state(
    spark: SparkSession, runs: DataFrame, log_path: str, now: datetime | str | Column
) -> DataFrame:
    """Run state after every event logged so far."""
    return run_state(runs, exec_events(spark, log_path), now)

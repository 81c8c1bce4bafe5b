"""Change stream to typed change log, and change log to table.

The log is append-only, so the stream keeps no state and a restart from its checkpoint
neither loses nor repeats a file. State per key lives in the table, not in the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tidelake.operators.ingest import sound, typed_changes, with_metadata
from tidelake.sources.journal import source_id
from tidelake.sources.lake import LakeTable
from tidelake.specs import EntitySpec

# Bookkeeping columns the log keeps beside the typed fields.
LOG_DATE = ("_partition_year", "_partition_month", "_partition_day")


def log_rows(changes: DataFrame, spec: EntitySpec, now: datetime | str | Column) -> DataFrame:
    """Typed change rows with their bookkeeping columns; works on a batch or a stream."""
    return with_metadata(typed_changes(changes, spec), now)


def start_ingest(
    changes: DataFrame,
    spec: EntitySpec,
    log_path: str,
    checkpoint: str,
    now: datetime | str | Column,
) -> StreamingQuery:
    """Append every change of one entity to its log, cast errors included, then stop."""
    return (
        log_rows(changes, spec, now)
        .writeStream.format("parquet")
        .option("path", log_path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*LOG_DATE)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def for_each_batch(
    changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int, str], None]
) -> StreamingQuery:
    """``apply(rows, number, source)`` for each micro-batch there is, then stop.

    ``source`` names the stream: another one, even in the place of its checkpoint, has
    another id. A batch that failed comes again with its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        source = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        apply(batch, number, source)

    return (
        changes.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_apply(
    changes: DataFrame, table: LakeTable, checkpoint: str, now: datetime | str, bad_path: str
) -> StreamingQuery:
    """Merge each micro-batch into the table; bad rows go to ``bad_path``.

    Bad rows have a cast error or lack a required field; each batch of each stream has a
    folder of its own. The table remembers the last batch number of each checkpoint, so a
    batch that is delivered again after a failure is applied once, and a new stream starts
    from its own.
    """

    def apply(batch: DataFrame, number: int, source: str) -> None:
        good, bad = sound(typed_changes(batch, table.spec), table.spec)
        attempt = f"source={source_id(source)}/batch={number}"
        bad.write.mode("overwrite").parquet(f"{bad_path}/{attempt}")
        table.merge(good, now, batch=number, source=source)

    return for_each_batch(changes, checkpoint, apply)

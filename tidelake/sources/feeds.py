"""Change records and execution events, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("old_image", T.StringType()),
        T.StructField("new_image", T.StringType()),
    ]
)
EXEC_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("queryExecutionId", T.StringType()),
        T.StructField("currentState", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
# Fixed order of a change: time first, then the sequence number within it.
CHANGE_ORDER = ("ts", "seq")


def _feed(
    spark: SparkSession,
    schema: T.StructType,
    path: str,
    streaming: bool,
    fmt: str,
    files_per_batch: int | None,
) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(schema).format(fmt)
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def changes(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Change records with their images still encoded as attribute-value JSON."""
    return _feed(spark, CHANGE_SCHEMA, path, streaming, fmt, files_per_batch)


def exec_events(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """State changes of submitted runs."""
    return _feed(spark, EXEC_EVENT_SCHEMA, path, streaming, fmt, files_per_batch)

"""A table that changes may reach in any order.

Beside the rows lies what was last applied to each key: its place in the order of changes,
removals included. A change counts only if it comes after that, so batches that are late,
repeated or out of order leave the state that all changes together have.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.entities import last_change
from tidelake.session import cut
from tidelake.sources.feeds import CHANGE_ORDER
from tidelake.sources.files import TableSpec
from tidelake.sources.lake import LakeTable
from tidelake.specs import EntitySpec

# Keys as text, so that one layout serves tables of any key.
MARK = EntitySpec("Mark", {"id": "ID!", "at": "AWSDateTime", "seq": "Int", "removed": "Boolean"})


class OrderedTable:
    """A table of entities or relations and the marks of its keys, under one root."""

    def __init__(self, spark: SparkSession, root: str, spec: TableSpec):
        self.spec = spec
        self.rows = LakeTable(spark, f"{root.rstrip('/')}/rows", spec)
        self.marks = LakeTable(spark, f"{root.rstrip('/')}/marks", MARK)

    def scan(self, **options) -> DataFrame:
        """Live rows, as of ``LakeTable.scan``."""
        return self.rows.scan(**options)

    def newer(self, changes: DataFrame, order: Iterable[str] = CHANGE_ORDER) -> DataFrame:
        """The last change of each key, if it comes after what was applied to it."""
        time, number = order
        last = cut(last_change(changes, self.spec.key, (time, number)))
        key = F.col(self.spec.key).cast("string")
        marks = self.marks.scan().select(
            F.col("id").alias("_mark"), F.col("at").alias("_at"), F.col("seq").alias("_seq")
        )
        # Only marks of changed keys matter: a small set of keys meets the marks' key column.
        known = marks.join(last.select(key.alias("_mark")), "_mark", "left_semi")
        late = F.col("_mark").isNotNull() & (
            F.struct(F.col(time), F.col(number)) <= F.struct(F.col("_at"), F.col("_seq"))
        )
        met = last.withColumn("_key", key).join(known, F.col("_key") == F.col("_mark"), "left")
        return cut(met.filter(~late).select(*last.columns))

    def merge(
        self, changes: DataFrame, now: datetime | str | Column, order: Iterable[str] = CHANGE_ORDER
    ) -> int:
        """Apply typed changes that are newer than what their keys had; the order is total.

        Rows are published before marks: after a failure in between the same changes count
        as newer once more, and applying them again changes nothing.
        """
        time, number = order
        due = self.newer(changes, order)
        version = self.rows.merge(due, now, order)
        marks = due.select(
            F.col(self.spec.key).cast("string").alias("id"),
            F.col(time).cast("timestamp").alias("at"),
            F.col(number).cast("long").alias("seq"),
            (F.col("op") == "REMOVE").alias("removed"),
            F.col(time).cast("timestamp").alias("createdAt"),
            F.col(time).cast("timestamp").alias("updatedAt"),
            F.lit("MODIFY").alias("op"),
            F.col(time).alias("ts"),
            F.col(number).alias("seq_"),
        )
        self.marks.merge(marks, now, ("ts", "seq_"))
        return version

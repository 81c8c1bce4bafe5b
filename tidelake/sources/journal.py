"""Which numbered batches of which source are wholly done, as one small file each.

A batch that feeds several tables is finished only when all of them have it. Every table
repeats its part without harm, so a batch that stopped half-way is applied again from the
start, and one that has its mark is left alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def source_id(source: str) -> str:
    """A name for a source that can stand in a path."""
    return hashlib.sha256(source.encode()).hexdigest()[:24]


class Journal:
    """Marks ``<root>/<source id>-<batch>``; the highest batch of a source counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def _marks(self, source: str) -> dict[int, object]:
        pattern, fs = self._path(f"{source_id(source)}-*")
        found = [s.getPath() for s in (fs.globStatus(pattern) or [])]
        return {int(p.getName().rsplit("-", 1)[1]): p for p in found}

    def done(self, source: str, batch: int) -> bool:
        """Whether that batch of the source, or a later one, is wholly done."""
        return batch <= max(self._marks(source), default=-1)

    def finish(self, source: str, batch: int) -> None:
        """Mark the batch as done; marks of earlier ones are no longer needed."""
        path, fs = self._path(f"{source_id(source)}-{batch}")
        fs.create(path, True).close()
        for number, old in self._marks(source).items():
            if number < batch:
                fs.delete(old, False)

"""Session settings and scratch folders shared by every operator."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


# Settings results or scale depend on, valid in any running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the grouping after it then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "tidelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Partition counts are left to adaptive execution: start wide, let it coalesce to
    file-sized pieces, split skewed join inputs and skewed rebalance outputs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    tuned = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m", **SETTINGS, **conf}
    for name, value in tuned.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream checkpoints of this application.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        # local-cluster is several processes, and anything else several machines.
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="tidelake-")
        shared = _LOCAL_SCRATCH[context.applicationId]
    return f"{shared.rstrip('/')}/tidelake/{context.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder; nothing is created yet."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *partition_by: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Store ``df`` as a table in the work folder and go on from there.

    Used where one result feeds several jobs, so it is neither recomputed per job nor
    lost with an executor. The planner then knows its true size, which is what lets it
    broadcast a small set of keys instead of shuffling the big table they meet. Inside
    ``scratch`` the table lasts as long as the block, or the one around it with ``keep``.
    """
    spark = df.sparkSession
    path = new_dir(spark, "cut")
    if _SCRATCH:
        _free_shuffles(spark)
    level = 2 if keep else 1
    if len(_SCRATCH) >= level:
        _SCRATCH[-level].append(path)
    writer = df.write.partitionBy(*partition_by)
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def split_code(spark: SparkSession) -> Iterator[None]:
    """For jobs with very many expressions a row. The JVM never compiles a method beyond 8,000
    bytes, so a whole stage in one method would be interpreted; Spark then generates its
    projections by themselves, in small methods."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``cut`` stores inside, as a long chain of steps needs only
    its last tables; and free the shuffle files of each step before the next."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        delete(spark, _SCRATCH.pop())
        _free_shuffles(spark)


def _free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of a plan once the driver has collected the plan."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear_work_dir(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once nothing reads them."""
    delete(spark, [work_dir(spark)])

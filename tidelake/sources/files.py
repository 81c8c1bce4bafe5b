"""Date-partitioned Parquet: scans with declared columns, writes without hot tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.relations import packed, unpacked
from tidelake.specs import PARTITIONS, EntitySpec, RelationSpec, ResponseSpec

TableSpec = EntitySpec | RelationSpec


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def scan(
    spark: SparkSession,
    spec: TableSpec,
    root: str | list[str],
    where: Column | str | None = None,
    years: tuple[int, int] | None = None,
    base_path: str | None = None,
) -> DataFrame:
    """An entity or relation table with exactly its declared columns.

    Columns missing from old files read as null and undeclared ones are never
    decoded. Partition values stay zero-padded text. ``where`` on year, month or
    day prunes directories; ``years`` bounds the visible range, unbounded when left out.
    """
    reader = spark.read.schema(spec.schema())
    if base_path:
        reader = reader.option("basePath", base_path)
    df = reader.parquet(*([root] if isinstance(root, str) else root))
    # Directory levels above the dates (table versions) are not part of the table.
    df = df.select(*spec.columns, *PARTITIONS)
    if years is not None:
        low, high = years
        df = df.filter(F.col("year").between(f"{low:04d}", f"{high:04d}"))
    return df if where is None else df.filter(where)


def scan_nanos(spark: SparkSession, spec: TableSpec, root: str) -> DataFrame:
    """The same table where files hold nanosecond timestamps, which Spark cannot type.

    They are read as integers and reduced to microseconds; narrower integer and
    float columns widen to the declared type during the scan.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    stamps = {f.name for f in spec.fields if f.kind == "AWSDateTime" and not f.is_list}
    on_disk = T.StructType(
        [
            T.StructField(f.name, T.LongType(), True) if f.name in stamps else f
            for f in spec.schema().fields
        ]
    )
    df = spark.read.schema(on_disk).parquet(root)
    micros = {c: F.timestamp_micros(F.expr(f"(`{c}` - pmod(`{c}`, 1000)) div 1000")) for c in stamps}
    return df.select(*[micros[c].alias(c) if c in stamps else F.col(c) for c in df.columns])


def arrange(
    df: DataFrame, sort_key: str | None = None, relation: RelationSpec | None = None
) -> DataFrame:
    """Bring the rows of one date together before a partitioned write.

    A rebalance, not a repartition: adaptive execution splits a date that holds far
    more rows than the others over several tasks and joins small dates. Sorting by
    key inside a file makes its row-group statistics useful for point reads. Rows of a
    ``relation`` move without the ids and keys that follow from the rest.
    """
    spread = (packed(relation, df) if relation else df).hint("rebalance", *PARTITIONS)
    if relation:
        spread = unpacked(relation, spread)
    return spread.sortWithinPartitions(*PARTITIONS, *([sort_key] if sort_key else []))


def write_lake(df: DataFrame, spec: TableSpec, path: str, mode: str = "append") -> None:
    """Write typed rows under ``year=/month=/day=`` as SNAPPY Parquet."""
    relation = spec if isinstance(spec, RelationSpec) else None
    (
        arrange(df.select(*spec.columns, *PARTITIONS), spec.key, relation)
        .write.mode(mode)
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def _result_path(root: str, run_id: str) -> str:
    """The folder of a run; its id may not lead anywhere else."""
    if not re.fullmatch("[A-Za-z0-9_-]+", run_id):
        raise ValueError(f"a run id has letters, digits, _ and - only, not {run_id!r}")
    return f"{root}/run_id={run_id}"


def save_result(df: DataFrame, root: str, run_id: str) -> str:
    """Keep the result of one run under its id; a re-run replaces only its own."""
    path = _result_path(root, run_id)
    df.write.mode("overwrite").parquet(path)
    return path


def load_result(spark: SparkSession, root: str, run_id: str, shape: ResponseSpec | None = None):
    """A saved result, with declared types when the shape is known."""
    reader = spark.read
    if shape is not None:
        reader = reader.schema(T.StructType([f.struct_field() for f in shape.fields]))
    return reader.parquet(_result_path(root, run_id))


def narrow(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast integer columns to the smallest width that holds every value.

    One aggregate over all columns finds the bounds; values beyond 32 bits keep 64.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, whole) and (columns is None or f.name in columns)
    ]
    if not names:
        return df
    bounds = df.agg(
        *[F.min(n).cast("bigint").alias(f"lo_{i}") for i, n in enumerate(names)],
        *[F.max(n).cast("bigint").alias(f"hi_{i}") for i, n in enumerate(names)],
    ).first()
    widths = {}
    for i, name in enumerate(names):
        largest = max(abs(bounds[f"lo_{i}"] or 0), abs(bounds[f"hi_{i}"] or 0))
        if largest < 128:
            widths[name] = "tinyint"
        elif largest < 32768:
            widths[name] = "smallint"
        elif largest <= 2147483647:
            widths[name] = "int"
        else:
            widths[name] = "bigint"
    return df.select(
        *[F.col(c).cast(widths[c]).alias(c) if c in widths else F.col(c) for c in df.columns]
    )

"""Parameterised SQL and the query shapes that need care at scale."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.results import shape
from tidelake.session import cut
from tidelake.specs import QuerySpec



def check_args(args: Mapping[str, object]) -> dict[str, object]:
    """Arguments a statement may bind: text, numbers, booleans, dates, null."""
    for name, value in args.items():
        if value is None or isinstance(value, (bool, str, date, datetime)):
            continue
        if isinstance(value, int):
            continue
        if isinstance(value, float):
            if math.isfinite(value):
                continue
            raise ValueError(f"argument {name!r} is not a finite number")
        raise TypeError(f"argument {name!r} has unsupported type {type(value).__name__}")
    return dict(args)


def bound(
    spark: SparkSession,
    sql: str,
    args: Mapping[str, object] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run ``sql`` with ``:name`` markers bound as typed parameters, never as text.

    ``tables`` registers frames under the names the statement uses.
    """
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=check_args(args or {}))


# Python types a declared scalar accepts.
_ACCEPTS = {
    "ID": (str, int),
    "String": (str,),
    "Int": (int,),
    "Float": (int, float),
    "Boolean": (bool,),
    "AWSDateTime": (str, datetime),
}


def resolve_args(query: QuerySpec, args: Mapping[str, object]) -> dict[str, object]:
    """Given values, declared defaults for the rest, null for optional ones."""
    declared = {f.name: f for f in query.arguments}
    unknown = sorted(set(args) - set(declared))
    if unknown:
        raise ValueError(f"{query.name} has no argument {', '.join(unknown)}")
    resolved = {}
    for name, f in declared.items():
        value = args.get(name, f.default)
        if f.is_list:
            raise TypeError(f"argument {name!r} of {query.name} is a list; lists cannot be bound")
        if value is None and f.required:
            raise ValueError(f"{query.name} needs argument {name!r}")
        accepts = _ACCEPTS.get(f.kind, (str,))
        if value is not None:
            flag = isinstance(value, bool) and bool not in accepts
            if flag or not isinstance(value, accepts):
                raise TypeError(f"argument {name!r} of {query.name} is not {f.kind}")
        resolved[name] = str(value) if f.kind == "ID" and value is not None else value
    return check_args(resolved)


def run(
    spark: SparkSession,
    query: QuerySpec,
    args: Mapping[str, object] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """A declared query: arguments resolved and bound, result in its declared shape."""
    df = bound(spark, query.sql, resolve_args(query, args or {}), tables)
    if query.returns is not None:
        df = shape(df, query.returns, iso_dates=query.iso_dates)
    return df if query.is_list else df.limit(1)


def statement(
    spark: SparkSession,
    query: QuerySpec,
    args: Mapping[str, object] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame | Row | None:
    """Run at once: a frame for a list, else the first row or None."""
    df = run(spark, query, args, tables)
    return df if query.is_list else df.first()


def count_over(df: DataFrame, name: str = "total", reuse: bool = False) -> DataFrame:
    """Every row next to the number of rows, as ``COUNT(*) OVER ()`` gives.

    The count is a scalar subquery: partial counts meet in one row, the rows themselves
    stay where they are. A window without a partition would move all of them to one task.
    ``reuse`` stores rows that are too costly to compute for the count as well.
    """
    if reuse:
        df = cut(df)
    return df.select("*", df.agg(F.count(F.lit(1))).scalar().alias(name))


@dataclass(frozen=True)
class Branch:
    """One LEFT JOIN of ``left_counts``: its rows, its key, and what to count.

    ``count`` counts joined rows with a non-null ``column`` as SQL does, including the
    fan-out the other branches cause; ``distinct`` counts different values.
    """

    rows: DataFrame
    key: str
    column: str
    name: str
    distinct: bool = False


def left_counts(base: DataFrame, key: str, *branches: Branch) -> DataFrame:
    """``base LEFT JOIN a LEFT JOIN b … GROUP BY base row`` with one count per branch.

    Each branch is reduced to one row per key before it meets the others. The result
    is that of the plain joins, whose rows per key are the product of the branch sizes;
    that product is computed, never built.
    """
    joined = base
    sizes: list[Column] = []
    for i, b in enumerate(branches):
        value = F.count_distinct(F.col(b.column)) if b.distinct else F.count(F.col(b.column))
        reduced = (
            b.rows.filter(F.col(b.key).isNotNull())
            .groupBy(F.col(b.key).alias(f"_k{i}"))
            .agg(value.alias(f"_n{i}"), F.count(F.lit(1)).alias(f"_rows{i}"))
        )
        joined = joined.join(reduced, joined[key] == reduced[f"_k{i}"], "left")
        # A branch without a match still contributes its one null row.
        sizes.append(F.coalesce(F.col(f"_rows{i}"), F.lit(1)))
    counts = []
    for i, b in enumerate(branches):
        total = F.coalesce(F.col(f"_n{i}"), F.lit(0))
        if not b.distinct:
            for j, size in enumerate(sizes):
                total = total * size if j != i else total
        counts.append(total.cast("bigint").alias(b.name))
    return joined.select(*base.columns, *counts)


def agg_star(base: DataFrame, key: str, grouped: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """``SELECT base.*, aggregates … GROUP BY base.key``: aggregate first, then join back.

    ``grouped`` has one row per key; ``defaults`` fills the aggregates of keys it lacks. An
    aggregate that is null for a key it has stays null, as in SQL.
    """
    marked = grouped.withColumn("_grouped", F.lit(True))
    lacking = F.col("_grouped").isNull()
    filled = [
        F.when(lacking, F.lit(defaults[c])).otherwise(F.col(f"_g.{c}")).alias(c)
        if c in defaults
        else F.col(f"_g.{c}")
        for c in grouped.columns
        if c != key
    ]
    joined = base.alias("_b").join(marked.alias("_g"), key, "left")
    return joined.select(*[key if c == key else F.col(f"_b.{c}") for c in base.columns], *filled)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows; each task keeps only ``k``. ``order`` must be total."""
    return df.orderBy(*order).limit(k)


def since(column: Column, as_of: datetime | str, days: int) -> Column:
    """``column >= as_of - n days``; a constant bound the scan can push down."""
    start = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else F.lit(as_of)
    return column >= start - F.make_dt_interval(F.lit(days))


def contains(column: Column, text: str) -> Column:
    """Case-insensitive contains; wildcards in ``text`` match as in ILIKE."""
    return column.ilike(f"%{text}%")


def optional_eq(column: Column, value: object) -> Column:
    """``value IS NULL OR column = value``."""
    return F.lit(True) if value is None else column == F.lit(value)


def page(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    n: int,
    offset: int = 0,
    after: Mapping[str, object] | None = None,
) -> DataFrame:
    """At most ``n`` rows in ``order``, (column, descending) pairs that form a total order.

    ``after`` holds the order columns of the last row already seen; the next page then
    costs the same however deep it is. An ``offset`` sorts the rows into ranges once, and
    then only the ranges that the page touches.
    """
    if after is not None:
        if offset:
            raise ValueError("use either offset or after")
        df = df.filter(_later(order, after))
    by = [F.desc(c) if d else F.asc(c) for c, d in order]
    if offset:
        ranged = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
        sizes = {r._range: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
        before, wanted = 0, []
        for number in sorted(sizes):
            if before < offset + n and before + sizes[number] > offset:
                wanted.append((number, before))
            before += sizes[number]
        first = wanted[0][1] if wanted else before
        df = ranged.filter(F.col("_range").isin(*[w for w, _ in wanted])).drop("_range")
        offset -= first if wanted else 0
    sorted_df = df.orderBy(*by)
    return (sorted_df.offset(offset) if offset else sorted_df).limit(n)


def _later(order: Sequence[tuple[str, bool]], after: Mapping[str, object]) -> Column:
    """Rows behind ``after``: nulls come first ascending and last descending."""
    reached = F.lit(False)
    same = F.lit(True)
    for name, descending in order:
        col, value = F.col(name), after[name]
        if value is None:
            beyond = F.lit(False) if descending else col.isNotNull()
        elif descending:
            beyond = (col < F.lit(value)) | col.isNull()
        else:
            beyond = col > F.lit(value)
        reached = reached | (same & F.coalesce(beyond, F.lit(False)))
        same = same & col.eqNullSafe(F.lit(value))
    return reached

"""Query output in the shape the caller declared."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.parse import ISO_ZONE, typed
from tidelake.specs import ResponseSpec


def iso_text(value: Column, kind: T.DataType) -> Column:
    """A timestamp, or text that holds one, as ISO 8601 with a zone."""
    if isinstance(kind, T.StringType):
        joined = F.regexp_replace(value, "^([^T ]*) ", "$1T")
        return F.when(joined.rlike(ISO_ZONE), joined).otherwise(F.concat(joined, F.lit("Z")))
    return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Rewrite the named datetime columns as ISO 8601 text; others are untouched."""
    wanted = set(fields)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[iso_text(F.col(c), kinds[c]).alias(c) if c in wanted else F.col(c) for c in df.columns]
    )


def shape(
    df: DataFrame, response: ResponseSpec, iso_dates: bool = False, single: bool = False
) -> DataFrame:
    """Declared fields only, in declared case and type.

    Columns match without regard to case but spelling counts (``total_orders`` is not
    ``totalOrders``). Of several columns with one name the last wins. A required field
    without a column is an error here, an optional one is null. ``single`` keeps the
    first row.
    """
    # Positional names first: a join's SELECT * can repeat a name.
    unique = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    position = {name.lower(): i for i, name in enumerate(df.columns)}
    absent = [f.name for f in response.fields if f.required and f.name.lower() not in position]
    if absent:
        raise ValueError(f"{response.name}: the query has no column for {', '.join(absent)}")
    cols = []
    for f in response.fields:
        at = position.get(f.name.lower())
        if at is None:
            cols.append(F.lit(None).cast(f.data_type).alias(f.name))
            continue
        value, kind = F.col(f"_c{at}"), df.schema.fields[at].dataType
        if f.kind == "AWSDateTime" and iso_dates and not f.is_list:
            value = iso_text(value, kind)
        elif isinstance(kind, T.StringType) or f.is_list:
            value = typed(value, kind, f)
        else:
            value = value.cast(f.data_type)
        cols.append(value.alias(f.name))
    shaped = unique.select(*cols)
    return shaped.limit(1) if single else shaped

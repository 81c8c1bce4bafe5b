"""Text to typed values. Nothing here raises on bad input; bad input becomes null."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.specs import Field

# Fixed value: how a zone at the end of ISO 8601 text looks.
ISO_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def iso_timestamp(text: Column) -> Column:
    """ISO text as a timestamp; text without a zone is UTC whatever the session says.

    Only the date separators are checked here, the parser rejects the rest. Without
    that check a bare year would read as a timestamp.
    """
    date_only = F.length(text) == 10
    shaped = (
        (F.substring(text, 5, 1) == "-")
        & (F.substring(text, 8, 1) == "-")
        & (date_only | F.substring(text, 11, 1).isin("T", " "))
    )
    zoned = (
        F.when(text.endswith("Z"), text)
        .when(date_only, F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(ISO_ZONE), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.when(shaped, F.try_to_timestamp(zoned))


def instant(now: datetime | str | Column) -> Column:
    """A point in time as a column: datetimes without a zone are UTC."""
    if isinstance(now, Column):
        return now
    if isinstance(now, str):
        return iso_timestamp(F.lit(now))
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    return F.lit(now.astimezone(timezone.utc).isoformat()).cast("timestamp")


def scalar_from_text(text: Column, kind: str) -> Column:
    """One declared scalar from its text form."""
    if kind == "Int":
        # Through a decimal, so '4.9' truncates to 4 and '1e3' is 1000.
        return text.try_cast("decimal(38,10)").try_cast("bigint")
    if kind == "Float":
        number = text.try_cast("double")
        return F.when(~F.isnan(number), number)
    if kind == "Boolean":
        return text.try_cast("boolean")
    if kind == "AWSDateTime":
        return iso_timestamp(text)
    if kind == "Binary":
        return F.try_to_binary(text, F.lit("base64"))
    return text


def typed(raw: Column, raw_type: T.DataType, field: Field) -> Column:
    """``raw`` as the declared type of ``field``.

    Columns that already have the type pass through; anything else goes by way of
    text. A scalar never becomes a list nor a list a scalar.
    """
    if raw_type == field.data_type:
        return raw
    if isinstance(raw_type, T.TimestampNTZType) and field.kind == "AWSDateTime":
        return raw.cast("timestamp")
    if field.is_list != isinstance(raw_type, T.ArrayType):
        return F.lit(None).cast(field.data_type)
    if field.is_list:
        return F.transform(raw, lambda x: scalar_from_text(x.cast("string"), field.kind))
    return scalar_from_text(raw.cast("string"), field.kind)


def lost_in_cast(raw: Column, value: Column, field: Field) -> Column:
    """True where a given value did not survive the cast."""
    if field.is_list:
        dropped = F.size(F.filter(raw, lambda x: x.isNotNull())) > F.size(
            F.filter(value, lambda x: x.isNotNull())
        )
        return raw.isNotNull() & (value.isNull() | dropped)
    return raw.isNotNull() & value.isNull()


def names_where(flags: list[tuple[str, Column]]) -> Column:
    """Array of the names whose flag is true.

    Set difference rather than ``array_compact``, which is a lambda underneath and would
    evaluate every flag outside generated code.
    """
    if not flags:
        return F.array().cast("array<string>")
    texts = F.array(*[F.when(flag, F.lit(name)) for name, flag in flags])
    return F.array_except(texts, F.array(F.lit(None).cast("string")))

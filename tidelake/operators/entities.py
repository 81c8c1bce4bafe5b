"""Applying changes to entity tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.ids import stable_uuid
from tidelake.functions.parse import instant, names_where, typed
from tidelake.operators.ingest import REMOVE
from tidelake.sources.feeds import CHANGE_ORDER
from tidelake.specs import EntitySpec, Field


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def last_change(
    changes: DataFrame, key: str | Sequence[str], order: Iterable[str] = CHANGE_ORDER
) -> DataFrame:
    """One row per key: the change that is last in ``order``, removals included.

    ``max_by`` is reduced on the map side, so a key with most of the rows still
    sends one row per input task. ``order`` must be total.
    """
    keys = _names(key)
    whole = F.struct(*[F.col(c) for c in changes.columns])
    picked = changes.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_last"))
    return picked.select("_last.*")


def latest(
    changes: DataFrame, key: str | Sequence[str], order: Iterable[str] = CHANGE_ORDER
) -> DataFrame:
    """State after all changes: keys whose last change is a removal are gone."""
    return last_change(changes, key, order).filter(F.col("op") != REMOVE)


def upsert(
    table: DataFrame,
    changes: DataFrame,
    key: str | Sequence[str],
    order: Iterable[str] = CHANGE_ORDER,
) -> DataFrame:
    """``table`` with a batch of changes applied; replaying the batch changes nothing.

    Only the batch is aggregated. The table itself is anti-joined against the changed
    keys, so it is not shuffled while those fit the broadcast threshold.
    """
    keys = _names(key)
    last = last_change(changes, keys, order)
    kept = table.join(last.select(*keys), keys, "left_anti")
    alive = last.filter(F.col("op") != REMOVE)
    return kept.unionByName(alive.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``table`` without the given keys."""
    names = _names(key)
    return table.join(keys.select(*names), names, "left_anti")


def delete_ack(keys: DataFrame, key: str = "id") -> DataFrame:
    """Every requested key is reported deleted, known or not."""
    return keys.select(key).withColumn("deleted", F.lit(True))


def create(
    rows: DataFrame,
    spec: EntitySpec,
    now: datetime | str | Column,
    request_key: Sequence[str] | None = None,
) -> DataFrame:
    """New rows: fresh id, both timestamps set to ``now`` whatever the input says.

    With ``request_key`` the id follows from those input columns, so a retried task or
    a repeated request yields the same rows. Without it ids are random.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    cols = []
    for f in spec.input_fields("create"):
        value = typed(F.col(f.name), kinds[f.name], f) if f.name in kinds else F.lit(None)
        cols.append(value.cast(f.data_type).alias(f.name))
    if request_key:
        new_id = stable_uuid(F.lit(spec.table), *[F.col(c).cast("string") for c in request_key])
    else:
        new_id = F.uuid()
    made = rows.select(new_id.alias(spec.key), *cols)
    stamped = made.withColumns({"createdAt": instant(now), "updatedAt": instant(now)})
    return stamped.select(*spec.columns)


def read(table: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows with the given ids, and the ids that name no row.

    The ids are compared with what was found, so the table is not shuffled for them.
    """
    wanted = ids.select(key).distinct()
    found = table.join(wanted, key, "left_semi")
    return found, wanted.join(found.select(key), key, "left_anti")


def read_strict(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """As ``read``, but a missing id is an error."""
    found, missing = read(table, ids, key)
    unknown = missing.first()
    if unknown is not None:
        raise LookupError(f"not found: {key}={unknown[0]!r}")
    return found


def fold_patches(
    patches: DataFrame, fields: Iterable[Field], key: str = "id", order: Iterable[str] = CHANGE_ORDER
) -> DataFrame:
    """All patches of one key as one: per field the last value that was supplied.

    ``_present`` lists the fields a patch names; naming a field with null stores null.
    """
    seq = F.struct(*order)
    aggs = []
    for f in fields:
        given = F.array_contains("_present", f.name)
        if f.name in patches.columns:
            value = F.expr(
                f"max_by(`{f.name}`, struct({', '.join(order)}))"
                f" FILTER (WHERE array_contains(_present, '{f.name}'))"
            )
            aggs += [value.alias(f.name), F.max(given).alias(f"_has_{f.name}")]
    return patches.groupBy(key).agg(*aggs, F.max(seq).alias("_seq"))


def _updatable(spec: EntitySpec, patches: DataFrame) -> list[Field]:
    return [f for f in spec.input_fields("update") if f.name in patches.columns]


def patch(
    table: DataFrame,
    patches: DataFrame,
    spec: EntitySpec,
    now: datetime | str | Column | None = None,
    order: Sequence[str] = CHANGE_ORDER,
) -> tuple[DataFrame, DataFrame]:
    """Set only the supplied fields of known rows; returns the table and unknown keys.

    ``updatedAt`` becomes ``now``, or the time of the last patch when left out;
    ``createdAt`` never moves.
    """
    fields = _updatable(spec, patches)
    folded = fold_patches(patches, fields, spec.key, order)
    stamp = instant(now) if now is not None else F.col(f"_seq.{order[0]}").cast("timestamp")
    changed = folded.select(
        spec.key,
        F.struct(
            *[F.col(f.name) for f in fields],
            *[F.col(f"_has_{f.name}") for f in fields],
            stamp.alias("updatedAt"),
        ).alias("_p"),
    )
    set_fields = {f.name for f in fields}

    def merged(column: str) -> Column:
        if column in set_fields:
            supplied = F.coalesce(F.col(f"_p._has_{column}"), F.lit(False))
            return F.when(supplied, F.col(f"_p.{column}")).otherwise(F.col(column)).alias(column)
        if column == "updatedAt":
            return F.coalesce(F.col("_p.updatedAt"), F.col(column)).alias(column)
        return F.col(column)

    joined = table.join(changed, spec.key, "left")
    asked = folded.select(spec.key)
    known = table.select(spec.key).join(asked, spec.key, "left_semi")
    unknown = asked.join(known, spec.key, "left_anti")
    return joined.select(*[merged(c) for c in table.columns]), unknown


def patch_ack(
    patches: DataFrame,
    spec: EntitySpec,
    now: datetime | str | Column | None = None,
    order: Sequence[str] = CHANGE_ORDER,
) -> DataFrame:
    """What an update returns: the key, the supplied fields and ``updatedAt``.

    ``_present`` says which of the fields were supplied in at least one patch.
    """
    fields = _updatable(spec, patches)
    folded = fold_patches(patches, fields, spec.key, order)
    stamp = instant(now) if now is not None else F.col(f"_seq.{order[0]}").cast("timestamp")
    named = names_where([(f.name, F.col(f"_has_{f.name}")) for f in fields])
    return folded.select(
        spec.key, *[f.name for f in fields], stamp.alias("updatedAt"), named.alias("_present")
    )


def cascade_keys(
    changes: DataFrame, key: str = "id", order: str = "ts"
) -> DataFrame:
    """One (entityType, entityId, timestamp) per deleted entity.

    Takes decoded, entity-routed changes; run records, relations and edges send none.
    """
    removed = changes.filter(F.col("op") == REMOVE)
    return removed.groupBy(
        F.lower("entityType").alias("entityType"), F.col(key).cast("string").alias("entityId")
    ).agg(F.max(order).alias("timestamp"))

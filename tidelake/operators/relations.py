"""Many-to-many tables: ids, insert-if-absent, edges, deletes, cascades."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.ids import complete, relation_id, storage_key
from tidelake.functions.parse import instant, typed
from tidelake.session import cut
from tidelake.specs import RelationSpec

ID = "relationId"
EDGE_KEY = ("relatedEntityType", "relatedEntityId")


@dataclass(frozen=True)
class Inserted:
    """Outcome of an insert: rows to append, repeats, and rows without all members."""

    rows: DataFrame
    repeats: DataFrame
    rejected: DataFrame


def _members(
    spec: RelationSpec, batch: DataFrame, now: datetime | str | Column | None
) -> DataFrame:
    """Declared member columns, typed, and the creation time of each association."""
    if "createdAt" in batch.columns:
        created = F.col("createdAt").cast("timestamp")
        created = created if now is None else F.coalesce(created, instant(now))
    elif now is not None:
        created = instant(now)
    else:
        raise ValueError("pass now: the batch carries no createdAt")
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    declared = {f.name: f for f in spec.fields}
    return batch.select(
        *[typed(F.col(c), kinds[c], declared[c]).alias(c) for c in spec.members],
        created.alias("createdAt"),
    )


def packed(spec: RelationSpec, rows: DataFrame) -> DataFrame:
    """The rows without ids and keys that follow from their members, which ``unpacked`` gives back.

    Both are most of a row and hardly compress, so a shuffle of whole rows moves them packed.
    Those that do not follow, as records may carry their own, stay.
    """
    key = storage_key(spec, F.col("createdAt"), F.col(ID))
    return rows.withColumns(
        {"_id": F.col(ID).eqNullSafe(relation_id(spec)), "_key": F.col("s3Key").eqNullSafe(key)}
    ).withColumns({c: F.when(~F.col(f), F.col(c)) for c, f in ((ID, "_id"), ("s3Key", "_key"))})


def unpacked(spec: RelationSpec, rows: DataFrame) -> DataFrame:
    """What was ``packed``, with its own ids and keys."""
    rows = rows.withColumn(ID, F.when(F.col("_id"), relation_id(spec)).otherwise(F.col(ID)))
    key = storage_key(spec, F.col("createdAt"), F.col(ID))
    rows = rows.withColumn("s3Key", F.when(F.col("_key"), key).otherwise(F.col("s3Key")))
    return rows.drop("_id", "_key")


def _derived(spec: RelationSpec, members: DataFrame) -> DataFrame:
    """Add what follows from the members: the id and the storage key."""
    rows = members if ID in members.columns else members.withColumn(ID, relation_id(spec))
    key = storage_key(spec, F.col("createdAt"), F.col(ID))
    return rows.withColumn("s3Key", key).select(*spec.columns)


def relation_rows(
    spec: RelationSpec, batch: DataFrame, now: datetime | str | Column | None = None
) -> DataFrame:
    """Rows of the declared relation table for a batch of member values.

    Only declared columns are kept. Creation time is the batch's own ``createdAt``
    where it has one, else ``now``.
    """
    return _derived(spec, _members(spec, batch, now))


def first_per_relation(spec: RelationSpec, members: DataFrame) -> DataFrame:
    """The earliest row of each association, reduced before the shuffle.

    Members tell associations apart as their id does, so they are the grouping key and
    aggregation is by hash. Two cases need the id itself, and a sort: members of one
    type, which come in two orders, and text with the id's separator in it, which could
    spell one id in two ways.
    """
    names = list(spec.members)
    if len(set(spec.members.values())) < len(names) and not spec.directed:
        return _first_by_id(spec, members)
    ambiguous = F.lit(False)
    for f in members.schema.fields:
        if f.name in names and isinstance(f.dataType, T.StringType):
            ambiguous = ambiguous | F.col(f.name).contains("|")

    def by_members(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*names).agg(F.min("createdAt").alias("createdAt"))

    if not any(isinstance(members.schema[n].dataType, T.StringType) for n in names):
        return by_members(members)
    rest = _first_by_id(spec, members.filter(ambiguous)).drop(ID)
    return by_members(members.filter(~ambiguous)).unionByName(rest)


def _first_by_id(spec: RelationSpec, members: DataFrame) -> DataFrame:
    row = F.struct("createdAt", *spec.members)
    picked = members.groupBy(relation_id(spec).alias(ID)).agg(F.min(row).alias("_first"))
    return picked.select(ID, "_first.*")


def insert(
    spec: RelationSpec,
    batch: DataFrame,
    existing: DataFrame | None = None,
    now: datetime | str | Column | None = None,
    reuse: bool = True,
) -> Inserted:
    """Insert if absent; the earliest of several repeats in a batch is kept.

    The stored table is only probed for the ids of the batch, one narrow column and no
    shuffle while those ids fit the broadcast threshold; the much smaller answer is
    then taken out of the batch. ``reuse`` stores the members of the reduced batch and
    that answer, which both outcomes need, and so makes their sizes known.
    """
    members = _members(spec, batch, now)
    whole = complete(spec)
    first = first_per_relation(spec, members.filter(whole))
    rejected = members.filter(~whole)
    if existing is None:
        rows = _derived(spec, first)
        return Inserted(rows, rows.filter(F.lit(False)), rejected)
    if reuse:
        first = cut(first)
        if existing.isEmpty():
            rows = _derived(spec, first)
            return Inserted(rows, rows.filter(F.lit(False)), rejected)
    if ID not in first.columns:
        first = first.withColumn(ID, relation_id(spec))
    present = existing.select(ID).join(first.select(ID), ID, "left_semi")
    if reuse:
        present = cut(present)
    rows, repeats = (first.join(present, ID, how) for how in ("left_anti", "left_semi"))
    return Inserted(_derived(spec, rows), _derived(spec, repeats), rejected)


def edges(spec: RelationSpec, rel: DataFrame) -> DataFrame:
    """One row per relation and member entity.

    Relation ids are unique, so a pair of equal members collapses inside its row and
    nothing is shuffled.
    """
    members = F.array(
        *[
            F.struct(
                F.lit(kind.lower()).alias(EDGE_KEY[0]), F.col(column).cast("string").alias(EDGE_KEY[1])
            )
            for column, kind in spec.members.items()
        ]
    )
    if len(set(spec.members.values())) < len(spec.members):
        members = F.array_distinct(members)
    return rel.select(
        F.inline(members),
        ID,
        F.lit(spec.table).alias("joinTableName"),
        "s3Key",
        "createdAt",
    )


def edges_of(all_edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Every edge of the given entities."""
    return all_edges.join(entities.select(*EDGE_KEY), list(EDGE_KEY), "left_semi")


def members_of(all_edges: DataFrame, relation_ids: DataFrame) -> DataFrame:
    """Every edge of the given relations."""
    return all_edges.join(relation_ids.select(ID), ID, "left_semi")


def partners(other: DataFrame | None, on: Column | list[str] | None) -> DataFrame | None:
    """The columns that a joined table is met by, stored, so that their size is known."""
    return cut(other.select(*on)) if other is not None and isinstance(on, list) else other


def delete_targets(
    rel: DataFrame,
    where: Column | str | None = None,
    other: DataFrame | None = None,
    on: Column | list[str] | None = None,
    reuse: bool = True,
) -> DataFrame:
    """Relations a delete statement names, as (s3Key, relationId).

    ``other`` is the joined table, already filtered. It only decides which relations
    match, so one with many partners is still named once. ``reuse`` stores its ``partners``.
    """
    return _selected(rel, where, partners(other, on) if reuse else other, on).select("s3Key", ID)


def _selected(
    rel: DataFrame,
    where: Column | str | None,
    other: DataFrame | None,
    on: Column | list[str] | None,
) -> DataFrame:
    hit = rel if where is None else rel.filter(where)
    return hit if other is None else hit.join(other, on, "left_semi")


def split(
    rel: DataFrame,
    where: Column | str | None = None,
    other: DataFrame | None = None,
    on: Column | list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows a delete statement removes, and the others: those without a key always stay."""
    due = F.col("s3Key").isNotNull()
    if where is not None:
        due = due & (F.expr(where) if isinstance(where, str) else where)
    due = F.coalesce(due, F.lit(False))
    rest = rel.filter(~due)
    if other is not None:
        rest = rest.unionByName(rel.filter(due).join(other, on, "left_anti"))
    return _selected(rel.filter(due), None, other, on), rest


def apply_delete(
    rel: DataFrame, all_edges: DataFrame, targets: DataFrame, reuse: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Take the targets out of the relation and all of their edges out of the index.

    Both need them; ``reuse`` stores them once.
    """
    gone = targets.filter(F.col("s3Key").isNotNull() & F.col(ID).isNotNull()).select(ID)
    if reuse:
        gone = cut(gone)
    return rel.join(gone, ID, "left_anti"), all_edges.join(gone, ID, "left_anti")


def doomed_relations(deleted: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Distinct relations, with their table, that touch a deleted entity.

    ``deleted`` holds (entityType, entityId). Edges stay the streamed side, so adaptive
    execution can split an entity that owns most of them.
    """
    keys = deleted.select(
        F.col("entityType").alias(EDGE_KEY[0]), F.col("entityId").alias(EDGE_KEY[1])
    )
    return edges_of(all_edges, keys).select("joinTableName", ID).distinct()


def cascade(
    deleted: DataFrame,
    all_edges: DataFrame,
    rels: Mapping[str, DataFrame],
    reuse: bool = True,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Remove every relation of the deleted entities, in every table, with all its edges.

    Edges of the surviving partners go too. The set of doomed relations feeds one join
    per table; ``reuse`` stores it once instead of recomputing it for each, and before it the
    deleted, whose size is then known to the join with all edges.
    """
    if reuse:
        deleted = cut(deleted.select("entityType", "entityId"))
    doomed = doomed_relations(deleted, all_edges)
    if reuse:
        doomed = cut(doomed)
    left = {}
    for name, rel in rels.items():
        ids = doomed.filter(F.col("joinTableName") == name.lower()).select(ID)
        left[name] = rel.join(ids, ID, "left_anti")
    return all_edges.join(doomed.select(ID), ID, "left_anti"), left


def insert_counts(done: Inserted) -> DataFrame:
    """One row: how many associations an insert added and how many were stored before."""
    tagged = done.rows.select(F.lit("rows").alias("kind")).unionAll(
        done.repeats.select(F.lit("repeats").alias("kind"))
    )
    return tagged.agg(
        F.count_if(F.col("kind") == "rows").alias("inserted"),
        F.count_if(F.col("kind") == "repeats").alias("repeats"),
    )

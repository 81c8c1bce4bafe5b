"""From change records to typed, routed, dated rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.ids import legacy_key
from tidelake.functions.parse import instant, iso_timestamp, lost_in_cast, names_where, typed
from tidelake.session import cut
from tidelake.specs import PARTITIONS, EntitySpec, Field, RelationSpec

# One attribute-value record. Sets, lists and maps below the first level
# stay JSON text.
SCALARS = "S:string,N:string,BOOL:boolean,NULL:boolean,B:string"
MEMBER = f"struct<{SCALARS},SS:string,NS:string,BS:string,L:string,M:string>"
ATTRIBUTE = (
    f"struct<{SCALARS},SS:array<string>,NS:array<string>,BS:array<string>,"
    f"L:array<{MEMBER}>,M:map<string,{MEMBER}>>"
)
# Attribute names that control routing; decoded next to the declared fields.
SYSTEM_FIELDS = (
    "PK",
    "SK",
    "entityType",
    "joinTable",
    "joinTableName",
    "relationId",
)
REMOVE = "REMOVE"


# The three below are SQL text: one parsed expression per field instead of dozens of
# column calls, which would cost more than the job on a small batch.
def _member_text(m: str) -> str:
    """Text of one list member or map value; what is nested deeper stays JSON."""
    scalar = f"{m}.S, {m}.N, cast({m}.BOOL as string), {m}.B"
    return f"coalesce({scalar}, {m}.SS, {m}.NS, {m}.BS, {m}.L, {m}.M)"


def _members(a: str) -> Column:
    """A list or a set as an array of texts."""
    return F.expr(
        f"coalesce(transform({a}.L, m -> {_member_text('m')}), {a}.SS, {a}.NS, {a}.BS)"
    )


def _plain_text(a: str) -> Column:
    """Text of a whole attribute: scalars as they are; sets, lists and maps as plain JSON."""
    return F.expr(
        f"coalesce({a}.S, {a}.N, cast({a}.BOOL as string), {a}.B,"
        f" to_json({a}.SS), to_json({a}.NS), to_json({a}.BS),"
        f" to_json(transform({a}.L, m -> {_member_text('m')})),"
        f" to_json(transform_values({a}.M, (k, m) -> {_member_text('m')})))"
    )


def _value(a: str, field: Field) -> Column:
    """A parsed attribute as ``decode`` gives it."""
    if field.name in SYSTEM_FIELDS:
        return F.col(f"{a}.S")
    return _members(a) if field.is_list else _plain_text(a)


def pick_image(df: DataFrame) -> DataFrame:
    """Add ``image``: the old one for a removal, the new one otherwise."""
    return df.withColumn(
        "image", F.when(F.col("op") == REMOVE, F.col("old_image")).otherwise(F.col("new_image"))
    )


def decode(
    df: DataFrame, fields: Iterable[Field], image: str = "image", presence: bool = False
) -> DataFrame:
    """Attribute-value JSON to one plain column per declared field.

    Only declared attributes are parsed. Values stay text (lists: arrays of text)
    until ``enforce`` types them. With ``presence`` a ``_present`` array lists the
    fields an image names, which tells an explicit null from an absent field.
    """
    fields = list(fields)
    cols = [c for c in df.columns if c != image and c not in {f.name for f in fields}]
    parsed = _parse(df, fields, image, cols)
    values = [_value(f"_a{i}", f).alias(f.name) for i, f in enumerate(fields)]
    named = []
    if presence:
        flags = [(f.name, F.col(f"_a{i}").isNotNull()) for i, f in enumerate(fields)]
        named = [names_where(flags).alias("_present")]
    return parsed.select(*cols, *values, *named)


def _parse(df: DataFrame, fields: list[Field], image: str, keep: list[str]) -> DataFrame:
    """Attributes ``_a0``, ``_a1``… of each image, parsed once per row.

    ``inline`` keeps the optimizer from repeating ``from_json`` inside every later
    expression and filter that reads one of the attributes.
    """
    kinds = ("struct<S:string>" if f.name in SYSTEM_FIELDS else ATTRIBUTE for f in fields)
    wanted = ",".join(f"`{f.name}`:{kind}" for f, kind in zip(fields, kinds, strict=True))
    names = [f"_a{i}" for i in range(len(fields))]
    whole = F.array(F.from_json(F.col(image), f"struct<{wanted}>"))
    return df.select(*keep, F.inline(whole).alias(*names))


def enforce(df: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """Cast every declared field; ``_cast_errors`` names the ones that were lost.

    A value that cannot be cast becomes null and never fails the job.
    """
    fields = list(fields)
    names = {f.name for f in fields}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cast = {
        f.name: typed(F.col(f.name), kinds[f.name], f) if f.name in kinds else F.lit(None).cast(f.data_type)
        for f in fields
    }
    given = {f.name for f in fields if f.name in kinds and kinds[f.name] != f.data_type}
    others = [c for c in df.columns if c not in names]
    # Cast first, compare with the raw value after, so no cast is written out twice.
    both = df.select(
        *others,
        *[cast[f.name].alias(f.name) for f in fields],
        *[F.col(n).alias(f"_raw_{n}") for n in given],
    )
    lost = [
        (f.name, lost_in_cast(F.col(f"_raw_{f.name}"), F.col(f.name), f))
        for f in fields
        if f.name in given
    ]
    return both.select(*others, *[f.name for f in fields], names_where(lost).alias("_cast_errors"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split enforced rows into clean ones and ones with cast errors."""
    clean = F.size("_cast_errors") == 0
    return df.filter(clean).drop("_cast_errors"), df.filter(~clean)


def required_violations(df: DataFrame, spec: EntitySpec | RelationSpec) -> DataFrame:
    """Key and names of the required fields each offending row leaves null."""
    nulls = [(f.name, F.col(f.name).isNull()) for f in spec.fields if f.required]
    missing = names_where(nulls)
    return df.select(F.col(spec.key), missing.alias("missing")).filter(F.size("missing") > 0)


def split_required(
    df: DataFrame, spec: EntitySpec | RelationSpec
) -> tuple[DataFrame, DataFrame]:
    """Changes with all required fields, and the others with ``_cast_errors`` naming them.

    A removal needs its key only, and the dates that writing sets are not asked for.
    """
    return quarantine(df.withColumn("_cast_errors", _missing(spec, F.col, F.col("op"))))


def _missing(
    spec: EntitySpec | RelationSpec, value: Callable[[str], Column], op: Column
) -> Column:
    """Names of the required fields a change lacks."""
    asked = [f for f in spec.fields if f.required and f.name not in ("createdAt", "updatedAt")]
    missing = names_where([(f.name, value(f.name).isNull()) for f in asked])
    return F.when(op == REMOVE, F.array().cast("array<string>")).otherwise(missing)


def sound(typed: DataFrame, spec: EntitySpec | RelationSpec) -> tuple[DataFrame, DataFrame]:
    """Typed changes that can be applied, and the others with what is wrong with them."""
    clean, bad = quarantine(cut(typed))
    whole, lacking = split_required(clean, spec)
    return whole, bad.unionByName(lacking)


def infer_kinds(df: DataFrame, image: str = "image") -> DataFrame:
    """``name, kind, is_list``: a declared type for every attribute that occurs.

    A column is a timestamp only when every given value is ISO text that parses; a
    number column is integral only when no value has a point. Everything mixed is text.
    Counts are reduced on the map side; however many names there are, none is collected.
    """
    entries = df.select(F.explode(F.from_json(F.col(image), f"map<string,{ATTRIBUTE}>")))
    a = F.col("value")
    counts = entries.groupBy(F.col("key").alias("name")).agg(
        F.count(F.when(~F.coalesce(a.NULL, F.lit(False)), 1)).alias("given"),
        F.count(iso_timestamp(a.S)).alias("times"),
        F.count(a.N).alias("numbers"),
        F.count(F.when(a.N.contains("."), 1)).alias("fractions"),
        F.count(a.BOOL).alias("flags"),
        F.count(a.L).alias("lists"),
    )
    given = F.col("given") > 0
    kind = (
        F.when(given & (F.col("times") == F.col("given")), "AWSDateTime")
        .when(
            given & (F.col("numbers") == F.col("given")),
            F.when(F.col("fractions") > 0, "Float").otherwise("Int"),
        )
        .when(given & (F.col("flags") == F.col("given")), "Boolean")
        .otherwise("String")
    )
    return counts.select(
        "name", kind.alias("kind"), (given & (F.col("lists") == F.col("given"))).alias("is_list")
    )


def infer_fields(df: DataFrame, names: list[str], image: str = "image") -> list[Field]:
    """Declared types of the named attributes, in that order; text where none occurs."""
    found = infer_kinds(df, image).filter(F.col("name").isin(*names) if names else F.lit(False))
    kinds = {r["name"]: Field(r["name"], r.kind, is_list=r.is_list) for r in found.collect()}
    return [kinds.get(n, Field(n, "String")) for n in names]


def infer(df: DataFrame, names: list[str], image: str = "image") -> DataFrame:
    """Images that come without any declaration: the named attributes typed by ``infer_fields``.

    All others stay together as text in one map, ``_others``, so attribute names that come
    from data never become columns.
    """
    rest = F.from_json(F.col(image), "map<string,string>")
    if not names:
        return df.withColumn("_others", rest).drop(image).withColumn(
            "_cast_errors", F.array().cast("array<string>")
        )
    fields = infer_fields(df, names, image)
    others = F.map_filter(rest, lambda k, v: ~k.isin(*names))
    return enforce(decode(df.withColumn("_others", others), fields, image), fields)


def _created(df: DataFrame, column: str, now: datetime | str | Column) -> Column:
    if column not in df.columns:
        return instant(now)
    value = F.col(column)
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        value = iso_timestamp(value)
    return F.coalesce(value.cast("timestamp"), instant(now))


def with_partitions(
    df: DataFrame, now: datetime | str | Column, column: str = "createdAt", prefix: str = ""
) -> DataFrame:
    """Zero-padded UTC year, month and day of creation.

    A missing or unreadable creation time falls back to the processing time ``now``.
    """
    created = _created(df, column, now)
    formats = zip(PARTITIONS, ("yyyy", "MM", "dd"), strict=True)
    return df.withColumns({prefix + name: F.date_format(created, f) for name, f in formats})


def with_metadata(df: DataFrame, now: datetime | str | Column, column: str = "createdAt") -> DataFrame:
    """Bookkeeping columns of one batch; never part of a declared table."""
    dated = with_partitions(df, now, column, prefix="_partition_")
    return dated.withColumns(
        {"_processing_timestamp": instant(now), "_event_name": F.col("op")}
    )


def route_of() -> Column:
    """Where a decoded change goes: entity, relation, legacy_relation or dropped."""

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    kind = F.col("entityType")
    temporary = F.coalesce(F.col("PK").startswith("joinTableData#"), F.lit(False))
    named = ~(blank("joinTable") & blank("joinTableName"))
    return (
        F.when(blank("entityType") | kind.isin("task", "joinRelation"), "dropped")
        .when(temporary & (F.col("op") == REMOVE), "dropped")
        .when(temporary & ~blank("relationId") & named, "relation")
        .when(temporary, "dropped")
        .when(~blank("joinTable"), "legacy_relation")
        .otherwise("entity")
    )


def route(df: DataFrame) -> dict[str, DataFrame]:
    """Split decoded changes by destination; run records and edges are left out."""
    routed = df.withColumn("_route", route_of())
    return {
        name: routed.filter(F.col("_route") == name).drop("_route")
        for name in ("entity", "relation", "legacy_relation")
    }


def dealt(
    df: DataFrame, entities: Iterable[EntitySpec], relations: Iterable[RelationSpec]
) -> DataFrame:
    """Change records for many tables in one pass: each image is parsed once, for the fields of
    all tables, and typed as its own table only.

    ``_slot`` numbers the tables, entities first; records of a name that is not declared as
    what they say they are have -1, and only these keep their image. ``_t<slot>`` holds the
    fields as ``typed_changes`` and ``relation_changes`` type them, and as ``_cast_errors``
    what is wrong with them; ``_sound`` tells whether nothing is, as ``sound`` would.
    Stored by slot and soundness, each table reads its own rows and no others.
    """
    specs = [*entities, *relations]
    picked = pick_image(df).drop("key", "old_image", "new_image")
    system = [Field(n, "String") for n in SYSTEM_FIELDS]
    declared = {f.name: f for s in specs for f in s.fields if f.name not in SYSTEM_FIELDS}
    wanted = [*system, *declared.values()]
    at = {f.name: f"_a{i}" for i, f in enumerate(wanted)}
    rest = [c for c in picked.columns if c != "image" and c not in SYSTEM_FIELDS]
    feed = picked.withColumns({f"_feed{i}": F.col(c) for i, c in enumerate(rest)})
    carried = [f"_feed{i}" for i in range(len(rest))]
    parsed = _parse(feed, wanted, "image", [*carried, "op", "image"])
    named = parsed.select(
        "*", *[_value(at[f.name], f).alias(f.name) for f in system]
    ).withColumn("_route", route_of()).filter(F.col("_route") != "dropped")
    is_entity = F.col("_route") == "entity"
    table = F.lower(
        F.when(is_entity, F.col("entityType")).otherwise(
            F.coalesce(F.col("joinTableName"), F.col("joinTable"))
        )
    )
    slot = F.lit(-1)
    for i, s in reversed(list(enumerate(specs))):
        due = is_entity if isinstance(s, EntitySpec) else ~is_entity
        slot = F.when(due & (F.col("_table") == s.table), F.lit(i)).otherwise(slot)
    routed = named.withColumn("_table", table).withColumn("_slot", slot)

    def own(i: int, columns: list[Column]) -> Column:
        return F.when(F.col("_slot") == i, F.struct(*columns))

    # As in ``enforce``: raw values first, casts second, what was lost third, so that nothing is
    # written out twice. The structs keep the three apart and spare a row the other tables.
    raws = [_raw_values(s, at) for s in specs]
    unknown = [*SYSTEM_FIELDS, "image", "_route", "_table"]
    raw = routed.select(
        *carried,
        "op",
        "_slot",
        own(-1, [F.col(c) for c in unknown]).alias("_unknown"),
        *[own(i, [v.alias(n) for n, v in r.items()]).alias(f"_r{i}") for i, r in enumerate(raws)],
    )
    cast = []
    for i, s in enumerate(specs):
        before = raw.schema[f"_r{i}"].dataType
        kinds = {f.name: f.dataType for f in before.fields}
        values = [typed(F.col(f"_r{i}.{f.name}"), kinds[f.name], f).alias(f.name) for f in s.fields]
        cast.append(own(i, values).alias(f"_c{i}"))
    both = raw.select("*", *cast)
    done = [
        own(i, [*(F.col(f"_c{i}.{c}") for c in s.columns), _faults(s, i, raw).alias("_cast_errors")])
        for i, s in enumerate(specs)
    ]
    checked = both.select(
        *carried, "_slot", "_unknown", *[d.alias(f"_t{i}") for i, d in enumerate(done)]
    )
    sound = F.lit(False)
    for i in range(len(specs)):
        sound = F.when(F.col("_slot") == i, F.size(f"_t{i}._cast_errors") == 0).otherwise(sound)
    return checked.select(
        *[F.col(c).alias(f"_feed_{n}") for c, n in zip(carried, rest, strict=True)],
        *checked.columns[len(carried) :],
        sound.alias("_sound"),
    )


def _raw_values(spec: EntitySpec | RelationSpec, at: dict[str, str]) -> dict[str, Column]:
    """The declared fields of one table as decoded, before any cast."""
    values = {}
    for f in spec.fields:
        values[f.name] = F.col(f.name) if f.name in SYSTEM_FIELDS else _value(at[f.name], f)
    if isinstance(spec, RelationSpec):
        values["relationId"] = _own_id()
    elif "relationId" in values:  # that of a relation, not of an entity
        values["relationId"] = F.lit(None).cast("string")
    return values


def _faults(spec: EntitySpec | RelationSpec, i: int, raw: DataFrame) -> Column:
    """What is wrong with a change: fields lost in a cast and a missing key, else the required
    fields it lacks."""
    kinds = {f.name: f.dataType for f in raw.schema[f"_r{i}"].dataType.fields}
    lost = [
        (f.name, lost_in_cast(F.col(f"_r{i}.{f.name}"), F.col(f"_c{i}.{f.name}"), f))
        for f in spec.fields
        if kinds[f.name] != f.data_type
    ]

    def value(name: str) -> Column:
        return F.col(f"_c{i}.{name}")

    wrong = F.array_union(names_where(lost), names_where([(spec.key, value(spec.key).isNull())]))
    op = value("op") if "op" in spec.columns else F.col("op")
    return F.when(F.size(wrong) > 0, wrong).otherwise(_missing(spec, value, op))


def dealt_rows(rows: DataFrame, spec: EntitySpec | RelationSpec, slot: int, sound: bool) -> DataFrame:
    """The changes of one table among what was ``dealt``: clean ones, or the others with what
    is wrong with them."""
    mine = rows.filter((F.col("_slot") == slot) & (F.col("_sound") == F.lit(sound)))
    found = mine.select(*_fed(rows, spec.columns), f"_t{slot}.*")
    return found.drop("_cast_errors") if sound else found


def dealt_unknown(rows: DataFrame) -> DataFrame:
    """The records of no declared table, images still encoded."""
    return rows.filter(F.col("_slot") == -1).select(*_fed(rows, []), "_unknown.*")


def _fed(rows: DataFrame, hidden: list[str]) -> list[Column]:
    """What came with the records beside the image, but for names that a table declares."""
    names = [c.removeprefix("_feed_") for c in rows.columns if c.startswith("_feed_")]
    return [F.col(f"_feed_{n}").alias(n) for n in names if n not in hidden]


def typed_changes(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """Change records of one entity as typed rows with ``op``, ``ts``, ``seq``, ``_cast_errors``.

    One columnar pass: pick the image, decode the declared attributes, keep this
    entity, cast. No shuffle. A row without a key is an error like a failed cast.
    """
    mine = _of_table(df, spec, ("entity",))
    return _typed(mine.drop("relationId"), spec)


def relation_changes(df: DataFrame, spec: RelationSpec) -> DataFrame:
    """Change records of one relation table, typed the same way.

    Rows written the old way have no relation id of their own; theirs is made from
    both key halves. Only those can be removed by a change record.
    """
    mine = _of_table(df, spec, ("relation", "legacy_relation"))
    return _typed(mine.withColumn("relationId", _own_id()), spec)


def _own_id() -> Column:
    """The id of a relation's record, made from both key halves where it was written the old way."""
    old = legacy_key(F.col("PK"), F.col("SK"))
    return F.when(F.col("_route") == "relation", F.col("relationId")).otherwise(old)


def _of_table(
    df: DataFrame, spec: EntitySpec | RelationSpec, routes: tuple[str, ...]
) -> DataFrame:
    """Decoded records of one table, with their system attributes and ``_route``."""
    declared = [f for f in spec.fields if f.name not in SYSTEM_FIELDS]
    images = pick_image(df).drop("key", "old_image", "new_image")
    decoded = decode(images, [Field(n, "String") for n in SYSTEM_FIELDS] + declared)
    name = F.coalesce(F.col("joinTableName"), F.col("joinTable"))
    table = F.when(route_of() == "entity", F.col("entityType")).otherwise(name)
    return decoded.withColumn("_route", route_of()).filter(
        F.col("_route").isin(*routes) & (F.lower(table) == spec.table)
    )


def _typed(rows: DataFrame, spec: EntitySpec | RelationSpec) -> DataFrame:
    hidden = [c for c in (*SYSTEM_FIELDS, "_route") if c not in spec.columns]
    keyless = names_where([(spec.key, F.col(spec.key).isNull())])
    return enforce(rows.drop(*hidden), spec.fields).withColumn(
        "_cast_errors", F.array_union("_cast_errors", keyless)
    )

"""Declarations: entities, relations, result shapes and parameterised queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Declared scalar types and the Spark types they are stored as.
SCALARS = {
    "ID": T.StringType(),
    "String": T.StringType(),
    "Int": T.LongType(),
    "Float": T.DoubleType(),
    "Boolean": T.BooleanType(),
    "AWSDateTime": T.TimestampType(),
    "Binary": T.BinaryType(),
}
# Record keys and bookkeeping attributes that never become columns.
INTERNAL = ("PK", "SK", "GSI1-PK", "GSI1-SK", "entityType", "entityId")
PARTITIONS = ("year", "month", "day")


@dataclass(frozen=True)
class Field:
    """One declared field. Types outside ``SCALARS`` (enums) are text."""

    name: str
    kind: str
    required: bool = False
    is_list: bool = False
    default: object = None

    @classmethod
    def of(cls, name: str, declared: str, default: object = None) -> Field:
        """``of("tags", "[String!]!")``: brackets mark a list, ``!`` a required field."""
        required = declared.endswith("!")
        body = declared.rstrip("!")
        is_list = body.startswith("[")
        return cls(name, body.strip("[]").rstrip("!"), required, is_list, default)

    @property
    def data_type(self) -> T.DataType:
        scalar = SCALARS.get(self.kind, T.StringType())
        return T.ArrayType(scalar) if self.is_list else scalar

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.data_type, not self.required)


def _check_stored(owner: str, names: Iterable[str]) -> None:
    """Stored columns must not look like a directory level of the table."""
    clash = [n for n in names if n.lower() in PARTITIONS or n.startswith("__")]
    if clash:
        raise ValueError(f"{owner}: {', '.join(clash)} cannot be a stored column")


def _fields(declared: Mapping[str, str]) -> tuple[Field, ...]:
    return tuple(Field.of(name, kind) for name, kind in declared.items())


def _partition_fields() -> list[T.StructField]:
    return [T.StructField(p, T.StringType()) for p in PARTITIONS]


@dataclass(frozen=True)
class EntitySpec:
    """A stored entity type: declared fields plus both timestamps, by creation date."""

    name: str
    declared: Mapping[str, str]
    key: str = "id"
    fields: tuple[Field, ...] = field(init=False)

    def __post_init__(self):
        fields = tuple(f for f in _fields(self.declared) if f.name not in INTERNAL)
        known = {f.name for f in fields}
        _check_stored(self.name, known)
        extra = (Field(n, "AWSDateTime") for n in ("createdAt", "updatedAt") if n not in known)
        object.__setattr__(self, "fields", fields + tuple(extra))

    @property
    def table(self) -> str:
        return self.name.lower()

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def schema(self, partitions: bool = True) -> T.StructType:
        fields = [f.struct_field() for f in self.fields]
        return T.StructType(fields + (_partition_fields() if partitions else []))

    def input_fields(self, mode: str = "create") -> list[Field]:
        """Columns a caller may supply; every one is optional on update."""
        if mode not in ("create", "update"):
            raise ValueError(f"mode is 'create' or 'update', not {mode!r}")
        given = [f for f in self.fields if f.name not in ("id", "createdAt", "updatedAt")]
        if mode == "update":
            given = [Field(f.name, f.kind, False, f.is_list) for f in given]
        return given


@dataclass(frozen=True)
class RelationSpec:
    """A many-to-many table: one column per member entity.

    ``members`` maps column to entity type; ``kinds`` the column to a declared
    scalar (text where absent). ``directed`` keeps (a, b) apart from (b, a) when
    two members share an entity type; the documented id format does not.
    """

    name: str
    members: Mapping[str, str]
    kinds: Mapping[str, str] = field(default_factory=dict)
    directed: bool = False
    key: str = "relationId"

    def __post_init__(self):
        if not self.members:
            raise ValueError(f"relation {self.name!r} names no member entity")
        _check_stored(self.name, self.members)

    @property
    def table(self) -> str:
        return self.name.lower()

    @property
    def fields(self) -> tuple[Field, ...]:
        own = tuple(Field.of(c, self.kinds.get(c, "String")) for c in self.members)
        return (
            Field("relationId", "ID", True),
            *own,
            Field("s3Key", "String"),
            Field("createdAt", "AWSDateTime"),
        )

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def schema(self, partitions: bool = True) -> T.StructType:
        fields = [f.struct_field() for f in self.fields]
        return T.StructType(fields + (_partition_fields() if partitions else []))


@dataclass(frozen=True)
class ResponseSpec:
    """The declared shape of a result; it has no storage."""

    name: str
    declared: Mapping[str, str]

    @property
    def fields(self) -> tuple[Field, ...]:
        return _fields(self.declared)


@dataclass(frozen=True)
class QuerySpec:
    """A named SQL statement with ``:name`` markers.

    ``params`` maps each argument to its declared type; ``defaults`` holds values
    for the ones a caller may leave out. ``iso_dates`` returns the declared datetimes as
    ISO 8601 text.
    """

    name: str
    sql: str
    params: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    returns: ResponseSpec | None = None
    is_list: bool = True
    iso_dates: bool = False

    @property
    def arguments(self) -> tuple[Field, ...]:
        return tuple(Field.of(n, k, self.defaults.get(n)) for n, k in self.params.items())

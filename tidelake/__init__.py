"""Row changes to typed, date-partitioned tables, relations and analytics, on Spark."""

from tidelake.lake import Lake
from tidelake.session import build_session, configure
from tidelake.specs import EntitySpec, Field, QuerySpec, RelationSpec, ResponseSpec

__all__ = [
    "EntitySpec",
    "Field",
    "Lake",
    "QuerySpec",
    "RelationSpec",
    "ResponseSpec",
    "build_session",
    "configure",
]

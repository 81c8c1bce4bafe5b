"""Deterministic identifiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelake.specs import RelationSpec


def _member_texts(spec: RelationSpec, cols: Mapping[str, Column]) -> list[Column]:
    """``type:value`` texts ordered by entity type, then by value.

    Entity types are known up front, so only members that share one need a sort
    at run time.
    """
    if spec.directed:
        ordered = sorted(spec.members.items(), key=lambda m: (m[1], m[0]))
        return [
            F.concat(F.lit(f"{column}:{kind.lower()}:"), cols[column]) for column, kind in ordered
        ]
    texts: list[Column] = []
    for kind in sorted(set(spec.members.values())):
        values = [cols[c] for c, k in spec.members.items() if k == kind]
        if len(values) == 2:
            values = [F.least(*values), F.greatest(*values)]
        elif len(values) > 2:
            ordered = F.sort_array(F.array(*values))
            values = [ordered[i] for i in range(len(values))]
        texts += [F.concat(F.lit(f"{kind.lower()}:"), v) for v in values]
    return texts


def complete(spec: RelationSpec, cols: Mapping[str, Column] | None = None) -> Column:
    """True where every member is given and not empty."""
    given = cols or {c: F.col(c) for c in spec.members}
    whole = F.lit(True)
    for column in spec.members:
        value = given[column]
        whole = whole & value.isNotNull()
        if spec.kinds.get(column, "String").rstrip("!") not in ("Int", "Float", "Boolean"):
            whole = whole & (value.cast("string") != "")
    return whole


def relation_id(spec: RelationSpec, cols: Mapping[str, Column] | None = None) -> Column:
    """Id of one association: hash of ``table|type:value|type:value…``.

    The same members give the same id in any column order. Null when a member is
    null or empty, so that such rows can be set aside.
    """
    given = cols or {c: F.col(c) for c in spec.members}
    texts = {c: given[c].cast("string") for c in spec.members}
    whole = F.concat_ws("|", F.lit(spec.name), *_member_texts(spec, texts))
    return F.when(complete(spec, given), F.substring(F.sha2(whole, 256), 1, 32))


def storage_key(spec: RelationSpec, created: Column, rid: Column) -> Column:
    """Logical file key of one association; the physical file holds many rows."""
    return F.concat(
        F.lit(f"tables/{spec.table}/"),
        F.date_format(created, "'year='yyyy'/month='MM'/day='dd"),
        F.lit("/"),
        rid,
        F.lit(".parquet"),
    )


def legacy_key(pk: Column, sk: Column) -> Column:
    """Key of an old association: what follows the second ``#`` of both halves."""

    def tail(half: Column) -> Column:
        parts = F.split(half, "#")
        return F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))

    return F.concat_ws("_", tail(pk), tail(sk))


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped id that a re-run of the same request gets again."""
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in cuts])

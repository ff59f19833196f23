"""``order_by`` strings to sort columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.errors import OrderError
from wordloom.plans.filterexpr import ResourceSchema, bind_filter


def parse_order(text: str | None, schema: ResourceSchema) -> list[tuple[str, bool]]:
    """Two (key, descending) pairs: those asked for, filled up with the default or the fallback."""
    if not schema.default or not schema.fallback:
        raise OrderError(f"order_by: order schema {'fallback' if schema.default else 'default primary'} key required")
    for name, (key, _) in (("order key", schema.default), ("fallback order key", schema.fallback)):
        if key not in schema.order:
            raise OrderError(f"order_by: {name} {key!r} missing from schema fields")
    out: list[tuple[str, bool]] = []
    for part in (text or "").split(","):
        words = part.split()
        if not words:
            continue
        key = words[0]
        if key not in schema.order:
            raise OrderError(f"order_by: field {key!r} cannot be used for ordering")
        if len(words) > 2:
            raise OrderError(f"order_by: invalid order segment {part.strip()!r}")
        if len(words) == 2 and words[1].lower() not in ("asc", "desc"):
            raise OrderError(f"order_by: invalid direction {words[1]!r} for field {key!r}")
        if key in (k for k, _ in out):
            raise OrderError(f"order_by: duplicate order key {key!r}")
        if len(out) == 2:
            raise OrderError("order_by: order_by supports at most two keys")
        out.append((words[0], len(words) == 2 and words[1].lower() == "desc"))
    if not out:
        out.append(schema.default)
    if len(out) == 1:
        second = schema.fallback
        if second[0] == out[0][0]:
            other = next((k for k in schema.order if k != out[0][0]), None)
            if other is None:
                raise OrderError("order_by: order schema requires at least two distinct keys for stable ordering")
            second = (other, False)
        out.append(second)
    return out


def sort_columns(text: str | None, schema: ResourceSchema, boost: Column | None = None, id_column: str = "id", columns: dict[str, str] | None = None) -> list[Column]:
    """Sort columns with nulls last but for ids, an exact match first if ``boost`` says so, and the id as tie-break."""
    out = [] if boost is None else [F.when(boost, 0).otherwise(1).asc()]
    for key, down in parse_order(text, schema):
        spec = schema.order[key]
        c = F.col((columns or {}).get(spec.column, spec.column))
        out.append((c.desc_nulls_last() if down else c.asc_nulls_last()) if spec.nulls_last else c.desc() if down else c.asc())
    return [*out, F.col(id_column).asc()]


@dataclass(frozen=True)
class BoundQuery:
    """What a request's filter and order say: values by slot, and two keys with their directions."""

    slots: dict[str, object]
    primary: tuple[str, bool]
    secondary: tuple[str, bool]

    @property
    def order_by(self) -> str:
        return ", ".join(f"{key} {'desc' if down else 'asc'}" for key, down in (self.primary, self.secondary))


def bind(filter: str | None, order_by: str | None, schema: ResourceSchema | None) -> BoundQuery:
    """Filter first, then order; errors say which of the two they are of."""
    if schema is None:
        raise ValueError("binding must not be nil")
    slots = bind_filter(filter, schema)
    return BoundQuery(slots, *parse_order(order_by, schema))

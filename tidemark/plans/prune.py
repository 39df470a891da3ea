"""Which files a scan needs: bounds from predicates, and from the optimised plan of a statement.

Catalyst has already pushed filters as far down as is sound (not across windows, limits or aggregates), so the filters that stand right
above a relation in its optimised plan are what files may be pruned by.  Only conjunctions of comparisons of the relation's own
columns with literals count, read from Catalyst's expression objects; anything else prunes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.functions.exprs import FNV_FACTOR, FNV_HIGH, FNV_LOW

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Comparisons, and what they are with their sides exchanged.
TURNED = {"GreaterThanOrEqual": "LessThanOrEqual", "GreaterThan": "LessThan", "LessThanOrEqual": "GreaterThanOrEqual", "LessThan": "GreaterThan", "EqualTo": "EqualTo"}


@dataclass(frozen=True)
class Bounds:
    """Rows with start_us <= timestamp_us < end_us, and a tenant and series if given."""

    start_us: int | None = None
    end_us: int | None = None
    tenant: str | None = None
    series: str | None = None

    @property
    def empty(self) -> bool:
        return self.start_us is not None and self.end_us is not None and self.start_us >= self.end_us


def shard_of(tenant: str, series: str, shards: int) -> int:
    """What ``shard_for`` computes, for one key on the driver."""
    framed = b"".join(len(x.encode()).to_bytes(8, "little") + x.encode() for x in (tenant, series))
    state = FNV_HIGH << 32 | FNV_LOW
    for byte in framed:
        state = ((state ^ byte) * ((1 << 40) + FNV_FACTOR)) & ((1 << 64) - 1)
    return state % shards


def wanted(segments: list[dict], bounds: Bounds, shard: int | None) -> list[dict]:
    """Segments that can hold rows within bounds."""
    if bounds.empty:
        return []
    low = LOW if bounds.start_us is None else bounds.start_us
    high = HIGH if bounds.end_us is None else bounds.end_us - 1
    return [s for s in segments if s["max_us"] >= low and s["min_us"] <= high and (shard is None or s["shard"] in (None, shard))]


def bounds_of(df: DataFrame, relation: str) -> Bounds:
    """Bounds that hold for every row that df reads of a relation, whose rows carry a column of that name; the widest of several reads."""
    found: list[Bounds] = []

    def walk(node, conditions: list) -> None:
        kind = node.getClass().getSimpleName()
        below = [node.children().apply(i) for i in range(node.children().size())]
        inner = [node.innerChildren().apply(i) for i in range(node.innerChildren().size())] if kind != "LogicalRelation" else []
        for x in inner:
            walk(x, [])
        if kind == "Filter":
            conditions = [*conditions, node.condition()]
        elif kind != "Project":
            if not below:
                output = [node.output().apply(i) for i in range(node.output().size())]
                names = {x.exprId().toString(): x.name() for x in output}
                if relation in names.values():
                    found.append(_bounds(conditions, names))
            conditions = []
        for x in below:
            walk(x, conditions)

    walk(df._jdf.queryExecution().optimizedPlan(), [])
    return _hull(found)


def _hull(found: list[Bounds]) -> Bounds:
    if not found:
        return Bounds()
    starts, ends = [b.start_us for b in found], [b.end_us for b in found]
    one = {(b.tenant, b.series) for b in found}
    tenant, series = one.pop() if len(one) == 1 else (None, None)
    return Bounds(None if None in starts else min(starts), None if None in ends else max(ends), tenant, series)


def _bounds(conditions: list, names: dict[str, str]) -> Bounds:
    """What the conditions, all true, say of columns (by expression id)."""
    low, high, equal = LOW, HIGH, {}
    stack = list(conditions)
    while stack:
        x = stack.pop()
        kind = x.getClass().getSimpleName()
        if kind == "And":
            stack += [x.left(), x.right()]
        elif kind in TURNED:
            one, two = x.left(), x.right()
            if _kind(one) == "Literal":
                one, two, kind = two, one, TURNED[kind]
            if _kind(one) != "AttributeReference" or _kind(two) != "Literal" or two.value() is None:
                continue
            name, type_name = names.get(one.exprId().toString()), two.dataType().typeName()
            if name == "timestamp_us" and type_name == "long":
                value = int(two.value())
                if kind in ("GreaterThanOrEqual", "GreaterThan", "EqualTo"):
                    low = max(low, min(value + (kind == "GreaterThan"), HIGH))
                if kind in ("LessThanOrEqual", "LessThan", "EqualTo"):
                    high = min(high, max(value - (kind == "LessThan"), LOW))
            elif name in ("tenant", "series") and kind == "EqualTo" and type_name == "string":
                equal.setdefault(name, two.value().toString())
    end = None if high == HIGH else high + 1
    return Bounds(None if low == LOW else low, end, equal.get("tenant"), equal.get("series"))


def _kind(node) -> str:
    return node.getClass().getSimpleName()

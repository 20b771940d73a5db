"""Which aggregates fit which column, and measures made from a choice."""

from __future__ import annotations

from ..sources.model import SchemaModel, split_ref
from .types import Measure

# Aggregates by role.
LEGAL = {
    "measure_additive": ("sum", "avg", "median", "min", "max"),
    "measure_nonadditive": ("avg", "median", "min", "max"),
    "measure_semiadditive": ("sum", "avg", "min", "max"),
    "duration": ("avg", "median", "min", "max"),
    "count": ("count_rows", "count_distinct"),
}


def candidates(model: SchemaModel) -> list[str]:
    """What can be measured: 'count:table', 'column:table.column', 'duration:table.start>end'."""
    out = []
    for t in model.tables.values():
        if t.hidden:
            continue
        out.append(f"count:{t.name}")
        out += [f"column:{t.name}.{c.name}" for c in t.columns.values() if c.role.startswith("measure_") and not c.hidden]
        out += [f"duration:{t.name}.{a}>{z}" for a, z in t.durations]
    return out


def legal_aggregates(model: SchemaModel, candidate: str) -> tuple[str, ...]:
    kind, _, what = candidate.partition(":")
    return LEGAL[model.column(what).role] if kind == "column" else LEGAL[kind]


def to_measure(candidate: str, agg: str, alias: str) -> Measure:
    kind, _, what = candidate.partition(":")
    if kind == "count":
        return Measure(alias, "count_rows", what, kind="count")
    if kind == "duration":
        ref, _, end = what.partition(">")
        table = split_ref(ref)[0]
        return Measure(alias, agg, table, ref, "duration", f"{table}.{end}")
    return Measure(alias, agg, split_ref(what)[0], what)

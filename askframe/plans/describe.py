"""Plans in words, and their identity regardless of labels and order."""

from __future__ import annotations

from ..language.lexicon import humanize
from .types import Measure, Predicate, QueryPlan

# Words for operators.
OPS = {"eq": "is", "neq": "is not", "in": "is one of", "not_in": "is none of", "gt": "over", "gte": "at least", "lt": "under", "lte": "at most", "between": "between", "contains": "contains", "starts_with": "starts with", "is_null": "is missing", "is_not_null": "is present", "is_true": "is true", "is_false": "is false"}


def predicate_text(p: Predicate) -> str:
    shown = " and ".join(map(str, p.values)) if p.op == "between" else ", ".join(map(str, p.values))
    return f"{humanize(p.column)} {OPS[p.op]} {shown}".strip() + (" (and below)" if p.hierarchy else "")


def measure_text(m: Measure) -> str:
    if m.column is None:
        return f"number of {humanize(m.table)}"
    words = {"sum": "total", "avg": "average", "count_rows": "number of", "count_distinct": "number of different", "min": "lowest", "max": "highest"}.get(m.agg, m.agg)
    what = f"time from {humanize(m.column)} to {humanize(m.end)}" if m.end else humanize(m.column)
    return f"{words} {what}" + (f" where {' and '.join(map(predicate_text, m.filters))}" if m.filters else "")


def narrate(plan: QueryPlan) -> str:
    """One English sentence, the same for the same plan."""
    head = ", ".join(measure_text(m) for m in plan.measures if not m.hidden) or f"{humanize(plan.subject or 'rows')}"
    out = [head[0].upper() + head[1:]]
    if plan.dimensions:
        out.append("by " + ", ".join(f"{humanize(d.table or d.column)}" + (f" ({d.grain})" if d.grain else "") for d in plan.dimensions))
    conds = [predicate_text(p) for p in plan.filters]
    conds += [("without " if e.negated else "with ") + humanize(e.table) + (f" where {' and '.join(map(predicate_text, e.filters))}" if e.filters else "") + (f" in {e.period.label}" if e.period else "") for e in plan.existence]
    if conds:
        out.append("where " + " and ".join(conds))
    if plan.window:
        out.append(f"by {humanize(plan.window.column)}, {plan.window.label}")
    if plan.having:
        out.append(f"having {measure_text(plan.having.measure)} {OPS[plan.having.op]} {' and '.join(map(str, plan.having.values))}")
    if plan.snapshot_latest:
        out.append("on the latest date")
    if plan.soft_delete:
        out.append("without deleted rows")
    if plan.include_empty:
        out.append("with empty groups")
    if plan.per_group:
        out.append(f"first {plan.per_group[1]} in each {humanize(plan.per_group[0])}")
    elif plan.limit:
        out.append(f"first {plan.limit}")
    if plan.derived:
        out.append(f"with {humanize(plan.derived)} of the rows shown")
    return "; ".join(out) + "."


def signature(plan: QueryPlan) -> tuple:
    """Equal for plans that give the same result."""

    def measure(m: Measure) -> tuple:
        return m.agg, m.table, m.column, m.end, tuple(sorted(map(repr, m.filters))), (m.period.start, m.period.end, m.period.column) if m.period else None

    window = (plan.window.column, plan.window.start, plan.window.end) if plan.window else None
    parts = (
        plan.shape if plan.shape == "lookup" else "grouped", plan.subject if plan.shape == "lookup" else None, sorted(map(repr, map(measure, plan.measures))), sorted(plan.projections),
        sorted((d.column, d.table, d.kind, d.grain or "") for d in plan.dimensions), sorted(map(repr, plan.filters)), sorted(repr((e.table, e.negated, sorted(map(repr, e.filters)), (e.period.start, e.period.end) if e.period else None)) for e in plan.existence),
        repr((measure(plan.having.measure), plan.having.op, plan.having.values)) if plan.having else None, window, plan.derived, plan.derived_window if plan.derived == "moving_average" else None,
        repr(plan.compare), [(o.by, o.descending) for o in plan.order], plan.limit, plan.per_group, plan.distinct_on, plan.distinct, plan.include_empty, plan.snapshot_latest, plan.soft_delete, sorted(plan.paths.items()),
    )
    return tuple(tuple(p) if isinstance(p, list) else p for p in parts)

"""What in a model deserves a second look."""

from __future__ import annotations

from collections import Counter

from .model import SchemaModel


def doctor(model: SchemaModel, least: float = 0.7) -> list[str]:
    out = []
    for t in model.tables.values():
        if not t.pk:
            out.append(f"{t.name}: no key; its rows can be counted only at its own grain")
        if not t.display and not t.junction:
            out.append(f"{t.name}: no display column")
        out += [f"{t.name}.{c.name}: {c.role} by {c.rule} at {c.confidence:.2f}" for c in t.columns.values() if c.confidence < least]
    pairs = Counter((r.child, r.parent) for r in model.relationships if not r.self_reference)
    out += [f"{a} -> {b}: {n} relationships; questions through them will ask which" for (a, b), n in pairs.items() if n > 1]
    out += [f"{r.id}: {r.source} at {r.confidence:.2f}" for r in model.relationships if r.confidence < least]
    return out

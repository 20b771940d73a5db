"""The model as JSON with stable key order, and whether it still fits the tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from pathlib import Path

from .model import ColumnModel, Relationship, SchemaModel, TableModel, Unit

VERSION = 1


def fingerprint(model: SchemaModel) -> str:
    """Tables, columns, types, nullability, keys and relationships; not statistics."""
    facts = sorted((t.name, c.name, c.type, c.nullable, c.name in t.pk, c.unique) for t in model.tables.values() for c in t.columns.values())
    return hashlib.sha256(json.dumps([facts, sorted(r.id for r in model.relationships)]).encode()).hexdigest()[:16]


def write_lockfile(path: str | Path, model: SchemaModel) -> None:
    body = {"version": VERSION, "fingerprint": fingerprint(model), "tables": {k: asdict(t) for k, t in model.tables.items()}, "relationships": [asdict(r) for r in model.relationships]}
    Path(path).write_text(json.dumps(body, sort_keys=True, indent=1, default=str) + "\n")


def read_lockfile(path: str | Path) -> SchemaModel:
    body = json.loads(Path(path).read_text())
    if body.get("version") != VERSION:
        raise ValueError(f"lockfile version {body.get('version')}, expected {VERSION}")
    model = SchemaModel()
    for name, t in body["tables"].items():
        cols = {n: ColumnModel(**(c | {"unit": Unit(**c["unit"]) if c["unit"] else None})) for n, c in t["columns"].items()}
        model.tables[name] = TableModel(**(t | {"columns": cols, "pk": tuple(t["pk"]), "display": tuple(t["display"]), "durations": [tuple(d) for d in t["durations"]]}))
    model.relationships = [Relationship(**(r | {"child_cols": tuple(r["child_cols"]), "parent_cols": tuple(r["parent_cols"])})) for r in body["relationships"]]
    return model


def is_stale(path: str | Path, model: SchemaModel) -> bool:
    return json.loads(Path(path).read_text())["fingerprint"] != fingerprint(model)

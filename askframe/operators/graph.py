"""The join graph: foreign keys as steps up (to the parent, N:1) and down (to the children, 1:N)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..sources.model import Relationship, SchemaModel

MAX_STEPS, MAX_UP = 4, 5


@dataclass(frozen=True)
class Step:
    rel: Relationship
    up: bool

    @property
    def source(self) -> str:
        return self.rel.child if self.up else self.rel.parent

    @property
    def target(self) -> str:
        return self.rel.parent if self.up else self.rel.child

    @property
    def safe(self) -> bool:
        """At most one row for each row it starts from."""
        return self.up or self.rel.cardinality == "1:1"


Path = tuple[Step, ...]


def downs(path: Path) -> int:
    return sum(not s.safe for s in path)


class JoinGraph:
    def __init__(self, model: SchemaModel):
        self.model = model
        self.steps: dict[str, list[Step]] = {}
        for r in model.relationships:
            if r.self_reference or model.tables[r.child].hidden or model.tables[r.parent].hidden:
                continue
            self.steps.setdefault(r.child, []).append(Step(r, True))
            self.steps.setdefault(r.parent, []).append(Step(r, False))

    def paths(self, source: str, target: str, most: int = MAX_STEPS) -> list[Path]:
        """All simple paths, those with fewest 1:N steps first, then the shortest."""
        found: list[Path] = [()] if source == target else []

        def walk(at: str, path: Path, seen: frozenset[str]) -> None:
            for s in self.steps.get(at, ()):
                if s.target in seen:
                    continue
                longer = (*path, s)
                if s.target == target:
                    found.append(longer)
                elif len(longer) < most:
                    walk(s.target, longer, seen | {s.target})

        if source != target:
            walk(source, (), frozenset({source}))
        return sorted(found, key=lambda p: (downs(p), len(p)))

    def best(self, source: str, target: str) -> list[Path]:
        all_ = self.paths(source, target)
        return [p for p in all_ if (downs(p), len(p)) == (downs(all_[0]), len(all_[0]))] if all_ else []

    def up_reachable(self, source: str, most: int = MAX_UP) -> dict[str, int]:
        """Tables that every row of source has at most one row of, with the steps there."""
        far, edge = {source: 0}, [source]
        for n in range(1, most + 1):
            edge = [s.target for t in edge for s in self.steps.get(t, ()) if s.safe and s.target not in far]
            far |= {t: n for t in edge}
        return far

    def find_root(self, anchors: Iterable[str], preferred: Iterable[str] = ()) -> str | None:
        """The table from which all anchors are N:1: a preferred one, an anchor, else the most direct bridge."""
        need = list(dict.fromkeys(anchors))
        for t in [*preferred, *need]:
            if all(a in self.up_reachable(t) for a in need):
                return t
        best = None
        for t, table in self.model.tables.items():
            far = self.up_reachable(t)
            if not table.hidden and all(a in far for a in need):
                rank = (sum(far[a] for a in need), table.junction, -(table.rows or 0), t)
                if best is None or rank < best:
                    best = rank
        return best[-1] if best else None

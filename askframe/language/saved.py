"""Accepted answers as reusable definitions: in memory or as JSON files in a folder."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .lexicon import content, stem

SCOPES = ("user", "team", "org")


@dataclass
class SavedRecord:
    id: str
    kind: str  # plan, measure
    name: str
    request: str
    body: dict
    scope: str = "user"
    owner: str = ""
    status: str = "active"  # active, canonical, deprecated, stale
    fingerprint: str = ""
    aliases: list[str] = field(default_factory=list)


def score(r: SavedRecord, text: str) -> float:
    """Shared words over the root of the record's length; canonical records get half a point."""
    doc = [stem(w) for x in (r.name, r.request, *r.aliases) for w in content(x)]
    hits = len({stem(w) for w in content(text)} & set(doc))
    return hits / math.sqrt(max(1, len(doc))) + 0.5 * (r.status == "canonical") if hits else 0.0


class MemoryStore:
    def __init__(self):
        self.records: dict[str, SavedRecord] = {}

    def search(self, text: str, kind: str | None = None, owner: str = "", k: int = 8) -> list[SavedRecord]:
        able = [r for r in self.all() if r.status in ("active", "canonical") and (kind in (None, r.kind)) and (r.scope != "user" or r.owner == owner)]
        ranked = sorted(((score(r, text), r) for r in able), key=lambda x: (-x[0], x[1].id))
        return [r for s, r in ranked if s > 0][:k]

    def get(self, id_: str) -> SavedRecord | None:
        return self.records.get(id_)

    def put(self, r: SavedRecord) -> None:
        self.records[r.id] = r

    def set_status(self, id_: str, status: str) -> None:
        self.records[id_].status = status
        self.put(self.records[id_])

    def all(self) -> list[SavedRecord]:
        return list(self.records.values())


class FolderStore(MemoryStore):
    """One JSON file for each record."""

    def __init__(self, folder: str | Path):
        super().__init__()
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        for p in sorted(self.folder.glob("*.json")):
            r = SavedRecord(**json.loads(p.read_text()))
            self.records[r.id] = r

    def put(self, r: SavedRecord) -> None:
        super().put(r)
        (self.folder / f"{r.id}.json").write_text(json.dumps(asdict(r), default=str, sort_keys=True))

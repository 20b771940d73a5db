"""The schema model: tables, columns with roles and units, relationships."""

from __future__ import annotations

from dataclasses import dataclass, field

KINDS = ("number", "text", "timestamp", "date", "boolean", "enum", "json", "interval", "array", "other")
MEASURE_ROLES = ("measure_additive", "measure_nonadditive", "measure_semiadditive")


@dataclass(frozen=True)
class Unit:
    kind: str  # money, percent, duration, weight, count
    divisor: int = 1
    detail: str = ""


@dataclass
class ColumnModel:
    name: str
    kind: str
    type: str = ""
    nullable: bool = True
    role: str = "other"
    unit: Unit | None = None
    values: list | None = None
    low: object = None
    high: object = None
    n_distinct: int | None = None
    null_share: float | None = None
    width: float | None = None
    unique: bool = False
    primary: bool = False
    pii: bool = False
    hidden: bool = False
    searchable: bool = False
    synonyms: list[str] = field(default_factory=list)
    confidence: float = 1.0
    rule: str = ""


@dataclass
class TableModel:
    name: str
    columns: dict[str, ColumnModel] = field(default_factory=dict)
    pk: tuple[str, ...] = ()
    display: tuple[str, ...] = ()
    default_time: str | None = None
    soft_delete: str | None = None
    snapshot: str | None = None
    junction: bool = False
    durations: list[tuple[str, str]] = field(default_factory=list)
    hidden: bool = False
    rows: int | None = None
    synonyms: list[str] = field(default_factory=list)

    @property
    def told_apart(self) -> bool:
        """Whether the one display column tells rows apart, but for two in a hundred."""
        if len(self.display) != 1:
            return False
        c = self.columns[self.display[0]]
        return c.unique or bool(self.rows and (c.n_distinct or 0) >= 0.98 * self.rows)


@dataclass(frozen=True)
class Relationship:
    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]
    cardinality: str = "N:1"
    source: str = "declared"
    role: str = ""
    confidence: float = 1.0

    @property
    def id(self) -> str:
        return f"{self.child}.{','.join(self.child_cols)}->{self.parent}"

    @property
    def self_reference(self) -> bool:
        return self.child == self.parent


@dataclass
class SchemaModel:
    tables: dict[str, TableModel] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)

    def column(self, ref: str) -> ColumnModel:
        table, name = split_ref(ref)
        try:
            return self.tables[table].columns[name]
        except KeyError:
            raise KeyError(f"no such column: {ref}") from None


def split_ref(ref: str) -> tuple[str, str]:
    table, _, name = ref.rpartition(".")
    return table, name

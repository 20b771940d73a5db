"""The query plan: what is asked, before any DataFrame exists."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

SHAPES = ("lookup", "single_value", "breakdown", "ranking", "trend", "distribution")
AGGREGATES = ("count_rows", "count_distinct", "sum", "avg", "median", "min", "max")
GRAINS = ("hour", "day", "week", "month", "quarter", "year")
OPERATORS = ("eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "between", "contains", "starts_with", "is_null", "is_not_null", "is_true", "is_false")
DERIVED = ("share_of_total", "running_total", "change_vs_previous", "pct_change_vs_previous", "rank", "moving_average")


@dataclass(frozen=True)
class Predicate:
    column: str  # "table.column"
    op: str
    values: tuple = ()
    implied: bool = False
    hierarchy: bool = False

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"no such operator: {self.op}")


@dataclass(frozen=True)
class Period:
    """Half-open bounds on a time column."""

    column: str
    start: datetime | None = None
    end: datetime | None = None
    label: str = ""


@dataclass(frozen=True)
class Measure:
    alias: str
    agg: str
    table: str
    column: str | None = None  # "table.column"; None counts rows
    kind: str = "column"  # column, count, duration, saved
    end: str | None = None  # duration: the later column
    filters: tuple[Predicate, ...] = ()
    period: Period | None = None
    hidden: bool = False


@dataclass(frozen=True)
class Dimension:
    alias: str
    column: str = ""
    kind: str = "column"  # column, entity, time
    grain: str | None = None
    table: str = ""  # entity


@dataclass(frozen=True)
class Existence:
    """Rows of the subject with (or without) related rows that meet the filters."""

    table: str
    negated: bool = False
    filters: tuple[Predicate, ...] = ()
    period: Period | None = None


@dataclass(frozen=True)
class Having:
    measure: Measure
    op: str
    values: tuple


@dataclass(frozen=True)
class Order:
    by: str  # a measure's, dimension's or projection's alias
    descending: bool = False


@dataclass
class QueryPlan:
    shape: str = "single_value"
    subject: str | None = None
    measures: list[Measure] = field(default_factory=list)
    projections: list[str] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    filters: list[Predicate] = field(default_factory=list)
    existence: list[Existence] = field(default_factory=list)
    having: Having | None = None
    window: Period | None = None
    derived: str | None = None
    derived_window: int = 3
    compare: tuple[Period, Period] | None = None  # current, previous
    order: list[Order] = field(default_factory=list)
    limit: int | None = None
    per_group: tuple[str, int] | None = None  # dimension alias, n
    distinct_on: tuple[str, str, bool] | None = None  # partition column, order column, descending
    distinct: bool = False
    include_empty: bool = False
    snapshot_latest: str | None = None  # date column
    soft_delete: bool = False
    paths: dict[str, tuple[str, ...]] = field(default_factory=dict)  # "from->to": relationship ids


@dataclass(frozen=True)
class Decision:
    question: str
    about: str
    value: str
    confidence: float
    load_bearing: bool = False
    by: str = "oracle"

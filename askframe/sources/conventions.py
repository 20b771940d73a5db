"""Roles, units, keys and relationships inferred from names, types and profiles, then overridden by declarations.

Every rule leaves its name and a confidence on what it decided; ``doctor`` lists the weak ones.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame

from ..language.lexicon import plural, singular, snake
from .catalog import columns_of, plain_names
from .model import ColumnModel, Relationship, SchemaModel, TableModel, Unit
from .profile import ordered_share, profile

# Names of columns by what they say of them; * stands for anything. Names are in snake case.
AUDIT = "updated_at updated_on modified_at modified_on changed_at changed_on last_update last_updated last_updates last_modified last_changed date_modified modified updated row_version *_synced_at *_loaded_at *_imported_at *_refreshed_at"
SOFT_DELETE = "deleted_at archived_at discarded_at removed_at"
ATTRIBUTE = "*_id id *code *zip *postal* *phone *year *_number number *_no *version *rank *position *sort_order lat* lng* lon* *latitude *longitude *_seq *sequence year_* *_year_*"
PERSONAL = "email e_mail phone phone_number mobile ssn social_security* dob date_of_birth birthdate birth_date line1 line2 address_line address_line? street password* ip_address token api_key secret *_email *_phone *_ssn"
TENANT = "tenant_id org_id organization_id account_id workspace_id"
# Words in names of numeric columns.
NON_ADDITIVE = "unit price rate ratio pct percent percentage score rating avg average margin age temperature temp lat lon"
SEMI_ADDITIVE = "balance on_hand stock inventory level headcount"
ADDITIVE = "amount total subtotal quantity qty count cents revenue cost fee tax shipping discount units views clicks sessions minutes seconds hours ms grams kg lbs"
MONEY = "price amount revenue cost fee"
# Stages of common life cycles; a pair in this order on one row spans a duration.
LIFECYCLES = (
    "placed ordered submitted paid shipped delivered returned",
    "opened first_response responded acknowledged resolved closed",
    "started ended finished completed",
    "created started completed",
    "requested approved fulfilled",
    "hired terminated",
    "launched discontinued",
    "issued sent viewed due paid",
    "submitted reviewed approved rejected",
    "scheduled started completed",
    "signed_up activated churned cancelled",
    "trial_started trial_ended converted",
    "applied interviewed offered hired",
)
# Own additions: flags of deletion, run-together names, further amounts of money, and what else is no measure.
MORE_SOFT_DELETE = "is_deleted deleted"
MORE_NON_ADDITIVE = "*retailprice *acctbal *csat"
MORE_ADDITIVE = "*totalprice *extendedprice *freight"
MORE_MONEY = "*totalprice *extendedprice *retailprice *acctbal total subtotal *_total tax shipping discount freight refund balance"
MORE_ATTRIBUTE = "*size *weight *length *height *width month day *_month *_day *linenumber"
MORE_PERSONAL = "*address"
#: Times of a table up to which pairs of no life cycle are sampled too.
SAMPLED_EVENTS = 5
EVENT_ORDER = ("placed", "ordered", "order", "occurred", "event", "started", "opened", "processed", "issued", "ship", "created")


def fits(name: str, *patterns: str) -> bool:
    """Whether a snake-case name is one of the names, * standing for anything."""
    return any(fnmatchcase(name, p) for some in patterns for p in some.split())


def holds(name: str, words: str) -> bool:
    """Whether one of the words stands in a snake-case name."""
    return any(f"_{w}_" in f"_{name}_" for w in words.split())


def values_of_check(check: str) -> tuple[list[str] | None, tuple[float | None, float | None]]:
    """What a CHECK condition on one column allows: listed texts, or bounds."""
    low = high = None
    if m := re.search(r"\bbetween\s+(-?[\d.]+)\s+and\s+(-?[\d.]+)", check, re.I):
        low, high = float(m[1]), float(m[2])
    for op, n in re.findall(r"([<>]=?)\s*\(?\s*(-?\d+(?:\.\d+)?)", check):
        low, high = (float(n), high) if op[0] == ">" else (low, float(n))
    listed = re.search(r"\bin\s*\(|\bany\s*\(|\barray\s*\[", check, re.I)
    texts = [t.replace("''", "'") for t in re.findall(r"'((?:[^']|'')*)'", check[listed.start() :])] if listed else []
    return texts or None, (low, high)


@dataclass
class Config:
    """What declarations may say. Keys are table names, or 'table.column'."""

    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    references: tuple[tuple[str, str, str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    units: dict[str, Unit] = field(default_factory=dict)
    values: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()
    personal: tuple[str, ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    soft_delete: dict[str, str] = field(default_factory=dict)
    default_time: dict[str, str] = field(default_factory=dict)
    display: dict[str, tuple[str, ...]] = field(default_factory=dict)
    tenant: str | None = None
    checks: dict[str, str] = field(default_factory=dict)  # conditions on one column, as SQL says them


def unit_of(name: str, kind: str) -> Unit | None:
    n = snake(name)
    if kind == "interval":
        return Unit("duration", detail="interval")
    if kind != "number":
        return None
    if n.endswith("_cents"):
        return Unit("money", 100)
    if re.search(r"(^|_)(pct|percent|percentage)(_|$)", n):
        return Unit("percent")
    if re.search(r"(^|_)(rate|ratio|fraction|share)$", n):
        return Unit("percent", detail="fraction")
    for pattern, detail in ((r"_(ms|milliseconds)$", "ms"), (r"_(s|sec|secs|seconds)$", "s"), (r"_(min|mins|minutes)$", "min")):
        if re.search(pattern, n):
            return Unit("duration", 1000 if detail == "ms" else 1, detail)
    for pattern, detail in ((r"_(g|grams?)$", "g"), (r"_(kg|kilograms?)$", "kg"), (r"_(lbs?|pounds?)$", "lb")):
        if re.search(pattern, n):
            return Unit("weight", detail=detail)
    return Unit("money") if holds(n, MONEY) or fits(n, MORE_MONEY) else None


def _role(c: ColumnModel, table: TableModel) -> tuple[str, float, str]:
    n = snake(c.name)
    if c.kind == "json":
        return "json", 1.0, "json"
    if c.kind in ("timestamp", "date"):
        if fits(n, SOFT_DELETE):
            return "soft_delete", 0.95, "C2"
        return ("timestamp_audit", 0.9, "C3") if fits(n, AUDIT) else ("attribute", 0.9, "C15") if fits(n, PERSONAL, MORE_PERSONAL) else ("timestamp_event", 0.85, "C4")
    if c.kind == "boolean":
        return ("soft_delete", 0.9, "C2") if fits(n, SOFT_DELETE, MORE_SOFT_DELETE) else ("boolean_flag", 1.0, "C6")
    if c.kind == "enum" or (c.kind == "text" and c.values and not c.unique and (c.n_distinct or 0) <= max(50, 0.01 * (table.rows or 0))):
        return "dimension_categorical", 0.9, "C8"
    if c.kind == "text":
        if (c.width or 0) > 80 or re.search(r"(^|_)(body|description|comment|notes?|text|message)$", n):
            return "free_text", 0.85, "C8"
        return "dimension_text", 0.8, "C8"
    if c.kind == "number":
        if c.low == 0 and c.high == 1 and c.n_distinct == 2 and c.type in ("tinyint", "smallint", "int", "bigint"):
            return "boolean_flag", 0.8, "C6b"
        if fits(n, ATTRIBUTE, MORE_ATTRIBUTE):
            return "attribute", 0.85, "C9"
        if holds(n, NON_ADDITIVE) or fits(n, MORE_NON_ADDITIVE):
            return "measure_nonadditive", 0.8, "C11"
        if holds(n, SEMI_ADDITIVE):
            return "measure_semiadditive", 0.75, "C11"
        if holds(n, ADDITIVE) or fits(n, MORE_ADDITIVE):
            return "measure_additive", 0.8, "C11"
        if c.n_distinct is not None and c.n_distinct <= 10:
            return "measure_nonadditive", 0.6, "few values"
        return "measure_additive", 0.55, "C11"
    return "other", 0.5, "none"


def _target(column: str, table: str, tables: dict[str, TableModel]) -> tuple[str, str, str, float] | None:
    """(parent, its key, role, confidence) for ``customer_id``, ``customerId`` or ``o_custkey``: the longest suffix that names a table wins."""
    n = snake(column)
    if n.endswith("_id"):
        words = n[:-3].split("_")
    elif n.endswith("key"):
        words = [w for w in n[:-3].rstrip("_").split("_") if len(w) > 1]
    else:
        return None
    for i in range(len(words)):
        stem = "_".join(words[i:])
        for name, t in tables.items():
            own = snake(name)
            exact = own in (stem, plural(stem), singular(stem)) or (n.endswith("key") and len(stem) >= 4 and own.startswith(stem))
            if exact and len(t.pk) == 1 and not (name == table and column in t.pk):
                return name, t.pk[0], "_".join(words[:i]), 0.8 if i == 0 else 0.7
    return None


def build_model(frames: dict[str, DataFrame], config: Config | None = None, scan: bool = True) -> SchemaModel:
    """A model of the frames; scan reads them for profiles, without it only names, types and declarations count."""
    cfg = config or Config()
    frames = {n: plain_names(df) for n, df in frames.items()}
    model = SchemaModel()
    for name, df in frames.items():
        t = TableModel(name, columns_of(df), tuple(cfg.keys.get(name, ())))
        if scan:
            profile(df, t)
        if not t.pk:
            for guess in ("id", f"{singular(snake(name))}_id"):
                found = next((c for c in t.columns if snake(c) == guess), None)
                if found and (not scan or (t.columns[found].n_distinct or 0) >= 0.9 * (t.rows or 0)):
                    t.pk = (found,)
                    break
        for c in t.columns.values():
            c.primary = t.pk == (c.name,)
            c.unique = c.primary or f"{name}.{c.name}" in cfg.unique
        model.tables[name] = t
    tenants = _tenants(model, cfg)
    linked = {(a, b) for a, b, _, _ in cfg.references} | {(t.name, c) for t in model.tables.values() for c in t.columns if c in tenants}
    for child, col, parent, key in cfg.references:
        one = model.tables[child].columns[col].unique
        model.relationships.append(Relationship(child, (col,), parent, (key,), "1:1" if one else "N:1", "declared", "", 1.0))
    for name, t in model.tables.items():
        for c in t.columns.values():
            if (name, c.name) in linked or c.primary and len(t.pk) == 1:
                continue
            hit = _target(c.name, name, model.tables)
            if hit and (c.kind == model.tables[hit[0]].columns[hit[1]].kind):
                model.relationships.append(Relationship(name, (c.name,), hit[0], (hit[1],), "1:1" if c.unique else "N:1", "inferred", hit[2], hit[3]))
            elif snake(c.name) in ("parent_id",) and len(t.pk) == 1:
                model.relationships.append(Relationship(name, (c.name,), name, t.pk, "N:1", "inferred", "parent", 0.9))
    foreign = {(r.child, c) for r in model.relationships for c in r.child_cols}
    for name, t in model.tables.items():
        for c in t.columns.values():
            ref = f"{name}.{c.name}"
            if c.primary:
                c.role, c.confidence, c.rule = "identifier", 1.0, "C1"
            elif (name, c.name) in foreign:
                c.role, c.confidence, c.rule = "foreign_key", 0.9, "R1/R2"
            elif c.name in tenants:
                c.role, c.confidence, c.rule = "tenant", 0.9, "C14"
            else:
                c.role, c.confidence, c.rule = _role(c, t)
            c.unit = unit_of(c.name, c.kind) if c.role.startswith("measure") else None
            c.pii = fits(snake(c.name), PERSONAL, MORE_PERSONAL) or ref in cfg.personal
            c.searchable = c.kind in ("text", "enum") and c.role in ("dimension_categorical", "dimension_text") and not c.pii
            c.hidden = ref in cfg.hidden or c.role in ("json", "tenant")
            if ref in cfg.checks:
                texts, (low, high) = values_of_check(cfg.checks[ref])
                c.values, c.low, c.high = texts or c.values, c.low if low is None else low, c.high if high is None else high
            if ref in cfg.roles:
                c.role, c.confidence, c.rule = cfg.roles[ref], 1.0, "declared"
            c.unit = cfg.units.get(ref, c.unit)
            c.values = cfg.values.get(ref, c.values)
            c.low, c.high = cfg.ranges.get(ref, (c.low, c.high))
            c.synonyms = cfg.synonyms.get(ref, [])
        t.synonyms = cfg.synonyms.get(name, [])
        t.hidden = name in cfg.hidden
        _times(t, cfg)
        _shape(t, foreign, cfg)
        if scan:
            _durations(t, frames[name])
    return model


def _tenants(model: SchemaModel, cfg: Config) -> set[str]:
    """The declared column, else the usual names where at least two tables, and half of them, have one."""
    if cfg.tenant:
        return {cfg.tenant}
    found = Counter(c for t in model.tables.values() for c in t.columns if c in TENANT.split())
    return {c for c, n in found.items() if n >= max(2, len(model.tables) / 2)}


def _times(t: TableModel, cfg: Config) -> None:
    events = [c for c in t.columns.values() if c.role == "timestamp_event"]
    def rank(c: ColumnModel) -> tuple:
        verb = next((i for i, w in enumerate(EVENT_ORDER) if w in snake(c.name)), len(EVENT_ORDER))
        return (c.null_share or 0) > 0.01, verb, c.name

    t.default_time = cfg.default_time.get(t.name) or (min(events, key=rank).name if events else None)
    t.soft_delete = cfg.soft_delete.get(t.name) or next((c.name for c in t.columns.values() if c.role == "soft_delete"), None)


def _shape(t: TableModel, foreign: set[tuple[str, str]], cfg: Config) -> None:
    """Junctions, snapshots (which make amounts semi-additive) and display columns."""
    refs = [c for c in t.pk if (t.name, c) in foreign]
    rest = [c for c in t.columns.values() if c.name not in t.pk]
    t.junction = len(t.pk) == 2 and len(refs) == 2 and all(c.role in ("timestamp_audit", "identifier") or fits(snake(c.name), AUDIT, "created_at created_on inserted_at inserted_on id") for c in rest)
    dates = [c for c in t.pk if t.columns[c].kind in ("date", "timestamp")]
    if len(dates) == 1 and refs and len(refs) + 1 == len(t.pk):
        t.snapshot = dates[0]
        for c in t.columns.values():
            if c.role == "measure_additive":
                c.role, c.rule = "measure_semiadditive", "C12"
    names = {snake(c): c for c in t.columns}
    by_name = next(((names[n],) for n in ("name", "full_name", "title", "display_name") if n in names), None)
    person = (names["first_name"], names["last_name"]) if {"first_name", "last_name"} <= names.keys() else None
    prefixed = next(((c.name,) for c in t.columns.values() if c.kind == "text" and snake(c.name).endswith("_name")), None)
    number = next(((c.name,) for c in t.columns.values() if c.kind == "text" and snake(c.name).endswith("_number")), None)
    t.display = cfg.display.get(t.name) or by_name or person or prefixed or number or ()


def _durations(t: TableModel, df: DataFrame) -> None:
    """Pairs of a life cycle, unless a sample contradicts them, and in tables of few times those that a sample shows to be in order."""
    events = [c.name for c in t.columns.values() if c.role == "timestamp_event"]

    def stages(name: str) -> dict[int, int]:
        base = re.sub(r"_(at|on|date|time|ts)$", "", snake(name))
        return {i: seq.split().index(base) for i, seq in enumerate(LIFECYCLES) if base in seq.split()}

    known = {a: stages(a) for a in events}
    for a in events:
        for z in events:
            cycles = known[a].keys() & known[z].keys()
            if a == z or not cycles and len(events) > SAMPLED_EVENTS or any(known[a][i] > known[z][i] for i in cycles):
                continue
            share = ordered_share(df, a, z)
            if cycles and (share is None or share >= 0.95) or not cycles and share is not None and share >= 0.98:
                t.durations.append((a, z))

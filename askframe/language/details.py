"""Details of a request beside its main measure: further measures, columns shown, tests of text, missing values, flags and ranges."""

from __future__ import annotations

import re

from ..operators.graph import JoinGraph
from ..plans.types import Order, Predicate, QueryPlan
from ..sources.model import SchemaModel, split_ref
from .lexicon import humanize, singular, stem, tokens
from .oracle import Answer, Question
from .spans import Span

# Cue words before a piece of text.
TEXT_CUES = {"contains": r"\b(contain\w*|includ\w*|mention\w*|like)", "starts_with": r"\b(start\w*|begin\w*) with"}
# Business quantities that seldom name a column.
METRICS = frozenset("revenue sales turnover bookings income earnings gmv proceeds takings".split())
# Words of these questions.
DETAIL_WORDS = frozenset(map(stem, "contains containing includes including starts starting begins beginning missing blank empty null unknown lacking recent newest oldest between distinct unique different".split()))
_MISSING = r"\b(no|without|missing|lacking|blank|null|empty|unknown|not set)\b"
_MEASURED = r"\b(how many|number of|count of|count|total|sum|average|mean|avg|median|highest|lowest|maximum|minimum|max|min)\b"
#: Text columns offered for one piece of text, and columns for one request: limits of a question, not of data.
MAX_OPTIONS = 255


def spoken(ref: str, synonyms: tuple[str, ...] | list[str] = ()) -> str:
    """A pattern for the ways to say a column: its words, run together or not, with the table's name or not."""
    table, column = split_ref(ref)
    noun, name = singular(humanize(table)), re.sub(r" (cents|pct)$", "", humanize(column))
    if name.startswith(noun) and len(name) > len(noun):
        name = name[len(noun) :].strip()
    words = re.escape(name).replace(r"\ ", r"[\s_-]?")
    return "|".join([rf"(?:{re.escape(noun)}[\s_-]?)?{words}", *(re.escape(s.lower()) for s in synonyms)])


def text_matches(request: str, spans: list[Span]) -> list[Span]:
    """Quotes and names that stand after a word for a part of a text."""
    cues = "|".join(TEXT_CUES.values())
    return [x for x in spans if x.kind in ("quoted", "name") and re.search(rf"(?:{cues})\W*(?:the (?:word|text) )?\W*$", request[: x.start].lower())]


def measure_clauses(request: str) -> list[str]:
    """The parts of "A and B by C" that each name a measure; empty unless there are several."""
    head = re.split(r"\b(?:by|per|for each|in each|of each|where|whose|last|this|in|from|since|with|who|that|between)\b", request, maxsplit=1, flags=re.I)[0]
    found = [c.strip() for c in re.split(r",\s*(?:and\s+)?|\s+and\s+", head) if re.search(_MEASURED, c.lower())]
    return found if len(found) > 1 else []


def between_pairs(request: str, numbers: list[Span]) -> dict[Span, Span]:
    """Numbers that are the two ends of one range."""
    out = {}
    for a, z in zip(numbers, numbers[1:]):
        if re.search(r"\bbetween\W*$", request[: a.start].lower()) and request[a.end : z.start].strip().lower() == "and":
            out[a] = z
    return out


def detail_questions(request: str, model: SchemaModel, tables: list[str], parts: list[Span]) -> dict[str, Question]:
    """Asked only where the request has words that could mean them."""
    said = {stem(w) for w in tokens(request)}
    columns = [(f"{t}.{c.name}", c) for t in tables for c in model.tables[t].columns.values() if not c.hidden]
    out: dict[str, Question] = {}
    if re.match(r"\s*(?:please\s+)?(list|show|display|give|find|get)\b", request.lower()):
        out |= {f"show:{ref}": Question("noul", f"Is {humanize(ref)} one of the columns to show?") for ref, c in columns if not c.pii}
    if re.search(_MISSING, request.lower()):
        out |= {f"null:{ref}": Question("noul", f"Only rows without {humanize(ref)}?") for ref, c in columns if c.nullable and not c.primary}
    for ref, c in columns:
        words = [stem(w) for w in humanize(c.name).split() if w not in ("is", "has", "was")]
        if c.role == "boolean_flag" and any(w in s for w in words for s in said):
            out[f"bool:{ref}"] = Question("choice", f"Must {humanize(ref)} hold?", ("yes", "no", "none"))
    text = tuple(ref for ref, c in columns if c.kind in ("text", "enum") and not c.pii)[:MAX_OPTIONS]
    for x in parts:
        out[f"textmode:{x.id}@{x.start}"] = Question("choice", f"How must a text fit {x.value}?", ("contains", "starts_with", "exact"))
        if len(text) > 1:
            out[f"textcol:{x.id}@{x.start}"] = Question("choice", f"Where is {x.value} looked for?", text)
    return out


def set_details(plan: QueryPlan, model: SchemaModel, graph: JoinGraph, a: dict[str, Answer], parts: list[Span]) -> None:
    """Answers to the questions above, put into the plan."""
    if plan.shape == "lookup":
        plan.projections = [n[5:] for n, x in a.items() if n.startswith("show:") and x["yes"] > 0.5 and (split_ref(n[5:])[0] == plan.subject or graph.best(plan.subject, split_ref(n[5:])[0]))]
    for n, x in a.items():
        kind, _, ref = n.partition(":")
        if kind == "null" and x["yes"] > 0.6:
            verb = stem(humanize(split_ref(ref)[1]).split()[0])  # "no delivered date" names the column, not the status
            plan.filters = [f for f in plan.filters if f.op != "eq" or split_ref(f.column)[0] != split_ref(ref)[0] or stem(str(f.values[0])) != verb]
            plan.filters.append(Predicate(ref, "is_null"))
        elif kind == "bool" and max(x, key=x.get) != "none":
            plan.filters.append(Predicate(ref, "is_true" if max(x, key=x.get) == "yes" else "is_false"))
    for s in parts:
        mode, where = a[f"textmode:{s.id}@{s.start}"], a.get(f"textcol:{s.id}@{s.start}")
        if where:
            op = max(mode, key=mode.get)
            plan.filters.append(Predicate(max(where, key=where.get), "eq" if op == "exact" else op, (s.value,)))


def ordered_by(plan: QueryPlan, model: SchemaModel, newest: bool) -> list[Order]:
    """Rows by the time that counts for their table."""
    t = model.tables.get(plan.subject or "")
    return [Order(f"{plan.subject}.{t.default_time}", newest)] if t and t.default_time else []

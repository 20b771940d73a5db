"""Which words of a request are values of which columns, and which tables it is about."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import like_escape
from ..sources.model import SchemaModel
from .lexicon import alike, aliases, content, humanize, singular, stem
from .spans import Span

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class ValueLink:
    column: str
    value: object
    start: int
    end: int
    score: float


def link_values(request: str, spans: list[Span], model: SchemaModel, frames: dict[str, DataFrame] | None = None) -> list[ValueLink]:
    """Known values that the request names, longest first; names still free are searched in the tables, in one job."""
    low, found = request.lower(), []
    names = {s for t in model.tables for s in (t.lower(), humanize(t))} | {singular(humanize(t)) for t in model.tables}
    for t in model.tables.values():
        for c in t.columns.values():
            if t.hidden or c.hidden or not c.values or not (c.searchable or c.role == "dimension_categorical"):
                continue
            for v in c.values:
                for form in aliases(str(v), c.name):
                    if not form or form in names or singular(form) in names:
                        continue
                    pattern = rf"(?<!\w){re.escape(form)}(?:s|es)?(?!\w)"
                    for m in re.finditer(pattern, low):
                        short = len(form) <= 3 and not request[m.start() : m.end()].isupper()  # short codes count in capitals only
                        if not short:
                            found.append(ValueLink(f"{t.name}.{c.name}", v, m.start(), m.end(), 1.0 if form == str(v).lower() else 0.85))
    kept: list[ValueLink] = []
    for x in sorted(found, key=lambda x: (x.start - x.end, -x.score, x.column)):
        if all(x.end <= y.start or x.start >= y.end or (x.start, x.end) == (y.start, y.end) for y in kept):
            kept.append(x)
    free = [s for s in spans if s.kind in ("name", "quoted") and all(s.end <= y.start or s.start >= y.end for y in kept) and singular(str(s.value).lower()) not in names]
    return kept + (search_values(free, model, frames) if free and frames else [])


def search_values(spans: list[Span], model: SchemaModel, frames: dict[str, DataFrame]) -> list[ValueLink]:
    """Values that contain a name, from all searchable columns without a value list."""
    parts = []
    for s in spans:
        for t in model.tables.values():
            for c in t.columns.values():
                if c.searchable and not c.values and not t.hidden:
                    parts.append(frames[t.name].filter(F.col(c.name).ilike(f"%{like_escape(str(s.value))}%")).select(F.lit(s.id).alias("span"), F.lit(f"{t.name}.{c.name}").alias("column"), F.col(c.name).alias("value")).distinct().limit(20))
    if not parts:
        return []
    by_id = {s.id: s for s in spans}
    out = []
    for r in reduce(DataFrame.unionByName, parts).collect():  # 20 values for each name and column, at most
        s = by_id[r["span"]]
        score = 1.0 if str(r["value"]).lower() == str(s.value).lower() else len(str(s.value)) / max(1, len(str(r["value"])))
        out.append(ValueLink(r["column"], r["value"], s.start, s.end, score))
    best = {(x.start, max(y.score for y in out if y.start == x.start)) for x in out}
    return [x for x in out if (x.start, x.score) in best]


def retrieve_tables(request: str, model: SchemaModel, links: list[ValueLink], k: int = 8) -> list[str]:
    """The k tables that fit best, by BM25 over names, synonyms and column names; all of up to 25."""
    if len(model.tables) <= 25:
        return list(model.tables)
    docs = {t.name: [stem(w) for x in (t.name, *t.synonyms, *(humanize(c) for c in t.columns)) for w in content(humanize(x))] for t in model.tables.values()}
    mean = sum(map(len, docs.values())) / len(docs)
    asked = {s for w in content(request) for s in alike(w)}
    linked = {x.column.rpartition(".")[0] for x in links if x.score == 1}

    def score(name: str) -> float:
        d, total = docs[name], 0.0
        for w in asked:
            n, df = d.count(w), sum(w in x for x in docs.values())
            total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(d) / mean)) if n else 0
        return total + 3 * (stem(name) in asked) + 4 * (name in linked)

    return sorted(docs, key=lambda t: (-score(t), t))[:k]

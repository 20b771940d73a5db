"""Cases of requests with the outcomes they may have and the results they must, or must not, give."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal
from pathlib import Path

from .composer import Composer


@dataclass
class Case:
    id: str
    request: str
    outcomes: tuple[str, ...] = ("execute",)
    gold: tuple[str, ...] = ()  # SQL; any may match
    must_not: tuple[str, ...] = ()
    compare: str = "unordered"  # unordered, ordered, keys
    answers: tuple[str, ...] = ()  # options to give when asked


@dataclass
class Outcome:
    id: str
    passed: bool
    outcome: str
    why: str = ""
    rows: list = field(default_factory=list)


def normal(v):
    """Two decimals, dates for midnights, whole seconds, t and f."""
    if isinstance(v, bool):
        return "t" if v else "f"
    if isinstance(v, (int, float, Decimal)):
        return f"{round(float(v), 2):.2f}"
    if isinstance(v, timedelta):
        return f"{int(v.total_seconds())}.00"
    if isinstance(v, datetime):
        return v.date().isoformat() if v.time() == datetime.min.time() else v.isoformat(" ")
    return v.isoformat() if isinstance(v, date) else v if v is None else str(v)


def matches(compare: str, gold: Iterable[tuple], got: Iterable[tuple]) -> bool:
    a, b = [tuple(map(normal, r)) for r in gold], [tuple(map(normal, r)) for r in got]
    if compare == "ordered":
        return a == b
    if compare == "keys":  # some column of the result has exactly the gold's keys
        keys = Counter(r[0] for r in a)
        return any(Counter(r[i] for r in b) == keys for i in range(len(b[0]))) if b else not keys
    return Counter(tuple(sorted(map(str, r))) for r in a) == Counter(tuple(sorted(map(str, r))) for r in b)


def check(case: Case, composer: Composer, sql: Callable[[str], list[tuple]]) -> Outcome:
    r = composer.compose(case.request)
    for option in case.answers:
        if r.outcome == "clarify":
            r = composer.answer(r.clarification.id, option)
    if r.outcome not in case.outcomes:
        return Outcome(case.id, False, r.outcome, r.reason or (r.clarification.question if r.clarification else r.narrative))
    if r.outcome != "execute":
        return Outcome(case.id, True, r.outcome)
    rows = [tuple(x) for x in composer.execute(r, 120)]
    if any(matches(case.compare, sql(q), rows) for q in case.must_not):
        return Outcome(case.id, False, r.outcome, "a known wrong result", rows)
    if case.gold and not any(matches(case.compare, sql(q), rows) for q in case.gold):
        return Outcome(case.id, False, r.outcome, f"another result: {r.narrative}", rows[:5])
    return Outcome(case.id, True, r.outcome, "", rows)


def load_cases(path: str | Path) -> list[Case]:
    return [Case(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()}) for c in json.loads(Path(path).read_text())]


def evaluate(composer: Composer, cases: list[Case], sql: Callable[[str], list[tuple]]) -> int:
    """Print a line for each case and the score; how many failed."""
    done = [check(c, composer, sql) for c in cases]
    for o in done:
        print("pass" if o.passed else "FAIL", o.id, o.outcome, o.why)
    print(f"{sum(o.passed for o in done)} / {len(done)}")
    return sum(not o.passed for o in done)


def verify_gold(case: Case, sql: Callable[[str], list[tuple]]) -> list[str]:
    """Golds that say nothing: no rows."""
    return [q for q in case.gold if not sql(q)]

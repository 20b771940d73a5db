"""The parts of a request that carry a meaning of their own: quotes, dates, periods, numbers, names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.periods import Parts, PeriodSpec

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + "|sept)"
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = {w: i for i, w in enumerate(_SMALL)} | {w: 10 * i for i, w in enumerate(_TENS, 2)} | {"dozen": 12, "hundred": 100}
#: Units of periods; quarters are counted in months.
UNITS = {"day": ("days", 1), "week": ("weeks", 1), "month": ("months", 1), "quarter": ("months", 3), "year": ("years", 1)}
_UNIT = "(?:" + "|".join(UNITS) + ")"
_SCALE = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
_ORDINAL = {"first": 1, "second": 2, "third": 3, "fourth": 4}


@dataclass(frozen=True)
class Span:
    id: str
    kind: str  # quoted, date, relative, number, name, phrase
    text: str
    start: int
    end: int
    value: object = None
    detail: str = ""


def _month(word: str) -> int:
    return next(i + 1 for i, m in enumerate(MONTHS) if m.startswith(word.lower()[:3]))


def _date(text: str) -> tuple[str, Parts] | None:
    t = text.lower().strip()
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", t):
        return "specific_day", Parts(*map(int, m.groups()))
    if m := re.fullmatch(r"(\d{4})-(\d\d)", t):
        return "specific_month", Parts(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"q([1-4])(?:\s+(\d{4}))?", t):
        return "specific_quarter", Parts(int(m[2]) if m[2] else None, quarter=int(m[1]))
    if m := re.fullmatch(r"(first|second|third|fourth) quarter(?: of)?(?:\s+(\d{4}))?", t):
        return "specific_quarter", Parts(int(m[2]) if m[2] else None, quarter=_ORDINAL[m[1]])
    if m := re.fullmatch(rf"({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?", t):
        return "specific_day", Parts(int(m[3]) if m[3] else None, _month(m[1]), int(m[2]))
    if m := re.fullmatch(rf"({_MONTH})(?:,?\s+(\d{{4}}))?", t):
        return "specific_month", Parts(int(m[2]) if m[2] else None, _month(m[1]))
    if re.fullmatch(r"(19|20)\d\d", t):
        return "specific_year", Parts(int(t))
    return None


_DATE = rf"\d{{4}}-\d\d(?:-\d\d)?|q[1-4](?:\s+\d{{4}})?|(?:first|second|third|fourth) quarter(?: of)?(?:\s+\d{{4}})?|{_MONTH}\b(?:\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?!\d))?(?:,?\s+\d{{4}})?|(?<![\d$.])(?:19|20)\d\d(?!\d)"
_AGO = "(?:last|past|previous|prior|trailing)"
_RELATIVE = {
    "day": r"\b(?P<key>today|yesterday)\b",
    "to_date": rf"\b(?P<unit>year|month|quarter|week)[- ]to[- ]date\b|\b(?P<short>[ymqw]td)\b",
    "counted": rf"\b(?:(?:in|over|during|for|within)\s+)?(?:the\s+)?{_AGO}\s+(?P<n>\d+|{'|'.join(NUMBERS)})[\s-]+(?P<unit>{_UNIT})s?\b",
    "named": rf"\b(?:the\s+)?(?P<which>this|current|last|previous|prior|past|trailing)\s+(?P<unit>{_UNIT})\b",
}
_NUMBER = r"(?P<sign>\$)?(?P<digits>\d[\d,]*(?:\.\d+)?)(?:\s?(?P<scale>k|thousand|m|million|bn|billion))?\b(?P<pct>\s?%)?|\b(?P<word>" + "|".join(w for w in NUMBERS if w != "zero") + r")\b"


def _relative(kind: str, g: dict[str, str]) -> PeriodSpec:
    """"last week" is the calendar week before this one; "past week" and "last 2 weeks" roll and end now."""
    if kind == "day":
        return PeriodSpec(g["key"])
    if kind == "to_date":
        return PeriodSpec("this_" + (g["unit"] or {"y": "year", "m": "month", "q": "quarter", "w": "week"}[g["short"][0]]))
    if kind == "counted" or g["which"] in ("past", "trailing"):
        units, times = UNITS[g["unit"]]
        n = g.get("n", "1")
        return PeriodSpec(f"trailing_n_{units}", times * (int(n) if n.isdigit() else NUMBERS[n]))
    if g["unit"] == "day":
        return PeriodSpec("today" if g["which"] in ("this", "current") else "yesterday")
    return PeriodSpec(f"{'this' if g['which'] in ('this', 'current') else 'last'}_{g['unit']}")


def extract_spans(request: str) -> list[Span]:
    """Spans in order; a stretch belongs to the first kind that claims it."""
    taken: list[tuple[int, int]] = []
    out: list[Span] = []

    def free(a: int, z: int) -> bool:
        return all(z <= x or a >= y for x, y in taken)

    def add(kind: str, prefix: str, m: re.Match, value=None, detail: str = "", group: int = 0) -> None:
        a, z = m.span(group)
        if free(a, z):
            taken.append((a, z))
            out.append(Span(f"{prefix}{sum(s.kind == kind for s in out)}", kind, request[a:z], a, z, value, detail))

    for m in re.finditer(r"[\"“']([^\"”']+)[\"”'](?!\w)", request):
        add("quoted", "q", m, m[1])
    for m in re.finditer(rf"\bbetween\s+({_DATE})\s+and\s+({_DATE})", request, re.I):
        a, z = _date(m[1]), _date(m[2])
        if a and z:
            add("date", "date", m, PeriodSpec("between_dates", first=a[1], last=z[1]))
    for m in re.finditer(rf"\b(since|after|before|until)\s+({_DATE})", request, re.I):
        if d := _date(m[2]):
            add("date", "date", m, PeriodSpec("since_date" if m[1].lower() in ("since", "after") else "before_date", first=d[1]))
    for kind, pattern in _RELATIVE.items():
        for m in re.finditer(pattern, request, re.I):
            add("relative", "rt", m, _relative(kind, {k: (v or "").lower() for k, v in m.groupdict().items()}))
    for m in re.finditer(rf"\b(?:{_DATE})", request, re.I):
        if (d := _date(m[0])) and not (m[0].lower() == "may" and not request[m.start()].isupper()):
            add("date", "date", m, PeriodSpec(d[0], first=d[1]))
    for m in re.finditer(_NUMBER, request, re.I):
        n = float(NUMBERS[m["word"].lower()]) if m["word"] else float(m["digits"].replace(",", "")) * _SCALE.get((m["scale"] or "").lower(), 1)
        add("number", "num", m, int(n) if n == int(n) else n, "money" if m["sign"] else "percent" if m["pct"] else "")
    for m in re.finditer(r"(?<!^)(?<![.?!]\s)\b[A-Z][\w&]*(?:\s+[A-Z][\w&]*)*", request):
        add("name", "pn", m, m[0])
    return sorted(out, key=lambda s: s.start)

"""Named periods as half-open bounds, in an organisation's time zone and week.

Bounds are naive wall-clock datetimes in that zone; they become moments where a column holds moments (expressions.literal).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

# The period keys.
KEYS = (
    "none", "today", "yesterday", "this_week", "last_week", "this_month", "last_month", "this_quarter", "last_quarter", "this_year", "last_year",
    "trailing_n_days", "trailing_n_weeks", "trailing_n_months", "trailing_n_years", "specific_month", "specific_quarter", "specific_year", "specific_day",
    "since_date", "before_date", "between_dates",
)


@dataclass(frozen=True)
class Parts:
    """A date as far as it was said: month and day may be open, and the year."""

    year: int | None = None
    month: int | None = None
    day: int | None = None
    quarter: int | None = None


@dataclass(frozen=True)
class PeriodSpec:
    key: str
    n: int = 1
    first: Parts = Parts()
    last: Parts = Parts()


@dataclass(frozen=True)
class Clock:
    as_of: datetime  # naive, wall-clock
    zone: str = "UTC"
    week_start: int = 0  # Monday


def instant(wall: datetime, zone: str) -> datetime:
    """The moment of a wall-clock time in a zone (in a gap, the first moment after it); what has a zone already is that moment."""
    return (wall if wall.tzinfo else wall.replace(tzinfo=ZoneInfo(zone))).astimezone(timezone.utc)


def _day(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def add_months(t: datetime, n: int) -> datetime:
    """The first of the month n months on, at midnight, with the day kept where the month has it."""
    year, month = divmod(t.year * 12 + t.month - 1 + n, 12)
    for day in range(t.day, 27, -1):
        try:
            return _day(t).replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    return _day(t).replace(year=year, month=month + 1, day=min(t.day, 28))


def _start(t: datetime, unit: str, clock: Clock) -> datetime:
    t = _day(t)
    if unit == "week":
        return t - timedelta(days=(t.weekday() - clock.week_start) % 7)
    if unit == "month":
        return t.replace(day=1)
    if unit == "quarter":
        return t.replace(month=3 * ((t.month - 1) // 3) + 1, day=1)
    if unit == "year":
        return t.replace(month=1, day=1)
    return t


def _next(t: datetime, unit: str, n: int = 1) -> datetime:
    if unit in ("day", "week"):
        return t + timedelta(days=n * (7 if unit == "week" else 1))
    return add_months(t, n * {"month": 1, "quarter": 3, "year": 12}[unit])


def _year_of(p: Parts, clock: Clock) -> int:
    """A missing year is that of the most recent past occurrence; the running month counts as last year's."""
    if p.year is not None:
        return p.year
    month = p.month or (3 * (p.quarter - 1) + 1 if p.quarter else 1)
    now = clock.as_of
    if p.day is not None:
        return now.year if (month, p.day) < (now.month, now.day) else now.year - 1
    if p.quarter:
        return now.year if 3 * p.quarter < now.month else now.year - 1
    return now.year if month < now.month else now.year - 1


def _span(p: Parts, clock: Clock) -> tuple[datetime, datetime]:
    year = p.year if p.month is None and p.quarter is None and p.year is not None else _year_of(p, clock)
    if p.day is not None:
        a = datetime(year, p.month or 1, p.day)
        return a, _next(a, "day")
    if p.quarter:
        a = datetime(year, 3 * (p.quarter - 1) + 1, 1)
        return a, _next(a, "quarter")
    if p.month:
        a = datetime(year, p.month, 1)
        return a, _next(a, "month")
    a = datetime(year, 1, 1)
    return a, _next(a, "year")


def repaired(spec: PeriodSpec) -> PeriodSpec:
    """The key that fits what was said of the date: "specific month" of a quarter is that quarter; of nothing, no period."""
    if not spec.key.startswith("specific_"):
        return spec
    p = spec.first
    unit = "quarter" if p.quarter else "day" if p.month and p.day else "month" if p.month else "year" if p.year else ""
    return replace(spec, key=f"specific_{unit}" if unit else "none")


def period_bounds(spec: PeriodSpec, clock: Clock) -> tuple[datetime | None, datetime | None]:
    """[start, end) of a period; None is open. this_* and since end at as_of, last_* is the whole calendar period.

    A day that a shorter month lacks is that month's last (three months before 31 May is 28 or 29 February).
    """
    spec = repaired(spec)
    now, key = clock.as_of, spec.key
    if key == "none":
        return None, None
    if key == "today":
        return _day(now), _next(_day(now), "day")
    if key == "yesterday":
        return _day(now) - timedelta(days=1), _day(now)
    for unit in ("week", "month", "quarter", "year"):
        if key == f"this_{unit}":
            return _start(now, unit, clock), now
        if key == f"last_{unit}":
            return _next(_start(now, unit, clock), unit, -1), _start(now, unit, clock)
    if key in ("trailing_n_days", "trailing_n_weeks"):
        return now - timedelta(days=spec.n * (7 if key.endswith("weeks") else 1)), now
    if key in ("trailing_n_months", "trailing_n_years"):
        return add_months(_day(now), -spec.n * (12 if key.endswith("years") else 1)), now
    if key in ("specific_month", "specific_quarter", "specific_year", "specific_day"):
        return _span(spec.first, clock)
    if key == "since_date":
        return _span(spec.first, clock)[0], now
    if key == "before_date":
        return None, _span(spec.first, clock)[0]
    if key == "between_dates":
        return _span(spec.first, clock)[0], _span(spec.last, clock)[1]
    raise ValueError(f"no such period: {key}")


def shift_years(bounds: tuple[datetime | None, datetime | None], n: int) -> tuple[datetime | None, datetime | None]:
    """The same period n years on; 29 February becomes the 28th."""

    def moved(t: datetime | None) -> datetime | None:
        if t is None:
            return None
        try:
            return t.replace(year=t.year + n)
        except ValueError:
            return t.replace(year=t.year + n, day=28)

    return moved(bounds[0]), moved(bounds[1])


def label(bounds: tuple[datetime | None, datetime | None]) -> str:
    a, z = bounds
    if a is None and z is None:
        return "all time"
    if a is None:
        return f"before {z:%Y-%m-%d}"
    return f"since {a:%Y-%m-%d}" if z is None else f"{a:%Y-%m-%d} to {z - timedelta(microseconds=1):%Y-%m-%d}"

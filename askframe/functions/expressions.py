"""Column expressions for predicates, periods, aggregates and units."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.types import Period, Predicate
from .periods import instant
from ..sources.model import ColumnModel


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def literal(value, column: ColumnModel, zone: str = "UTC") -> Column:
    """A literal of the column's kind; naive times stay wall-clock, and are moments of the zone for columns that hold moments."""
    if isinstance(value, datetime) or (isinstance(value, date) and column.kind == "timestamp"):
        if column.kind == "date":
            return F.lit(value.date() if isinstance(value, datetime) else value)
        stamp = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        if column.type == "timestamp_ntz":
            return F.to_timestamp_ntz(F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S")))
        return F.lit(instant(stamp, zone))
    return F.lit(value)


def predicate(c: Column, p: Predicate, column: ColumnModel, zone: str = "UTC") -> Column:
    """Negative tests keep rows without a value; text tests ignore case."""
    v = [literal(x, column, zone) for x in p.values]
    flag = column.kind == "number"  # a 0/1 integer flag
    match p.op:
        case "eq":
            return c == v[0]
        case "neq":
            return (c != v[0]) | c.isNull() if column.nullable else c != v[0]
        case "in":
            return c == v[0] if len(v) == 1 else c.isin(*v)
        case "not_in":
            return ~c.isin(*v) | c.isNull() if column.nullable else ~c.isin(*v)
        case "gt":
            return c > v[0]
        case "gte":
            return c >= v[0]
        case "lt":
            return c < v[0]
        case "lte":
            return c <= v[0]
        case "between":
            return c.between(v[0], v[1])
        case "contains":
            return c.ilike(f"%{like_escape(str(p.values[0]))}%")
        case "starts_with":
            return c.ilike(f"{like_escape(str(p.values[0]))}%")
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
        case "is_true":
            return c == 1 if flag else c
        case _:
            return (c == 0) | c.isNull() if flag else ~F.coalesce(c, F.lit(False))


def in_period(c: Column, p: Period, column: ColumnModel, zone: str = "UTC") -> Column:
    """[start, end)"""
    out = F.lit(True)
    if p.start is not None:
        out = c >= literal(p.start, column, zone)
    if p.end is not None:
        out = out & (c < literal(p.end, column, zone)) if p.start is not None else c < literal(p.end, column, zone)
    return out


def wall_clock(c: Column, column: ColumnModel, zone: str) -> Column:
    """A moment as wall-clock time in the zone, whatever the session's zone; other kinds as they are."""
    if column.type != "timestamp":
        return c
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def truncated(c: Column, grain: str, column: ColumnModel, zone: str = "UTC") -> Column:
    """The start of the grain: a date for dates, else a wall-clock timestamp in the zone. Weeks start on Monday."""
    return F.date_trunc(grain, wall_clock(c, column, zone)).cast("date" if column.kind == "date" else "timestamp_ntz")


#: Doubles are added as decimals of this type where all of them fit, so that sums depend neither on the order of rows nor on binary fractions.
EXACT = "decimal(38,12)"


def _fraction(column: ColumnModel) -> bool:
    return column.type in ("double", "float")


def _exactly(c: Column, then) -> Column:
    """then(sum) of doubles: of their exact decimals if every value is one and the sum fits, else of the doubles themselves."""
    d = c.try_cast(EXACT)
    fits = F.bool_and(F.coalesce(d.cast("double") == c.cast("double"), c.isNull()))
    total = F.try_sum(d)
    return F.when(fits & total.isNotNull(), then(total).cast("double")).otherwise(then(F.sum(c.cast("double"))))


def raw_aggregate(agg: str, c: Column, column: ColumnModel, then=lambda x: x) -> Column:
    """The aggregate in the column's own units, unrounded; then is applied to the exact result."""
    if agg == "sum":
        return _exactly(c, then) if _fraction(column) else then(F.sum(c))
    if agg == "avg":
        n = F.nullif(F.count(c), F.lit(0)).cast("decimal(20,0)")
        if _fraction(column):
            return _exactly(c, lambda s: then(s / n))
        return then((F.sum(c) if column.type.startswith("decimal") else F.sum(c).cast("decimal(38,6)")) / n)
    if agg == "median":
        return then(F.median(c.cast("double")))
    if agg in ("min", "max"):
        return then((F.min if agg == "min" else F.max)(c))
    return F.count_distinct(c) if agg == "count_distinct" else F.count(c)


def aggregate(agg: str, c: Column, column: ColumnModel, left: bool = False) -> Column:
    """An aggregate in display units: money is divided after aggregation, averages and medians have two places; only the result is rounded."""
    divisor = column.unit.divisor if column.unit else 1
    if agg in ("count_distinct", "count_rows"):
        return raw_aggregate(agg, c, column)
    if agg in ("avg", "median") or divisor != 1:
        out = raw_aggregate(agg, c, column, lambda x: F.round(x / F.lit(divisor) if divisor != 1 else x, 2)).cast("double")
    else:
        out = raw_aggregate(agg, c, column)
    return F.coalesce(out, F.lit(0).cast("double") if divisor != 1 or _fraction(column) else F.lit(0)) if left and agg == "sum" else out


def seconds(end: Column, start: Column) -> Column:
    """Whole seconds between two times of one kind."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))

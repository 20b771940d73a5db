"""What a catalog's statistics would say, computed from the data: one aggregation job a table, bounded value lists, names that look unique counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import ColumnModel, TableModel

#: Tables of more rows are profiled on a sample of about so many; distinct counts are then estimates of the sample's.
SAMPLE_ROWS = 200_000
#: Columns with so many different values or fewer keep their list, of values up to this width.
MOST_VALUES, VALUE_WIDTH = 200, 80
#: Texts up to that width with so large a share of different values are counted exactly, in all rows.
NEARLY_ALL = 0.9


def profile(df: DataFrame, table: TableModel) -> None:
    """Fill row count, null shares, distinct counts, widths, ranges and value lists of the table's columns."""
    table.rows = df.count()
    some = df if table.rows <= SAMPLE_ROWS else df.sample(SAMPLE_ROWS / table.rows, seed=7)
    cols = [c for c in table.columns.values() if c.kind not in ("array", "json", "other")]
    if not cols:
        return
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c.name}`")
        aggs += [F.count(x).alias(f"c{i}"), F.approx_count_distinct(x, 0.02).alias(f"d{i}"), F.avg(F.length(x.cast("string"))).alias(f"w{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
    got = some.agg(*aggs).first()
    n = got["n"] or 1
    for i, c in enumerate(cols):
        c.null_share, c.n_distinct, c.width, c.low, c.high = 1 - got[f"c{i}"] / n, got[f"d{i}"], got[f"w{i}"], got[f"a{i}"], got[f"z{i}"]
    for c in cols:
        if c.kind in ("text", "enum") and c.n_distinct >= NEARLY_ALL * n and (c.width or 0) <= VALUE_WIDTH:
            c.n_distinct = df.agg(F.count_distinct(F.col(f"`{c.name}`"))).first()[0]
    short = [c for c in cols if c.kind in ("text", "enum") and (c.n_distinct or 0) <= MOST_VALUES and (c.width or 0) <= VALUE_WIDTH]
    if short:  # sets of few values each, so one job takes them all
        got = some.agg(*(F.collect_set(f"`{c.name}`").alias(f"v{i}") for i, c in enumerate(short))).first()
        for i, c in enumerate(short):
            c.values = sorted(got[f"v{i}"])


def ordered_share(df: DataFrame, start: str, end: str, rows: int = 500) -> float | None:
    """The share of (up to 500) rows with both times whose end is not before their start."""
    some = df.select(F.col(start).alias("a"), F.col(end).alias("z")).filter("a is not null and z is not null").limit(rows)
    return some.agg(F.avg(F.when(F.col("z") >= F.col("a"), 1.0).otherwise(0.0))).first()[0]


def is_unique(df: DataFrame, columns: tuple[str, ...]) -> bool:
    n, d = df.agg(F.count("*"), F.count_distinct(*(F.col(c) for c in columns))).first()
    return n == d


__all__ = ["ColumnModel", "is_unique", "ordered_share", "profile"]

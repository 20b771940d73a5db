"""Query plan -> lazy DataFrame. Tables are joined when a column of theirs is first used; Catalyst does the rest."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import aggregate, in_period, predicate, raw_aggregate, seconds, truncated
from ..plans.types import Existence, Measure, Period, Predicate, QueryPlan
from ..shared import spill
from ..sources.catalog import plain_names
from ..sources.model import SchemaModel, split_ref
from .analyze import Group, PlanError, Unreachable, all_measures, analyze, dimension_table, downs, resolve, same_measure
from .graph import JoinGraph, Path


@dataclass(frozen=True)
class Settings:
    max_rows: int | None = 5000  # None: all groups
    lookup_rows: int = 1000
    ranking_rows: int = 10
    zone: str = "UTC"  # of wall-clock times, where columns hold moments
    max_bytes: int = 1 << 40  # that a plan may read
    timeout_s: float = 15.0


#: The column that HAVING compares: in the measure's own units, unrounded, not shown.
HAVING = "_having"


@dataclass(frozen=True)
class OutputColumn:
    name: str
    role: str  # dimension, measure, projection, derived
    source: str = ""


class Scope:
    """One FROM: a root and the tables joined to it, each once for every chain of relationships."""

    def __init__(self, builder: Builder, root: str, plan: QueryPlan):
        self.b, self.root, self.plan = builder, root, plan
        self.placed: dict[tuple[str, ...], str] = {(): "t0"}
        self.df = builder.frame(root, "t0")

    def along(self, path: Path, allow_down: bool = False) -> str:
        chain: tuple[str, ...] = ()
        for s in path:
            if not s.safe and not allow_down:
                raise PlanError(f"{s.target} has several rows for each of {s.source}")
            longer = (*chain, s.rel.id + ("" if s.up else "~"))
            if longer not in self.placed:
                a, b = self.placed[chain], f"t{len(self.placed)}"
                here, there = (s.rel.child_cols, s.rel.parent_cols) if s.up else (s.rel.parent_cols, s.rel.child_cols)
                on = [F.col(f"{a}__{x}") == F.col(f"{b}__{y}") for x, y in zip(here, there, strict=True)]
                self.df = self.df.join(self.b.frame(s.target, b), on)
                self.placed[longer] = b
            chain = longer
        return self.placed[chain]

    def path(self, table: str) -> Path:
        return resolve(self.b.graph, self.plan, self.root, table)

    def col(self, ref: str) -> Column:
        table, name = split_ref(ref)
        return F.col(f"{self.along(self.path(table))}__{name}")

    def condition(self, p: Predicate) -> Column:
        return self.b.test(self.col(p.column), p)

    def within(self, p: Period) -> Column:
        return in_period(self.col(p.column), p, self.b.model.column(p.column), self.b.settings.zone)

    def all_of(self, filters: tuple[Predicate, ...], period: Period | None = None) -> Column | None:
        conds = [self.condition(f) for f in dict.fromkeys(filters)] + ([self.within(period)] if period else [])
        out = None
        for c in conds:
            out = c if out is None else out & c
        return out

    def where(self, c: Column | None) -> None:
        if c is not None:
            self.df = self.df.filter(c)


class Builder:
    def __init__(self, model: SchemaModel, frames: dict[str, DataFrame], settings: Settings | None = None):
        self.model, self.frames, self.settings = model, {n: plain_names(df) for n, df in frames.items()}, settings or Settings()
        self.graph = JoinGraph(model)

    def frame(self, table: str, alias: str) -> DataFrame:
        return self.frames[table].select(*(F.col(f"`{c}`").alias(f"{alias}__{c}") for c in self.model.tables[table].columns))

    def build(self, plan: QueryPlan) -> DataFrame:
        return self.compile(plan)[0]

    def compile(self, plan: QueryPlan) -> tuple[DataFrame, list[OutputColumn]]:
        groups = analyze(plan, self.model, self.graph)
        if plan.shape == "lookup" and not plan.measures and not plan.having:
            return self._lookup(plan)
        if len(groups) > 1:
            return self._finish(plan, *self._multi(plan, groups))
        flip = self._flip_path(plan, groups[0])
        return self._finish(plan, *(self._flipped(plan, groups[0], flip) if flip else self._single(plan, groups[0])))

    # --- conditions ---

    def test(self, c: Column, p: Predicate) -> Column:
        column = self.model.column(p.column)
        if p.hierarchy:
            below = self.descendants(p.column, p.values)
            return c.isin(*p.values) if below is None else c.isin(below)
        return predicate(c, p, column, self.settings.zone)

    def descendants(self, ref: str, values: tuple) -> DataFrame | None:
        """The values and, along the table's self-reference, the values of all rows below them (cycles end); None without a self-reference."""
        table, name = split_ref(ref)
        rel = next((r for r in self.model.relationships if r.self_reference and r.child == table), None)
        if rel is None:
            return None

        rows = spill(self.frames[table].select(F.col(rel.parent_cols[0]).alias("id"), F.col(rel.child_cols[0]).alias("up"), F.col(name).alias("value")), "hierarchy")
        found = edge = spill(rows.filter(F.col("value").isin(*values)).select("id").distinct(), "level")
        while not edge.isEmpty():  # a level a round; without the tables the plan would double with every level
            edge = spill(rows.join(edge.withColumnRenamed("id", "up"), "up", "left_semi").select("id").distinct().join(found, "id", "left_anti"), "level")
            found = found.union(edge)
        return rows.join(found, "id", "left_semi").select("value").distinct()

    def _conditions(self, s: Scope, plan: QueryPlan, measures: list[Measure], skip: frozenset[str] = frozenset()) -> None:
        """WHERE. What can only be reached through a 1:N step becomes a semi- or anti-join."""
        wanted: dict[str, Existence] = {}

        def add(table: str, p: Predicate | None = None, w: Period | None = None) -> None:
            e = wanted.get(table, Existence(table))
            wanted[table] = replace(e, filters=(*e.filters, p) if p else e.filters, period=w or e.period)

        for f in dict.fromkeys(plan.filters):
            table = split_ref(f.column)[0]
            if table in skip:
                continue
            if downs(s.path(table)):
                add(table, p=f)
            else:
                s.where(s.condition(f))
        if plan.window:
            table = split_ref(plan.window.column)[0]
            if downs(s.path(table)):
                add(table, w=plan.window)
            elif table not in skip:
                s.where(s.within(plan.window))
        if plan.compare:
            a, b = plan.compare
            s.where(s.within(a) | s.within(b))
        root = self.model.tables[s.root]
        if plan.soft_delete and root.soft_delete:
            c = self.model.column(f"{s.root}.{root.soft_delete}")
            s.where(F.col(f"t0__{c.name}").isNull() if c.kind in ("timestamp", "date") else ~F.coalesce(F.col(f"t0__{c.name}").cast("boolean"), F.lit(False)))
        if plan.snapshot_latest:
            self._latest(s, plan)
        shared = self._shared(measures)
        for f in shared:
            s.where(s.condition(f))
        for e in [*wanted.values(), *plan.existence]:
            self._exists(s, e)

    def _latest(self, s: Scope, plan: QueryPlan) -> None:
        """Rows of the latest date (in the window): an aggregate of one row is broadcast."""
        c = s.col(plan.snapshot_latest)
        last = s.df.agg(F.max(c).alias("latest"))
        s.df = s.df.join(F.broadcast(last), c == F.col("latest")).drop("latest")

    @staticmethod
    def _shared(measures: list[Measure]) -> list[Predicate]:
        """Filters that all measures have go to WHERE."""
        if not measures:
            return []
        return [f for f in measures[0].filters if all(f in m.filters for m in measures)]

    def _exists(self, s: Scope, e: Existence) -> None:
        path = s.path(e.table)
        cut = next((i for i, x in enumerate(path) if not x.safe), None)
        if cut is None:  # a parent: a plain condition
            c = s.all_of(e.filters, e.period)
            if c is None:
                c = s.col(f"{e.table}.{self.model.tables[e.table].pk[0]}").isNotNull()
            s.where(~F.coalesce(c, F.lit(False)) if e.negated else c)
            return
        outer = s.along(path[:cut])
        step = path[cut]
        inner = Scope(self, step.target, s.plan)
        inner.along(path[cut + 1 :], allow_down=True)
        end = inner.placed[tuple(x.rel.id + ("" if x.up else "~") for x in path[cut + 1 :])]
        for f in dict.fromkeys(e.filters):
            table, name = split_ref(f.column)
            if table == e.table:
                inner.where(self.test(F.col(f"{end}__{name}"), f))
            else:
                inner.where(inner.condition(f))
        if e.period:
            table, name = split_ref(e.period.column)
            c = F.col(f"{end}__{name}") if table == e.table else inner.col(e.period.column)
            inner.where(in_period(c, e.period, self.model.column(e.period.column), self.settings.zone))
        keys = inner.df.select(*(F.col(f"t0__{c}").alias(f"x__{c}") for c in step.rel.child_cols))
        on = [F.col(f"{outer}__{p}") == F.col(f"x__{c}") for p, c in zip(step.rel.parent_cols, step.rel.child_cols, strict=True)]
        s.df = s.df.join(keys, on, "left_anti" if e.negated else "left_semi")

    # --- aggregation ---

    def _dimension(self, s: Scope, d) -> list[tuple[str, Column]]:
        if d.kind == "time":
            return [(d.alias, truncated(s.col(d.column), d.grain, self.model.column(d.column), self.settings.zone))]
        if d.kind == "entity":
            t = self.model.tables[d.table]
            names = [*t.pk, *(c for c in t.display if c not in t.pk)]
            return [(n, s.col(f"{d.table}.{n}")) for n in names]
        return [(d.alias, s.col(d.column))]

    def _measure(self, s: Scope, m: Measure, shared: list[Predicate], left: str | None = None, raw: bool = False) -> Column:
        """raw: in the column's own units and unrounded, as HAVING compares it."""
        cond = s.all_of(tuple(f for f in m.filters if f not in shared), m.period)

        def picked(c: Column) -> Column:
            return c if cond is None else F.when(cond, c)

        if m.kind == "duration":
            span = picked(seconds(s.col(m.end), s.col(m.column)))
            if m.agg == "median":
                name = f"span_{m.alias}"  # an observed value; the function takes a name
                s.df = s.df.withColumn(name, span)
                return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}`)").cast("long")
            return (F.avg(span) if raw else F.round(F.avg(span), 2)) if m.agg == "avg" else {"min": F.min, "max": F.max, "sum": F.sum}[m.agg](span)
        if m.column is None:
            if left:
                return F.count(picked(F.col(left)))
            if s.root != m.table:
                return F.count_distinct(picked(s.col(f"{m.table}.{self.model.tables[m.table].pk[0]}")))
            return F.count(picked(F.lit(1)))
        c, column = picked(s.col(m.column)), self.model.column(m.column)
        return raw_aggregate(m.agg, c, column) if raw else aggregate(m.agg, c, column, left is not None)

    def _having(self, s: Scope, plan: QueryPlan, measures: list[Measure], shared: list[Predicate], left: str | None = None) -> list[Column]:
        """The hidden column, if the measure compared is one of these; one compared over two periods goes by the current one."""
        if not plan.having:
            return []
        wanted = replace(plan.having.measure, period=plan.compare[0]) if plan.compare else plan.having.measure
        m = next((m for m in measures if same_measure(m, wanted)), None)
        if m is None:
            return []
        raw = self._measure(s, m, shared, left, raw=True)
        return [(F.coalesce(raw, F.lit(0)) if left and m.agg == "sum" else raw).alias(HAVING)]

    def _grouped(self, s: Scope, plan: QueryPlan, measures: list[Measure], dims: list[tuple[str, Column]], left: str | None = None) -> tuple[DataFrame, list[OutputColumn]]:
        shared = self._shared(measures)
        aggs = [self._measure(s, m, shared, left).alias(m.alias) for m in measures] or [F.count(F.lit(1)).alias("count")]
        aggs += self._having(s, plan, measures, shared, left)
        df = s.df.groupBy(*(c.alias(n) for n, c in dims)).agg(*aggs) if dims else s.df.agg(*aggs)
        return df, [*(OutputColumn(n, "dimension") for n, _ in dims), *(OutputColumn(m.alias, "measure") for m in measures or [Measure("count", "count_rows", s.root)])]

    def _compared(self, plan: QueryPlan, measures: list[Measure]) -> list[Measure]:
        if not plan.compare:
            return measures
        now, then = plan.compare
        return [replace(m, alias=f"{m.alias}_{name}", period=p) for m in measures for name, p in (("current", now), ("previous", then))]

    def _single(self, plan: QueryPlan, g: Group) -> tuple[DataFrame, list[OutputColumn]]:
        s = Scope(self, g.root, plan)
        dims = [x for d in sorted(plan.dimensions, key=lambda d: d.kind != "time") for x in self._dimension(s, d)]
        measures = self._compared(plan, g.measures)
        self._conditions(s, plan, g.measures)
        for m in measures:  # joins come before the aggregate
            self._measure(s, m, self._shared(measures))
        return self._grouped(s, plan, measures, dims)

    def _flip_path(self, plan: QueryPlan, g: Group) -> Path:
        """The way to the one table of all dimensions, if groups without rows are wanted and possible."""
        tables = {dimension_table(d) for d in plan.dimensions}
        if not plan.include_empty:
            return ()
        if len(tables) != 1 or tables == {g.root} or any(d.kind == "time" for d in plan.dimensions) or plan.compare:
            raise PlanError("groups without rows can be shown for the columns of one related table only")
        return resolve(self.graph, plan, g.root, next(iter(tables)))

    def _flipped(self, plan: QueryPlan, g: Group, path: Path) -> tuple[DataFrame, list[OutputColumn]]:
        """FROM the dimension's table LEFT JOIN the measured rows, which are filtered first."""
        table, last = path[-1].target, path[-1]
        above = frozenset(t for t in self.graph.up_reachable(table))
        child = Scope(self, g.root, plan)
        link = child.along(path[:-1])
        self._conditions(child, replace(plan, filters=[f for f in plan.filters if split_ref(f.column)[0] not in above]), g.measures)
        for m in g.measures:
            self._measure(child, m, [])
        s = Scope(self, table, plan)
        for f in plan.filters:
            if split_ref(f.column)[0] in above:
                s.where(s.condition(f))
        dims = [x for d in plan.dimensions for x in self._dimension(s, d)]
        rows = child.df.select("*", F.lit(1).alias("present"))
        rows = rows.select(*(F.col(c).alias(f"m_{c}") for c in rows.columns))
        s.df = s.df.join(rows, [F.col(f"t0__{p}") == F.col(f"m_{link}__{c}") for p, c in zip(last.rel.parent_cols, last.rel.child_cols, strict=True)], "left")
        inner = _Renamed(child, s)
        shared = self._shared(g.measures)
        aggs = [self._measure(inner, m, shared, "m_present").alias(m.alias) for m in g.measures] + self._having(inner, plan, g.measures, shared, "m_present")
        return s.df.groupBy(*(c.alias(n) for n, c in dims)).agg(*aggs), [*(OutputColumn(n, "dimension") for n, _ in dims), *(OutputColumn(m.alias, "measure") for m in g.measures)]

    def _multi(self, plan: QueryPlan, groups: list[Group]) -> tuple[DataFrame, list[OutputColumn]]:
        """Each root is aggregated on its own, then the groups are joined: no rows are multiplied."""
        out, columns = None, []
        for g in groups:
            df, cols = self._single(replace(plan, include_empty=False), g)
            dims = [c.name for c in cols if c.role == "dimension"]
            out = df if out is None else (out.join(df, dims, "full") if dims else out.crossJoin(df))  # without dimensions: one row each
            columns += [c for c in cols if c not in columns]
        return out, sorted(columns, key=lambda c: c.role != "dimension")

    # --- after aggregation ---

    def _finish(self, plan: QueryPlan, df: DataFrame, columns: list[OutputColumn]) -> tuple[DataFrame, list[OutputColumn]]:
        dims = [c.name for c in columns if c.role == "dimension"]
        if plan.having:
            df = df.filter(self._compares(F.col(HAVING), plan.having.op, [F.lit(x) for x in plan.having.values])).drop(HAVING)
        if plan.per_group:
            df = self._per_group(plan, df, columns)
        df = self._ordered(plan, df, columns)
        limit = plan.limit or (self.settings.ranking_rows if plan.shape == "ranking" and not plan.per_group else None)
        if dims:
            most = self._most(limit)
            df = df if most is None else df.limit(most)
        if plan.derived:
            df, extra = self._derived(plan, df, columns)
            columns = [*columns, extra]
        hidden = {m.alias for m in all_measures(plan) if m.hidden} | self._implied(plan)
        keep = [c for c in columns if c.name not in hidden]
        return df.select(*(c.name for c in keep)), keep

    def _most(self, limit: int | None) -> int | None:
        return min((n for n in (limit, self.settings.max_rows) if n is not None), default=None)

    @staticmethod
    def _compares(c: Column, op: str, v: list[Column]) -> Column:
        """A negative test keeps groups without a value, as it does for rows."""
        match op:
            case "eq":
                return c == v[0]
            case "neq":
                return (c != v[0]) | c.isNull()
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
        raise PlanError(f"groups can't be tested with {op}")

    def _implied(self, plan: QueryPlan) -> set[str]:
        """Keys of entities whose one display column tells the rows apart: grouped by, but not shown."""
        out: set[str] = set()
        for d in plan.dimensions:
            t = self.model.tables[d.table] if d.kind == "entity" else None
            if t and t.told_apart:
                out |= set(t.pk) - {t.display[0]}
        return out

    @staticmethod
    def _sorted_by(plan: QueryPlan, name: str) -> str:
        """A measure compared over two periods goes by the current one."""
        return f"{name}_current" if plan.compare and any(m.alias == name for m in all_measures(plan)) else name

    def _direction(self, plan: QueryPlan) -> list:
        by = [(F.col(self._sorted_by(plan, o.by)), o.descending) for o in plan.order]
        return [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in by]

    def _ordered(self, plan: QueryPlan, df: DataFrame, columns: list[OutputColumn]) -> DataFrame:
        """The plan's order, else time for trends and the first measure descending; dimensions break ties."""
        dims = [c.name for c in columns if c.role == "dimension"]
        measures = [c.name for c in columns if c.role == "measure"]
        if not dims:
            return df
        by = self._direction(plan)
        used = {o.by for o in plan.order}
        if not by and plan.shape != "trend" and measures:
            by, used = [F.col(measures[0]).desc_nulls_last()], {measures[0]}
        return df.orderBy(*by, *(F.col(d).asc_nulls_last() for d in dims if d not in used))

    def _per_group(self, plan: QueryPlan, df: DataFrame, columns: list[OutputColumn]) -> DataFrame:
        part, n = plan.per_group
        dims = [c.name for c in columns if c.role == "dimension" and c.name != part]
        first = next(c.name for c in columns if c.role == "measure")
        by = self._direction(plan) or [F.col(first).desc_nulls_last()]
        w = Window.partitionBy(part).orderBy(*by, *(F.col(d).asc_nulls_last() for d in dims))
        return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")

    def _derived(self, plan: QueryPlan, df: DataFrame, columns: list[OutputColumn]) -> tuple[DataFrame, OutputColumn]:
        """A calculation over the finished (limited) rows, on the first measure, along time or by size."""
        m = F.col(next(c.name for c in columns if c.role == "measure"))
        time = next((d.alias for d in plan.dimensions if d.kind == "time"), None)
        k = F.col(time).asc_nulls_last() if time else m.desc_nulls_last()
        w = Window.orderBy(k)
        match plan.derived:
            case "share_of_total":
                total = F.sum(m).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                name, e = "share_pct", F.round(m * 100.0 / F.nullif(total, F.lit(0)), 2)
            case "running_total":
                name, e = "running_total", F.sum(m).over(w.rangeBetween(Window.unboundedPreceding, 0))
            case "change_vs_previous":
                name, e = "change", m - F.lag(m).over(w)
            case "pct_change_vs_previous":
                name, e = "pct_change", F.round((m / F.nullif(F.lag(m).over(w), F.lit(0)) - 1) * 100, 2)
            case "rank":
                name, e = "rank", F.rank().over(Window.orderBy(m.desc_nulls_last())).cast("long")
            case "moving_average":
                n = max(2, plan.derived_window)
                name, e = f"moving_avg_{n}", F.round(F.avg(m).over(w.rowsBetween(1 - n, 0)), 2)
            case other:
                raise PlanError(f"no such calculation: {other}")
        return df.withColumn(name, e), OutputColumn(name, "derived")

    # --- rows ---

    def default_projections(self, table: str) -> list[str]:
        """Key, unique searchable text, display, default time, the first amount; no personal data."""
        t = self.model.tables[table]
        first = next((c.name for c in t.columns.values() if c.role == "measure_additive" or (c.unit and c.unit.kind == "money")), None)
        names = [*t.pk, *(c.name for c in t.columns.values() if c.unique and c.searchable), *t.display, t.default_time, first]
        return [f"{table}.{n}" for n in dict.fromkeys(n for n in names if n) if not t.columns[n].pii and not t.columns[n].hidden]

    @staticmethod
    def _shown(c: Column, column) -> Column:
        """Money in display units."""
        divisor = column.unit.divisor if column.unit else 1
        return F.round(c.cast("double") / divisor, 2) if divisor != 1 else c

    def _lookup(self, plan: QueryPlan) -> tuple[DataFrame, list[OutputColumn]]:
        root = plan.subject or split_ref(plan.projections[0])[0]
        s = Scope(self, root, plan)
        wanted = list(dict.fromkeys(plan.projections or self.default_projections(root)))
        names, seen = {}, set()
        for ref in wanted:
            table, name = split_ref(ref)
            names[ref] = f"{table}_{name}" if name in seen else name
            seen.add(name)
        cols = {names[ref]: s.col(ref) for ref in wanted}
        self._conditions(s, plan, [])
        pk = [F.col(f"t0__{c}").asc_nulls_last() for c in self.model.tables[root].pk]

        def ref_of(by: str) -> Column:
            return cols[by] if by in cols else s.col(by)

        order = [ref_of(o.by).desc_nulls_last() if o.descending else ref_of(o.by).asc_nulls_last() for o in plan.order]
        if plan.distinct_on:
            part, by, desc = plan.distinct_on
            c = s.col(by)
            w = Window.partitionBy(s.col(part)).orderBy(c.desc_nulls_last() if desc else c.asc_nulls_last(), *pk)
            s.df = s.df.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
        limit = self._most(plan.limit or self.settings.lookup_rows)
        out = [self._shown(c, self.model.column(ref)).alias(n) for (n, c), ref in zip(cols.items(), wanted, strict=True)]
        if plan.distinct:
            df = s.df.select(*out).distinct().orderBy(*(F.col(n).asc_nulls_last() for n in cols)).limit(limit)
        else:
            df = s.df.orderBy(*order, *pk).limit(limit).select(*out) if order or pk else s.df.limit(limit).select(*out)
        return df, [OutputColumn(n, "projection", ref) for ref, n in names.items()]


class _Renamed:
    """The measured side of a flipped join: its columns carry a prefix."""

    def __init__(self, child: Scope, outer: Scope):
        self.root, self.child, self.outer = child.root, child, outer

    def col(self, ref: str) -> Column:
        table, name = split_ref(ref)
        return F.col(f"m_{self.child.along(self.child.path(table))}__{name}")

    def all_of(self, filters: tuple[Predicate, ...], period: Period | None = None) -> Column | None:
        out = None
        for f in filters:
            c = self.child.b.test(self.col(f.column), f)
            out = c if out is None else out & c
        if period:
            c = in_period(self.col(period.column), period, self.child.b.model.column(period.column), self.child.b.settings.zone)
            out = c if out is None else out & c
        return out


__all__ = ["Builder", "OutputColumn", "Settings", "Unreachable"]

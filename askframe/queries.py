"""Registered plans and requests over the star-schema tables, each with the SQL that says the same.

Dates are fixed: orders and line items as of Monday 2001-07-16, events as of 2024-01-29.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.periods import Clock, Parts, PeriodSpec, period_bounds, shift_years
from .language.composer import Composer
from .operators.analyze import PlanError
from .operators.builder import Builder, Settings
from .plans.types import Dimension, Existence, Having, Measure, Order, Period, Predicate, QueryPlan
from .sources.model import ColumnModel, Relationship, TableModel, Unit
from .sources.profile import profile
from .sources.tpch import tpch_frames, tpch_model

CLOCK = Clock(datetime(2001, 7, 16))
EVENTS = Clock(datetime(2024, 1, 29))


def engine(spark: SparkSession, sf_dir: str) -> Builder:
    frames = tpch_frames(spark, sf_dir)
    return Builder(tpch_model(frames), frames)


def _on(column: str, key: str, clock: Clock = CLOCK, **more) -> Period:
    a, z = period_bounds(PeriodSpec(key, **more), clock)
    return Period(column, a, z)


ORDERED = "orders.o_orderdate"
TOTAL = Measure("total", "sum", "orders", "orders.o_totalprice")
N_ORDERS = Measure("n", "count_rows", "orders", kind="count")
NATION = Dimension("nation", "nation.n_name")
MONTH = Dimension("month", ORDERED, "time", "month")


def _dim(column: str, alias: str | None = None) -> Dimension:
    return Dimension(alias or column.split(".")[1], column)


def _m(alias: str, agg: str, column: str) -> Measure:
    return Measure(alias, agg, column.split(".")[0], column)


def _month_series(**more) -> QueryPlan:
    return QueryPlan("trend", measures=[TOTAL], dimensions=[MONTH], window=_on(ORDERED, "this_year"), **more)


def _count_in(key: str, **more) -> QueryPlan:
    return QueryPlan(measures=[N_ORDERS], window=_on(ORDERED, key, **more))


def _filtered(*filters: Predicate, table: str = "orders") -> QueryPlan:
    return QueryPlan(measures=[Measure("n", "count_rows", table, kind="count")], filters=list(filters))


_THIS, _LAST = period_bounds(PeriodSpec("this_year"), CLOCK), shift_years(period_bounds(PeriodSpec("this_year"), CLOCK), -1)

D = "o_totalprice::VARCHAR::DECIMAL(38,12)"
TREND = f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum({D})::DOUBLE AS total FROM orders WHERE o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16' GROUP BY 1"


def _n(where: str, table: str = "orders") -> str:
    return f"SELECT count(*) AS n FROM {table} WHERE {where}"


#: name -> (plan, SQL)
PLANS: dict[str, tuple[QueryPlan, str]] = {
    "flagship_region_last_quarter": (
        QueryPlan("breakdown", measures=[TOTAL], dimensions=[_dim("region.r_name", "region")], window=_on(ORDERED, "last_quarter")),
        f"SELECT r_name AS region, sum({D})::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= '2001-04-01' AND o_orderdate < '2001-07-01' GROUP BY 1",
    ),
    "sum_by_nation": (QueryPlan("breakdown", measures=[TOTAL], dimensions=[NATION]), f"SELECT n_name AS nation, sum({D})::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "avg_by_priority": (QueryPlan("breakdown", measures=[_m("average", "avg", "orders.o_totalprice")], dimensions=[_dim("orders.o_orderpriority")]), f"SELECT o_orderpriority, round(sum({D})::DOUBLE / count(o_totalprice), 2) AS average FROM orders GROUP BY 1"),
    "median_by_priority": (QueryPlan("breakdown", measures=[_m("median", "median", "orders.o_totalprice")], dimensions=[_dim("orders.o_orderpriority")]), "SELECT o_orderpriority, round(median(o_totalprice), 2) AS median FROM orders GROUP BY 1"),
    "min_max_by_brand": (QueryPlan("breakdown", measures=[_m("low", "min", "part.p_retailprice"), _m("high", "max", "part.p_retailprice")], dimensions=[_dim("part.p_brand")]), "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1"),
    "count_distinct_column": (QueryPlan(measures=[_m("n", "count_distinct", "part.p_brand")]), "SELECT count(DISTINCT p_brand) AS n FROM part"),
    "count_column": (QueryPlan(measures=[_m("n", "count_rows", "part.p_brand")]), "SELECT count(p_brand) AS n FROM part"),
    "max_above_grain": (QueryPlan("breakdown", measures=[_m("largest", "max", "orders.o_totalprice")], dimensions=[_dim("part.p_brand")]), "SELECT p_brand, max(o_totalprice) AS largest FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "orders_last_month": (_count_in("last_month"), _n("o_orderdate >= '2001-06-01' AND o_orderdate < '2001-07-01'")),
    "orders_last_week": (_count_in("last_week"), _n("o_orderdate >= '2001-07-09' AND o_orderdate < '2001-07-16'")),
    "orders_last_year": (_count_in("last_year"), _n("o_orderdate >= '2000-01-01' AND o_orderdate < '2001-01-01'")),
    "orders_this_year": (_count_in("this_year"), _n("o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16'")),
    "orders_trailing_weeks": (_count_in("trailing_n_weeks", n=8), _n("o_orderdate >= '2001-05-21' AND o_orderdate < '2001-07-16'")),
    "orders_trailing_months": (_count_in("trailing_n_months", n=3), _n("o_orderdate >= '2001-04-16' AND o_orderdate < '2001-07-16'")),
    "orders_specific_month": (_count_in("specific_month", first=Parts(month=7)), _n("o_orderdate >= '2000-07-01' AND o_orderdate < '2000-08-01'")),
    "orders_specific_quarter": (_count_in("specific_quarter", first=Parts(2000, quarter=2)), _n("o_orderdate >= '2000-04-01' AND o_orderdate < '2000-07-01'")),
    "orders_specific_day": (_count_in("specific_day", first=Parts(2000, 3, 5)), _n("o_orderdate >= '2000-03-05' AND o_orderdate < '2000-03-06'")),
    "orders_since": (_count_in("since_date", first=Parts(2001, 3)), _n("o_orderdate >= '2001-03-01' AND o_orderdate < '2001-07-16'")),
    "orders_before": (_count_in("before_date", first=Parts(1996)), _n("o_orderdate < '1996-01-01'")),
    "orders_between": (_count_in("between_dates", first=Parts(1999, 2), last=Parts(1999, 4)), _n("o_orderdate >= '1999-02-01' AND o_orderdate < '1999-05-01'")),
    "orders_per_month": (QueryPlan("trend", measures=[N_ORDERS], dimensions=[MONTH], window=_on(ORDERED, "this_year")), "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders WHERE o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16' GROUP BY 1"),
    **{
        f"events_per_{g}": (
            QueryPlan("trend", measures=[Measure("n", "count_rows", "events", kind="count")], dimensions=[Dimension(g, "events.ts", "time", g)], window=_on("events.ts", "trailing_n_days", EVENTS, n=14)),
            f"SELECT date_trunc('{g}', ts)::TIMESTAMP AS {g}, count(*) AS n FROM events WHERE ts >= '2024-01-15' AND ts < '2024-01-29' GROUP BY 1",
        )
        for g in ("hour", "day", "week")
    },
    **{
        f"total_per_{g}": (QueryPlan("trend", measures=[TOTAL], dimensions=[Dimension(g, ORDERED, "time", g)]), f"SELECT date_trunc('{g}', o_orderdate)::TIMESTAMP AS {g}, sum({D})::DOUBLE AS total FROM orders GROUP BY 1")
        for g in ("quarter", "year")
    },
    "top_brands_per_nation": (
        QueryPlan("ranking", measures=[_m("quantity", "sum", "lineitem.l_quantity")], dimensions=[NATION, _dim("part.p_brand", "brand")], per_group=("nation", 3), paths={"lineitem->nation": ("lineitem.l_suppkey->supplier", "supplier.s_nationkey->nation")}),
        "WITH g AS (SELECT n_name AS nation, p_brand AS brand, sum(l_quantity::VARCHAR::DECIMAL(38,12))::DOUBLE AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT nation, brand, quantity FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY quantity DESC, brand) AS r FROM g) WHERE r <= 3",
    ),
    "latest_order_per_customer": (
        QueryPlan("lookup", "orders", projections=["orders.o_custkey", "orders.o_orderkey", ORDERED], distinct_on=("orders.o_custkey", ORDERED, True), window=_on(ORDERED, "last_quarter")),
        "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderdate >= '2001-04-01' AND o_orderdate < '2001-07-01') WHERE r = 1 ORDER BY o_orderkey LIMIT 1000",
    ),
    "share_by_status": (QueryPlan("breakdown", measures=[N_ORDERS], dimensions=[_dim("orders.o_orderstatus")], derived="share_of_total"), "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS share_pct FROM orders GROUP BY 1"),
    "running_total_by_month": (_month_series(derived="running_total"), f"SELECT *, sum(total) OVER (ORDER BY month) AS running_total FROM ({TREND})"),
    "change_by_month": (_month_series(derived="change_vs_previous"), f"SELECT *, total - lag(total) OVER (ORDER BY month) AS change FROM ({TREND})"),
    "pct_change_by_month": (_month_series(derived="pct_change_vs_previous"), f"SELECT *, round((total / lag(total) OVER (ORDER BY month) - 1) * 100, 2) AS pct_change FROM ({TREND})"),
    "moving_average_by_month": (_month_series(derived="moving_average"), f"SELECT *, round(avg(total) OVER (ORDER BY month ROWS 2 PRECEDING), 2) AS moving_avg_3 FROM ({TREND})"),
    "rank_by_nation": (QueryPlan("breakdown", measures=[TOTAL], dimensions=[NATION], derived="rank"), f"SELECT *, rank() OVER (ORDER BY total DESC) AS rank FROM (SELECT n_name AS nation, sum({D})::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"),
    "orders_without_lines": (QueryPlan(measures=[N_ORDERS], existence=[Existence("lineitem", True)]), _n("NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")),
    "customers_with_urgent": (
        QueryPlan(measures=[Measure("n", "count_rows", "customer", kind="count")], existence=[Existence("orders", False, (Predicate("orders.o_orderpriority", "eq", ("1-URGENT",)),), _on(ORDERED, "last_quarter"))]),
        _n("EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate >= '2001-04-01' AND o_orderdate < '2001-07-01')", "customer"),
    ),
    "customers_without_recent": (
        QueryPlan("breakdown", measures=[Measure("n", "count_rows", "customer", kind="count")], dimensions=[_dim("customer.c_mktsegment")], existence=[Existence("orders", True, period=_on(ORDERED, "this_year"))]),
        "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16') GROUP BY 1",
    ),
    "orders_of_brand": (
        QueryPlan("lookup", "orders", projections=["orders.o_orderkey", "orders.o_totalprice"], filters=[Predicate("part.p_brand", "eq", ("Brand#12",))], limit=50),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#12') ORDER BY o_orderkey LIMIT 50",
    ),
    "customers_of_parent": (
        QueryPlan(measures=[Measure("n", "count_rows", "customer", kind="count")], existence=[Existence("nation", True, (Predicate("nation.n_name", "starts_with", ("a",)),))]),
        "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT n_name ILIKE 'a%'",
    ),
    "customers_over_five": (
        QueryPlan("lookup", "customer", dimensions=[Dimension("customer", kind="entity", table="customer")], having=Having(N_ORDERS, "gt", (5,)), window=_on(ORDERED, "specific_year", first=Parts(2000))),
        "SELECT c_custkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '2000-01-01' AND o_orderdate < '2001-01-01' GROUP BY ALL HAVING count(*) > 5 ORDER BY n DESC, c_custkey, c_name LIMIT 5000",
    ),
    "parts_over_quantity": (
        QueryPlan("breakdown", dimensions=[Dimension("part", kind="entity", table="part")], having=Having(Measure("quantity", "sum", "lineitem", "lineitem.l_quantity"), "gt", (1100,))),
        "SELECT p_partkey, p_name, sum(l_quantity::VARCHAR::DECIMAL(38,12))::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING quantity > 1100 ORDER BY quantity DESC, p_partkey LIMIT 5000",
    ),
    "having_neq": (
        QueryPlan("breakdown", measures=[N_ORDERS], dimensions=[_dim("customer.c_custkey")], having=Having(N_ORDERS, "neq", (10,))),
        "SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) <> 10 ORDER BY n DESC, c_custkey LIMIT 5000",
    ),
    "having_lookup": (
        QueryPlan("lookup", "customer", dimensions=[Dimension("customer", kind="entity", table="customer")], having=Having(_m("average", "avg", "orders.o_totalprice"), "gte", (300000,))),
        f"SELECT c_custkey, c_name, round(sum({D})::DOUBLE / count(o_totalprice), 2) AS average FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING sum({D}) >= 300000 * count(o_totalprice) ORDER BY average DESC, c_custkey LIMIT 5000",
    ),
    "having_between": (
        QueryPlan("breakdown", measures=[N_ORDERS], dimensions=[NATION], having=Having(N_ORDERS, "between", (500, 650))),
        "SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) BETWEEN 500 AND 650",
    ),
    "brand_fewest_orders": (
        QueryPlan("ranking", measures=[N_ORDERS], dimensions=[_dim("part.p_brand")], order=[Order("n")], limit=1),
        "SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n, p_brand LIMIT 1",
    ),
    "chasm_customers_suppliers": (
        QueryPlan("breakdown", measures=[Measure("customers", "count_rows", "customer", kind="count"), Measure("suppliers", "count_rows", "supplier", kind="count")], dimensions=[NATION]),
        "SELECT nation, customers, suppliers FROM (SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) FULL JOIN (SELECT n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) USING (nation)",
    ),
    "chasm_totals": (QueryPlan(measures=[TOTAL, Measure("parts", "count_rows", "part", kind="count")]), f"SELECT (SELECT sum({D})::DOUBLE FROM orders) AS total, (SELECT count(*) FROM part) AS parts"),
    "rich_suppliers_empty_nations": (
        QueryPlan("breakdown", measures=[Measure("n", "count_rows", "supplier", kind="count"), _m("balance", "max", "supplier.s_acctbal")], dimensions=[NATION], filters=[Predicate("supplier.s_acctbal", "gt", (9000,))], include_empty=True),
        "SELECT n_name AS nation, count(s_suppkey) AS n, max(s_acctbal) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1",
    ),
    "empty_regions_total": (
        QueryPlan("breakdown", measures=[TOTAL], dimensions=[_dim("nation.n_name", "nation")], filters=[Predicate("orders.o_totalprice", "gt", (495000,))], include_empty=True),
        f"SELECT n_name AS nation, coalesce(sum(p), 0)::DOUBLE AS total FROM nation LEFT JOIN (SELECT c_nationkey, {D} AS p FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 495000) ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "latest_snapshot": (
        QueryPlan(measures=[TOTAL, N_ORDERS], snapshot_latest=ORDERED, window=Period(ORDERED, None, datetime(2001, 7, 16))),
        f"SELECT sum({D})::DOUBLE AS total, count(*) AS n FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < '2001-07-16')",
    ),
    "ytd_vs_last_year": (
        QueryPlan("breakdown", measures=[TOTAL], dimensions=[_dim("orders.o_orderstatus")], compare=(Period(ORDERED, *_THIS), Period(ORDERED, *_LAST))),
        f"SELECT o_orderstatus, sum({D}) FILTER (o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16')::DOUBLE AS total_current, sum({D}) FILTER (o_orderdate >= '2000-01-01' AND o_orderdate < '2000-07-16')::DOUBLE AS total_previous FROM orders WHERE (o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16') OR (o_orderdate >= '2000-01-01' AND o_orderdate < '2000-07-16') GROUP BY 1",
    ),
    "measure_filters": (
        QueryPlan("breakdown", measures=[Measure("open", "sum", "orders", "orders.o_totalprice", filters=(Predicate("orders.o_orderstatus", "eq", ("O",)),)), Measure("done", "count_rows", "orders", kind="count", filters=(Predicate("orders.o_orderstatus", "in", ("F", "P")),))], dimensions=[_dim("orders.o_orderpriority")]),
        f"SELECT o_orderpriority, sum({D}) FILTER (o_orderstatus = 'O')::DOUBLE AS open, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS done FROM orders GROUP BY 1",
    ),
    "shipping_time": (
        QueryPlan("breakdown", measures=[Measure("average", "avg", "lineitem", ORDERED, "duration", "lineitem.l_shipdate"), Measure("median", "median", "lineitem", ORDERED, "duration", "lineitem.l_shipdate"), Measure("longest", "max", "lineitem", ORDERED, "duration", "lineitem.l_shipdate")], dimensions=[_dim("lineitem.l_returnflag")]),
        "SELECT l_returnflag, round(avg(s), 2) AS average, quantile_disc(s, 0.5) AS median, max(s) AS longest FROM (SELECT l_returnflag, epoch(l_shipdate - o_orderdate)::BIGINT AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1",
    ),
    "pred_neq": (_filtered(Predicate("orders.o_orderstatus", "neq", ("F",))), _n("o_orderstatus <> 'F' OR o_orderstatus IS NULL")),
    "pred_in": (_filtered(Predicate("orders.o_orderpriority", "in", ("1-URGENT", "2-HIGH"))), _n("o_orderpriority IN ('1-URGENT', '2-HIGH')")),
    "pred_not_in": (_filtered(Predicate("orders.o_orderpriority", "not_in", ("1-URGENT", "2-HIGH"))), _n("o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")),
    "pred_compare": (_filtered(Predicate("part.p_size", "gt", (10,)), Predicate("part.p_size", "lte", (20,)), table="part"), _n("p_size > 10 AND p_size <= 20", "part")),
    "pred_gte_lt": (_filtered(Predicate("part.p_size", "gte", (10,)), Predicate("part.p_size", "lt", (20,)), table="part"), _n("p_size >= 10 AND p_size < 20", "part")),
    "pred_between": (_filtered(Predicate("part.p_size", "between", (5, 15)), table="part"), _n("p_size BETWEEN 5 AND 15", "part")),
    "pred_contains": (_filtered(Predicate("part.p_name", "contains", ("1",)), table="part"), _n("p_name ILIKE '%1%'", "part")),
    "pred_starts_with": (_filtered(Predicate("part.p_brand", "starts_with", ("brand#1",)), table="part"), _n("p_brand ILIKE 'brand#1%'", "part")),
    "pred_escape": (_filtered(Predicate("part.p_name", "contains", ("%_",)), table="part"), _n("contains(p_name, '%_')", "part")),
    "pred_null": (_filtered(Predicate("orders.o_orderdate", "is_null")), _n("o_orderdate IS NULL")),
    "pred_not_null": (_filtered(Predicate("orders.o_orderdate", "is_not_null")), _n("o_orderdate IS NOT NULL")),
    "pred_flag_true": (_filtered(Predicate("lineitem.l_linenumber", "is_true"), table="lineitem"), _n("l_linenumber = 1", "lineitem")),
    "pred_flag_false": (_filtered(Predicate("lineitem.l_linenumber", "is_false"), table="lineitem"), _n("l_linenumber = 0 OR l_linenumber IS NULL", "lineitem")),
    "distinct_statuses": (QueryPlan("lookup", "orders", projections=["orders.o_orderstatus"], distinct=True), "SELECT DISTINCT o_orderstatus FROM orders"),
    "lookup_largest": (
        QueryPlan("lookup", "orders", projections=["orders.o_orderkey", "orders.o_totalprice", "customer.c_name", "nation.n_name"], order=[Order("o_totalprice", True)], limit=25),
        "SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    ),
    "lookup_default": (QueryPlan("lookup", "supplier", limit=20), "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 20"),
    "default_row_count": (QueryPlan("breakdown", dimensions=[_dim("part.p_type")]), "SELECT p_type, count(*) AS count FROM part GROUP BY 1"),
    "ranking_default": (QueryPlan("ranking", measures=[TOTAL], dimensions=[Dimension("customer", kind="entity", table="customer")]), f"SELECT c_custkey, c_name, sum({D})::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY total DESC, c_custkey LIMIT 10"),
}


def brand_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a size and of all sizes below it in a tree where size n hangs under n // 2: predicates that follow a self-reference."""
    b = engine(spark, sf_dir)
    sizes = b.frames["part"].selectExpr("p_size AS id", "CASE WHEN p_size > 1 THEN cast(p_size / 2 AS int) END AS parent_id", "concat('size ', p_size) AS name").distinct()
    number = ColumnModel("id", "number", "int", unique=True, primary=True, role="identifier")
    b.frames["sizes"] = sizes
    b.model.tables["sizes"] = TableModel("sizes", {"id": number, "parent_id": ColumnModel("parent_id", "number", "int"), "name": ColumnModel("name", "text", "string")}, ("id",))
    b.model.relationships += [Relationship("part", ("p_size",), "sizes", ("id",)), Relationship("sizes", ("parent_id",), "sizes", ("id",))]
    own = Builder(b.model, b.frames, b.settings)
    return own.build(QueryPlan("breakdown", measures=[Measure("n", "count_rows", "part", kind="count")], dimensions=[_dim("part.p_brand")], filters=[Predicate("sizes.name", "eq", ("size 5",), hierarchy=True)]))


_TREE = "WITH RECURSIVE d(id) AS (SELECT 5 UNION SELECT p_size FROM part JOIN d ON p_size // 2 = id AND p_size > 1) SELECT p_brand, count(*) AS n FROM part WHERE p_size IN (SELECT id FROM d) GROUP BY 1"


def _changed(spark: SparkSession, sf_dir: str, table: str, column: str, value, type_: str, zone: str = "UTC", **more) -> Builder:
    """The engine with a column computed anew."""
    b = engine(spark, sf_dir)
    frames = b.frames | {table: b.frames[table].withColumn(column, value)}
    b.model.tables[table].columns[column] = ColumnModel(column, "timestamp" if type_ == "timestamp" else "number", type_, **more)
    return Builder(b.model, frames, Settings(zone=zone))


def sum_small_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousandths of a cent are not lost."""
    b = _changed(spark, sf_dir, "events", "value", F.round(F.col("value") / 1000, 6), "double", role="measure_additive")
    return b.build(QueryPlan("breakdown", measures=[_m("total", "sum", "events.value")], dimensions=[_dim("events.event_type")]))


def avg_unrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the average is rounded, not what it is of."""
    b = _changed(spark, sf_dir, "events", "value", F.round(F.col("value") / 8, 6), "double", role="measure_additive")
    return b.build(QueryPlan("breakdown", measures=[_m("average", "avg", "events.value")], dimensions=[_dim("events.event_type")]))


def having_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents are shown as money and compared as cents."""
    b = _changed(spark, sf_dir, "orders", "total_cents", F.round(F.col("o_totalprice") * 100).cast("long"), "bigint", role="measure_additive", unit=Unit("money", 100))
    total = _m("total", "sum", "orders.total_cents")
    return b.build(QueryPlan("breakdown", measures=[total], dimensions=[_dim("customer.c_custkey")], having=Having(total, "gt", (400_000_000,))))


def events_per_day_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by the day of another zone, in a window of that zone's wall-clock times."""
    moments = F.expr("timestamp_seconds(0) + (ts - timestamp_ntz'1970-01-01 00:00:00')")
    b = _changed(spark, sf_dir, "events", "ts", moments, "timestamp", "America/Los_Angeles", role="timestamp_event")
    return b.build(QueryPlan("trend", measures=[Measure("n", "count_rows", "events", kind="count")], dimensions=[Dimension("day", "events.ts", "time", "day")], window=_on("events.ts", "trailing_n_days", EVENTS, n=14)))


_SMALL = "(value::VARCHAR::DECIMAL(18,6) * {}::DECIMAL(4,3))"
_CENTS = "round(o_totalprice * 100)::BIGINT"
#: name -> (query, SQL)
CHANGED = {
    "sum_small_fractions": (sum_small_fractions, f"SELECT event_type, sum({_SMALL.format(0.001)})::DOUBLE AS total FROM events GROUP BY 1"),
    "avg_unrounded": (avg_unrounded, f"SELECT event_type, round(sum({_SMALL.format(0.125)})::DOUBLE / count(value), 2) AS average FROM events GROUP BY 1"),
    "having_scaled": (having_scaled, f"SELECT c_custkey, round(sum({_CENTS})::DOUBLE / 100, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING sum({_CENTS}) > 400000000 ORDER BY total DESC, c_custkey LIMIT 5000"),
    "events_per_day_zone": (events_per_day_zone, "SELECT date_trunc('day', ts - INTERVAL 8 HOUR)::TIMESTAMP AS day, count(*) AS n FROM events WHERE ts - INTERVAL 8 HOUR >= '2024-01-15' AND ts - INTERVAL 8 HOUR < '2024-01-29' GROUP BY 1"),
}


@functools.lru_cache(maxsize=4)
def _composer(application: str, sf_dir: str) -> Composer:
    """Profiled once for each application and folder; the profile is what words are matched with."""
    b = engine(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), sf_dir)
    for name, table in b.model.tables.items():
        profile(b.frames[name], table)
    return Composer(b.model, b.frames, CLOCK)


def asked(spark: SparkSession, sf_dir: str, request: str, answers: tuple[str, ...] = (), shown: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """A request in words, with the answers to what is asked back, as a DataFrame.

    shown: its columns, where they must not depend on whether names repeat; whole: all groups, without the engine's cap.
    """
    c = _composer(spark.sparkContext.applicationId, sf_dir)
    r = c.compose(request)
    for a in answers:
        r = c.answer(r.clarification.id, a)
    if r.outcome != "execute":
        raise PlanError(f"{request}: {r.outcome} {r.reason or r.clarification.question}")
    b = Builder(c.model, c.frames, replace(c.builder.settings, max_rows=None)) if whole else c.builder
    df = b.build(r.plan)
    return df.select(*shown) if shown else df


_YEAR = "o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16'"
_NATION = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_MONTHS = f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum({D})::DOUBLE AS sum_o_totalprice FROM orders WHERE {_YEAR} GROUP BY 1"

#: name -> (request, answers, SQL)
REQUESTS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "ask_count": ("How many orders were placed last month?", (), _n("o_orderdate >= '2001-06-01' AND o_orderdate < '2001-07-01'")),
    "ask_two_measures": ("Number of orders and total order value by nation last quarter", (), f"SELECT n_name, count(*) AS n, sum({D})::DOUBLE AS sum_o_totalprice FROM {_NATION} WHERE o_orderdate >= '2001-04-01' AND o_orderdate < '2001-07-01' GROUP BY 1"),
    "ask_two_aggregates": ("Average quantity and total quantity by return flag", (), "SELECT l_returnflag, round(sum(l_quantity::VARCHAR::DECIMAL(38,12))::DOUBLE / count(l_quantity), 2) AS avg_l_quantity, sum(l_quantity::VARCHAR::DECIMAL(38,12))::DOUBLE AS sum_l_quantity FROM lineitem GROUP BY 1"),
    "ask_columns": ("List the name and size of parts in Brand#12", (), "SELECT p_name, p_size FROM part WHERE p_brand = 'Brand#12' ORDER BY p_partkey LIMIT 1000"),
    "ask_distinct": ("List the distinct status of orders", (), "SELECT DISTINCT o_orderstatus FROM orders"),
    "ask_contains": ('How many parts have a name containing "widget"?', (), _n("p_name ILIKE '%widget%'", "part")),
    "ask_starts_with": ('How many parts have a name starting with "red"?', (), _n("p_name ILIKE 'red%'", "part")),
    "ask_between": ("Number of parts with size between 5 and 15", (), _n("p_size BETWEEN 5 AND 15", "part")),
    "ask_missing": ("How many orders have no order date?", (), _n("o_orderdate IS NULL")),
    "ask_excluded": ("How many parts are not in Brand#12 and Brand#13?", (), _n("p_brand NOT IN ('Brand#12', 'Brand#13')", "part")),
    "ask_recent": ("List the 20 most recent orders over $400,000", (), "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"),
    "ask_largest_rows": ("Top 10 orders by total price", (), "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "ask_top_in_each": ("Top 2 brands by number of parts in each type", (), "SELECT p_type, p_brand, n FROM (SELECT p_type, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2) WHERE r <= 2"),
    "ask_having_between": ("Which customers have between 5 and 8 orders in 2000?", (), "SELECT c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '2000-01-01' AND o_orderdate < '2001-01-01' GROUP BY c_custkey, c_name HAVING count(*) BETWEEN 5 AND 8"),
    "ask_absent": ("How many customers have no orders in 2001?", (), _n("NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '2001-01-01' AND o_orderdate < '2002-01-01')", "customer")),
    "ask_compare": ("Total order value this year compared to last year by status", (), f"SELECT o_orderstatus, sum({D}) FILTER ({_YEAR})::DOUBLE AS sum_o_totalprice_current, sum({D}) FILTER (o_orderdate >= '2000-01-01' AND o_orderdate < '2000-07-16')::DOUBLE AS sum_o_totalprice_previous FROM orders WHERE ({_YEAR}) OR (o_orderdate >= '2000-01-01' AND o_orderdate < '2000-07-16') GROUP BY 1"),
    "ask_moving_average": ("Moving average of order value by month this year", (), f"SELECT *, round(avg(sum_o_totalprice) OVER (ORDER BY month ROWS 2 PRECEDING), 2) AS moving_avg_3 FROM ({_MONTHS})"),
    "ask_rank": ("Rank nations by total order value", (), f"SELECT *, rank() OVER (ORDER BY sum_o_totalprice DESC) AS rank FROM (SELECT n_name, sum({D})::DOUBLE AS sum_o_totalprice FROM {_NATION} GROUP BY 1)"),
    "ask_fewest": ("Which brand has the fewest orders?", (), "SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n, p_brand LIMIT 1"),
    "ask_median": ("Median total price by priority", (), "SELECT o_orderpriority, round(median(o_totalprice), 2) AS median_o_totalprice FROM orders GROUP BY 1"),
    "ask_business_term": ("Total revenue by priority", ("column:orders.o_totalprice",), f"SELECT o_orderpriority, sum({D})::DOUBLE AS sum_o_totalprice FROM orders GROUP BY 1"),
    "ask_fan_out": ("Total order value by brand", ("column:lineitem.l_extendedprice",), "SELECT p_brand, sum(l_extendedprice::VARCHAR::DECIMAL(38,12))::DOUBLE AS sum_l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "ask_threshold_row": ("orders over $495,000", (), "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 495000 ORDER BY o_orderkey LIMIT 1000"),
    "ask_threshold_group": ("Total order value by customer over $4,000,000", (), f"SELECT c_name, sum({D})::DOUBLE AS sum_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING sum({D}) > 4000000 ORDER BY 2 DESC, c_custkey LIMIT 5000"),
    "ask_mtd": ("Number of orders month to date", (), _n("o_orderdate >= '2001-07-01' AND o_orderdate < '2001-07-16'")),
    "ask_last_quarters": ("How many orders were placed in the last 2 quarters?", (), _n("o_orderdate >= '2001-01-16' AND o_orderdate < '2001-07-16'")),
    "ask_past_week": ("How many orders in the past week?", (), _n("o_orderdate >= '2001-07-09' AND o_orderdate < '2001-07-16'")),
    "ask_latest_each": ("List the latest order of each customer", (), "SELECT o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000"),
}

#: What the SQL of a request fixes beyond what the engine would choose.
FIXED: dict[str, dict] = {
    "ask_having_between": {"shown": ("c_name", "n"), "whole": True},
    "ask_threshold_group": {"shown": ("c_name", "sum_o_totalprice")},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, plan=plan: engine(spark, sf_dir).build(plan)) for name, (plan, _) in PLANS.items()}
    spoken = {name: (lambda spark, sf_dir, r=r, a=a, more=FIXED.get(name, {}): asked(spark, sf_dir, r, a, **more)) for name, (r, a, _) in REQUESTS.items()}
    return out | spoken | {name: f for name, (f, _) in CHANGED.items()} | {"hierarchy_descendants": brand_hierarchy}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items()} | {name: sql for name, (_, _, sql) in REQUESTS.items()} | {name: sql for name, (_, sql) in CHANGED.items()} | {"hierarchy_descendants": _TREE}

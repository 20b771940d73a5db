"""Registered plans against DuckDB, and plans that must be refused."""

import json
from collections import Counter
from dataclasses import replace

import duckdb
import pytest

import __spark_entry__
from askframe import knowledge, queries
from askframe.operators.analyze import Ambiguous, FanOut, PlanError, Unreachable
from askframe.operators.builder import Builder, Settings
from askframe.operators.guard import TimedOut, TooCostly, check_cost, run
from askframe.plans.types import Dimension, Measure, Order, Predicate, QueryPlan
from askframe.sources.catalog import broken_keys, columns_of, drop_broken_keys
from askframe.sources.model import ColumnModel, Relationship, SchemaModel, TableModel, Unit


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in queries.tpch_frames.__globals__["KEYS"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return queries.engine(spark, sf_dir)


SQL = queries.oracle_sql() | knowledge.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_equals_sql(spark, sf_dir, sql, name):
    df = (queries.queries() | knowledge.queries())[name](spark, sf_dir)
    got = sql.execute(SQL[name])

    def rows(names, records):
        at = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in at], Counter(json.dumps([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at], default=str) for r in records)

    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in got.description], got.fetchall())


def test_entry(spark, sf_dir):
    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
    assert {"total", "region"} == set(queries.queries()["flagship_region_last_quarter"](spark, sf_dir).columns)


def test_fan_out_is_refused(engine):
    with pytest.raises(FanOut) as e:
        engine.build(QueryPlan("breakdown", measures=[queries.TOTAL], dimensions=[Dimension("p_brand", "part.p_brand")]))
    assert e.value.options == ["lineitem.l_extendedprice"]


def test_counting_a_keyless_table_above_its_grain_is_refused(engine):
    with pytest.raises(PlanError):
        engine.build(QueryPlan("breakdown", measures=[Measure("n", "count_rows", "lineitem", kind="count")], dimensions=[Dimension("s", "supplier.s_name"), Dimension("e", "events.event_type")]))


def test_unrelated_tables(engine):
    with pytest.raises(Unreachable):
        engine.build(QueryPlan("breakdown", measures=[queries.TOTAL], dimensions=[Dimension("e", "events.event_type")]))


def test_empty_groups_need_one_table(engine):
    with pytest.raises(PlanError):
        engine.build(QueryPlan("breakdown", measures=[queries.TOTAL], dimensions=[queries.MONTH], include_empty=True))


def test_filters_reach_the_scan(engine):
    plan = engine.build(queries.PLANS["orders_last_month"][0])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_only_needed_tables_are_joined(engine):
    plan = engine.build(queries.PLANS["avg_by_priority"][0])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "customer" not in plan


def test_limits(engine):
    df = engine.build(queries.PLANS["sum_by_nation"][0])
    assert len(run(df, 60)) > 0
    with pytest.raises(TooCostly):
        check_cost(df, 10)
    slow = engine.frames["lineitem"].selectExpr("l_orderkey AS a").crossJoin(engine.frames["lineitem"].selectExpr("l_orderkey AS b")).selectExpr("sum(sin(a) * cos(b)) AS s")
    with pytest.raises((TooCostly, TimedOut)):
        run(slow, 0.5)


def test_row_cap(engine):
    few = Builder(engine.model, engine.frames, Settings(max_rows=3))
    assert few.build(queries.PLANS["sum_by_nation"][0]).count() == 3


def test_declared_keys_are_checked(engine):
    model = replace_pk(engine.model, "lineitem", ("l_orderkey",))
    assert set(broken_keys(model, engine.frames)) == {"lineitem"}
    assert drop_broken_keys(model, engine.frames) == ["lineitem"] and model.tables["lineitem"].pk == ()


def replace_pk(model, table, pk):
    return SchemaModel({n: replace(t, pk=pk if n == table else t.pk) for n, t in model.tables.items()}, list(model.relationships))


@pytest.fixture(scope="module")
def shop(spark):
    """Two ways from an order to an address; cents; soft delete; snapshots."""
    frames = {
        "orders": spark.createDataFrame([(1, 1, 2, 1999, None), (2, 1, 1, 501, None), (3, 2, 1, 1000, "x")], "id int, billing_id int, shipping_id int, total_cents int, deleted string"),
        "addresses": spark.createDataFrame([(1, "North"), (2, "South"), (3, None)], "id int, city string"),
    }
    model = SchemaModel({n: TableModel(n, columns_of(df), ("id",)) for n, df in frames.items()})
    model.tables["orders"].columns["total_cents"].role = "measure_additive"
    model.tables["orders"].columns["total_cents"].unit = Unit("money", 100)
    model.relationships = [Relationship("orders", ("billing_id",), "addresses", ("id",), role="billing"), Relationship("orders", ("shipping_id",), "addresses", ("id",), role="shipping")]
    return Builder(model, frames)


def test_two_paths_are_ambiguous_until_pinned(shop):
    total = Measure("total", "sum", "orders", "orders.total_cents")
    plan = QueryPlan("breakdown", measures=[total], dimensions=[Dimension("city", "addresses.city")], order=[Order("city")])
    with pytest.raises(Ambiguous) as e:
        shop.build(plan)
    assert e.value.options == ["billing", "shipping"]
    pinned = replace(plan, paths={"orders->addresses": ("orders.shipping_id->addresses",)})
    assert [tuple(r) for r in shop.build(pinned).collect()] == [("North", 15.01), ("South", 19.99)]


def test_null_safe_predicates(shop):
    n = Measure("n", "count_rows", "addresses", kind="count")

    def count(*p):
        return shop.build(QueryPlan(measures=[n], filters=list(p))).first()[0]

    assert count(Predicate("addresses.city", "neq", ("North",))) == 2
    assert count(Predicate("addresses.city", "not_in", ("North", "South"))) == 1
    assert count(Predicate("addresses.city", "contains", ("ORT",))) == 1
    with pytest.raises(ValueError):
        Predicate("addresses.city", "like")


def test_soft_delete(shop):
    shop.model.tables["orders"].soft_delete = "deleted"
    shop.model.tables["orders"].columns["deleted"].kind = "timestamp"
    assert shop.build(QueryPlan(measures=[Measure("n", "count_rows", "orders", kind="count")], soft_delete=True)).first()[0] == 2


def test_all_values_below(spark):
    """More values below the one asked for than result rows are allowed, and a row that is its own parent."""
    rows = [(0, 0, "n0", "x")] + [(i, (i - 1) // 100, f"n{i}", "x") for i in range(1, 6001)] + [(9000, None, "other", "x")]
    frames = {"nodes": spark.createDataFrame(rows, "id int, parent_id int, name string, kind string")}
    columns = {"id": ColumnModel("id", "number", "int", unique=True, primary=True, role="identifier"), "parent_id": ColumnModel("parent_id", "number", "int"), "name": ColumnModel("name", "text", "string"), "kind": ColumnModel("kind", "text", "string")}
    model = SchemaModel({"nodes": TableModel("nodes", columns, ("id",))}, [Relationship("nodes", ("parent_id",), "nodes", ("id",))])
    plan = QueryPlan("breakdown", measures=[Measure("n", "count_rows", "nodes", kind="count")], dimensions=[Dimension("kind", "nodes.kind")], filters=[Predicate("nodes.name", "eq", ("n0",), hierarchy=True)])
    assert [r.n for r in Builder(model, frames).build(plan).collect()] == [6001]

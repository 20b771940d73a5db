"""Nothing said is left out, nothing summed is rounded first, names and zones of any kind."""

import warnings
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from askframe.functions.periods import Clock, PeriodSpec
from askframe.language.composer import Composer
from askframe.language.spans import extract_spans
from askframe.operators.builder import Builder, Settings
from askframe.operators.guard import plan_bytes
from askframe.plans.types import Dimension, Having, Measure, Period, Predicate, QueryPlan
from askframe.sources.catalog import columns_of, parquet_frames, plain_names
from askframe.sources.conventions import Config, build_model
from askframe.sources.model import Relationship, SchemaModel, TableModel, Unit

NOW = Clock(datetime(2026, 10, 5))
T = datetime


def table(name, df, pk=("id",), **roles):
    t = TableModel(name, columns_of(df), pk)
    for c, role in roles.items():
        t.columns[c].role = role
    return t


def one(spark, rows, ddl, **roles):
    df = spark.createDataFrame(rows, ddl)
    return Builder(SchemaModel({"t": table("t", df, **roles)}), {"t": df})


def value(b, agg, column="t.x", **more):
    return b.build(QueryPlan(measures=[Measure("m", agg, "t", column)], **more)).first()[0]


def test_sums_are_exact(spark):
    b = one(spark, [(i, 0.001) for i in range(1000)], "id int, x double")
    assert value(b, "sum") == 1.0
    assert value(one(spark, [(1, 1e17), (2, 0.25), (3, None)], "id int, x double"), "sum") == 1e17
    assert value(one(spark, [(1, 0.1), (2, 0.2)], "id int, x double"), "sum") == 0.3
    assert value(one(spark, [(1, 1e300), (2, 1e-300)], "id int, x double"), "sum") == 1e300
    assert value(one(spark, [(1, float("inf")), (2, 1.0)], "id int, x double"), "sum") == float("inf")
    assert value(one(spark, [(1, None)], "id int, x double"), "sum") is None
    assert value(one(spark, [(1, Decimal("0.00001")), (2, Decimal("12345678901234567890.12345"))], "id int, x decimal(25,5)"), "sum") == Decimal("12345678901234567890.12346")
    assert value(one(spark, [(1, 0.125), (2, 0.125), (3, 0.124)], "id int, x double"), "avg") == 0.12
    assert value(one(spark, [(1, 1), (2, 2)], "id int, x int"), "avg") == 1.5
    assert value(one(spark, [(1, Decimal("1.005")), (2, Decimal("1.005"))], "id int, x decimal(10,3)"), "avg") == 1.01


@pytest.mark.parametrize("op, values, expected", [("gt", (10000,), ["a", "b"]), ("neq", (20000,), ["b"]), ("between", (20000, 20000), ["a"]), ("lt", (20000,), [])])
def test_having_compares_base_units(spark, op, values, expected):
    b = one(spark, [(1, 10000, "a"), (2, 10000, "a"), (3, 20001, "b")], "id int, x int, g string", x="measure_additive")
    b.model.tables["t"].columns["x"].unit = Unit("money", 100)
    m = Measure("m", "sum", "t", "t.x")
    got = b.build(QueryPlan("breakdown", measures=[m], dimensions=[Dimension("g", "t.g")], having=Having(m, op, values)))
    assert got.columns == ["g", "m"] and sorted(r.g for r in got.collect()) == expected


def test_having_in_all_forms(spark):
    orders = spark.createDataFrame([(1, 1, 1.004, T(2026, 1, 1)), (2, 1, 1.0, T(2025, 1, 1)), (3, 2, 3.0, T(2026, 1, 1))], "id int, who int, x double, at timestamp_ntz")
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    model = SchemaModel({"orders": table("orders", orders, x="measure_additive"), "people": table("people", people)}, [Relationship("orders", ("who",), "people", ("id",))])
    b = Builder(model, {"orders": orders, "people": people})
    m, name = Measure("m", "avg", "orders", "orders.x"), Dimension("name", "people.name")
    total = Measure("s", "sum", "orders", "orders.x")

    def names(**more):
        return sorted(r.name for r in b.build(QueryPlan("breakdown", dimensions=[name], **more)).collect())

    assert names(measures=[m], having=Having(m, "gt", (1.001,))) == ["a", "b"]  # 1.002, shown as 1.00
    assert names(measures=[total], having=Having(total, "lt", (1,)), include_empty=True) == ["c"]
    year = [Period("orders.at", T(y, 1, 1), T(y + 1, 1, 1)) for y in (2026, 2025)]
    assert names(measures=[total], having=Having(total, "gt", (2,)), compare=tuple(year)) == ["b"]
    assert names(measures=[total, Measure("n", "count_rows", "people", kind="count")], having=Having(total, "gt", (2,))) == ["a", "b"]


def test_moments_in_a_zone(spark):
    rows = [(1, "2026-01-01 07:59:59"), (2, "2026-01-01 08:00:00"), (3, "2026-07-02 06:59:59")]
    df = spark.createDataFrame(rows, "id int, s string").select("id", F.expr("timestamp_seconds(0) + (to_timestamp_ntz(s) - timestamp_ntz'1970-01-01 00:00:00')").alias("at"))
    model = SchemaModel({"t": table("t", df, at="timestamp_event")})
    b = Builder(model, {"t": df}, Settings(zone="America/Los_Angeles"))
    n = Measure("n", "count_rows", "t", kind="count")
    got = b.build(QueryPlan("trend", measures=[n], dimensions=[Dimension("day", "t.at", "time", "day")])).collect()
    assert [(r.day, r.n) for r in got] == [(T(2025, 12, 31), 1), (T(2026, 1, 1), 1), (T(2026, 7, 1), 1)]
    assert b.build(QueryPlan(measures=[n], window=Period("t.at", T(2026, 1, 1), T(2026, 7, 2)))).first()[0] == 2
    assert b.build(QueryPlan(measures=[n], filters=[Predicate("t.at", "gte", (T(2026, 7, 1),))])).first()[0] == 1
    c = Composer(model, {"t": df}, Clock(T(2026, 7, 2), "America/Los_Angeles"))
    assert [tuple(r) for r in c.execute(c.compose("How many t per day this year?"))] == [(T(2026, 1, 1), 1), (T(2026, 7, 1), 1)]


def test_names_with_dots_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "id int, `my.city name` string, `a.b` double")
    assert plain_names(df).columns == ["id", "my_city name", "a_b"]
    assert plain_names(df.withColumn("a_b", F.lit(1))).columns == ["id", "my_city name", "a_b_2", "a_b"]
    df.write.parquet(f"{tmp_path}/the.rows.parquet")
    frames = parquet_frames(spark, str(tmp_path))
    assert set(frames) == {"the_rows"}
    b = Builder(build_model(frames), frames)
    got = b.build(QueryPlan("breakdown", measures=[Measure("m", "sum", "the_rows", "the_rows.a_b")], dimensions=[Dimension("city", "the_rows.my_city name")]))
    assert sorted(map(tuple, got.collect())) == [("x", 2.0), ("y", 3.0)]


def test_cost_adds_up(spark, sf_dir):
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    assert plan_bytes(both)[0] > max(plan_bytes(orders.select("o_orderkey"))[0], plan_bytes(lines)[0])
    assert plan_bytes(spark.createDataFrame([(1,)], "a int").join(orders, F.col("a") == F.col("o_orderkey")))[1] == 1


@pytest.mark.parametrize(
    "text, key, n",
    [
        ("in the last 2 quarters", "trailing_n_months", 6),
        ("past week", "trailing_n_weeks", 1),
        ("previous 3 months", "trailing_n_months", 3),
        ("prior year", "last_year", 1),
        ("last thirty days", "trailing_n_days", 30),
        ("over the trailing 1 month", "trailing_n_months", 1),
        ("MTD", "this_month", 1),
        ("quarter-to-date", "this_quarter", 1),
        ("YTD", "this_year", 1),
        ("last day", "yesterday", 1),
    ],
)
def test_relative_periods(text, key, n):
    spans = extract_spans(f"orders {text}")
    assert [(s.value.key, s.value.n) for s in spans if isinstance(s.value, PeriodSpec)] == [(key, n)] and not [s for s in spans if s.kind == "number"]


def test_september_is_short_too():
    assert [s.value.first.month for s in extract_spans("orders in Sept 2025")] == [9]


@pytest.fixture(scope="module")
def shop(spark):
    """One measure column only."""
    frames = {
        "customers": spark.createDataFrame([(1, "Ann"), (2, "Bob")], "id int, name string"),
        "orders": spark.createDataFrame([(1, 1, 5000, T(2026, 9, 1)), (2, 1, 6000, T(2026, 9, 2)), (3, 2, 10500, T(2026, 9, 3)), (4, 2, 100, T(2026, 3, 1))], "id int, customer_id int, amount_cents int, placed_at timestamp_ntz"),
    }
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return Composer(build_model(frames, Config(display={"customers": ("name",)})), frames, NOW)


@pytest.mark.filterwarnings("ignore")
def test_amounts_are_conditions(shop):
    r, rows = shop.ask("orders over $100")
    assert r.outcome == "execute" and [x.id for x in rows] == [3]
    r, rows = shop.ask("total amount by customer over $108")
    assert r.outcome == "execute" and [tuple(x)[-1] for x in rows] == [110.0], (r.reason, r.clarification)
    r, rows = shop.ask("How many orders in the last 2 quarters?")
    assert r.outcome == "execute" and r.plan.limit is None and [tuple(x) for x in rows] == [(3,)]


@pytest.mark.filterwarnings("ignore")
def test_unused_parts_are_asked_about(shop):
    r = shop.compose("How many orders with 7 reasons?")
    assert r.outcome == "clarify" and "7" in r.clarification.question
    r = shop.answer(r.clarification.id, "none")  # the number is left out; the word is asked about next
    assert r.outcome == "clarify" and "reasons" in r.clarification.question
    assert shop.answer(r.clarification.id, "run it").outcome == "execute" and shop.answer(r.clarification.id, "rephrase").outcome == "decline"
    r = shop.compose("How many orders in March 2026 and in September 2026?")
    assert r.outcome == "clarify" and r.clarification.options == ["March 2026", "September 2026"]
    done = shop.answer(r.clarification.id, "March 2026")
    assert done.outcome == "execute" and [tuple(x) for x in shop.execute(done)] == [(1,)]

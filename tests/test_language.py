"""Periods, spans, words, decoding, conventions and whole requests."""

import http.client
import itertools
import json
import threading
from datetime import datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askframe import queries
from askframe.functions.periods import Clock, Parts, PeriodSpec, instant, period_bounds, shift_years
from askframe.language.composer import Composer
from askframe.language.details import between_pairs, measure_clauses, text_matches
from askframe.language.harness import Case, check, evaluate, load_cases, matches
from askframe.language.heuristic import HeuristicOracle
from askframe.language.lexicon import plural, singular, snake, stem
from askframe.language.oracle import CachingOracle, HttpOracle, LogprobOracle, Question, RecordingOracle, margin
from askframe.language.saved import FolderStore
from askframe.language.spans import extract_spans
from askframe.plans.decode import assign_spans, assignment, joint_decode
from askframe.plans.types import Measure, Predicate
from askframe.plans.describe import narrate, signature
from askframe.server import serve
from askframe.sources.conventions import Config, build_model
from askframe.sources.doctor import doctor
from askframe.sources.lockfile import is_stale, read_lockfile, write_lockfile
from askframe.sources.profile import profile

NOW = Clock(datetime(2026, 10, 5))


def bounds(key, clock=NOW, **more):
    return tuple(t and t.strftime("%Y-%m-%d") for t in period_bounds(PeriodSpec(key, **more), clock))


@pytest.mark.parametrize(
    "key, more, expected",
    [
        ("last_month", {}, ("2026-09-01", "2026-10-01")),
        ("last_quarter", {}, ("2026-07-01", "2026-10-01")),
        ("this_year", {}, ("2026-01-01", "2026-10-05")),
        ("last_year", {}, ("2025-01-01", "2026-01-01")),
        ("last_week", {}, ("2026-09-28", "2026-10-05")),
        ("this_month", {}, ("2026-10-01", "2026-10-05")),
        ("trailing_n_weeks", {"n": 8}, ("2026-08-10", "2026-10-05")),
        ("specific_month", {"first": Parts(month=9)}, ("2026-09-01", "2026-10-01")),
        ("specific_month", {"first": Parts(month=11)}, ("2025-11-01", "2025-12-01")),
        ("specific_month", {"first": Parts(month=10)}, ("2025-10-01", "2025-11-01")),
        ("specific_quarter", {"first": Parts(2026, quarter=2)}, ("2026-04-01", "2026-07-01")),
        ("since_date", {"first": Parts(2026, 3)}, ("2026-03-01", "2026-10-05")),
        ("before_date", {"first": Parts(2026, 3)}, (None, "2026-03-01")),
        ("between_dates", {"first": Parts(2026, 3), "last": Parts(2026, 5)}, ("2026-03-01", "2026-06-01")),
        ("none", {}, (None, None)),
    ],
)
def test_periods(key, more, expected):
    assert bounds(key, **more) == expected


def test_weeks_and_zones():
    assert bounds("last_week", Clock(datetime(2026, 10, 5), week_start=6)) == ("2026-09-27", "2026-10-04")
    assert instant(datetime(2026, 9, 1), "America/Los_Angeles").strftime("%H:%M") == "07:00"
    assert shift_years((datetime(2024, 2, 29), None), -1) == (datetime(2023, 2, 28), None)


@given(st.datetimes(datetime(1990, 1, 1), datetime(2060, 1, 1)), st.sampled_from(["week", "month", "quarter", "year"]))
@settings(max_examples=200, deadline=None)
def test_periods_tile(now, unit):
    """last_* ends where this_* begins, and holds no moment twice."""
    clock = Clock(now)
    last, this = (period_bounds(PeriodSpec(f"{k}_{unit}"), clock) for k in ("last", "this"))
    assert last[0] < last[1] == this[0] <= this[1] == now
    again = period_bounds(PeriodSpec(f"last_{unit}"), Clock(last[0] + timedelta(hours=1)))
    assert again[1] == last[0]


def test_words():
    assert [singular(w) for w in ("orders", "categories", "boxes", "status", "address")] == ["order", "category", "box", "status", "address"]
    assert plural("category") == "categories" and snake("createdAt") == "created_at" and stem("shipped") == "ship"


def test_spans():
    s = extract_spans('Top 5 customers in Q2 2000 over $1.5k or 20% with "Acme" in the last 8 weeks since March 2001')
    assert [(x.kind, x.value) for x in s if x.kind == "number"] == [("number", 5), ("number", 1500), ("number", 20)]
    assert [x.value.key for x in s if isinstance(x.value, PeriodSpec)] == ["specific_quarter", "trailing_n_weeks", "since_date"]
    assert [x.value for x in s if x.kind == "quoted"] == ["Acme"]
    assert all(a.end <= b.start for a, b in itertools.pairwise(s))


@given(st.lists(st.lists(st.integers(0, 20), min_size=4, max_size=4), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_assignment_is_cheapest(cost):
    got = assignment(cost)
    assert len(set(got)) == len(got)
    assert sum(r[j] for r, j in zip(cost, got)) == min(sum(r[j] for r, j in zip(cost, p)) for p in itertools.permutations(range(4), len(cost)))


def test_decoding():
    assert assign_spans({"a": {"limit": 0.9, "none": 0.1}, "b": {"limit": 0.8, "threshold": 0.6}}, frozenset({"threshold"})) == {"a": "limit", "b": "threshold"}
    best, illegal = joint_decode({"column:t.price": 0.9, "column:t.amount": 0.1}, {"sum": 0.9, "avg": 0.1}, lambda c: ("avg",) if "price" in c else ("sum", "avg"))
    assert best in (("column:t.price", "avg"), ("column:t.amount", "sum")) and illegal == ("column:t.price", "sum")


def test_oracles(tmp_path):
    q = {"shape": Question("choice", "?", ("lookup", "single_value"))}
    log = RecordingOracle(HeuristicOracle())
    for _ in range(2):
        CachingOracle(log, tmp_path).ask({"request": "how many x"}, {})
    cached = CachingOracle(RecordingOracle(_Fixed()), tmp_path)
    assert cached.ask({"r": 1}, q) == cached.ask({"r": 1}, q) and len(cached.inner.log) == 1
    assert CachingOracle(_Broken(), tmp_path).ask({"r": 1}, q) == cached.ask({"r": 1}, q)
    calls = []

    def send(body):
        calls.append(body)
        if len(calls) == 1:
            raise OSError
        return b'{"shape": {"lookup": 3, "single_value": 1}}'

    assert HttpOracle("http://x", send=send, wait_s=0).ask({}, q)["shape"] == {"lookup": 0.75, "single_value": 0.25}
    options = tuple(f"o{i}" for i in range(120))
    got = LogprobOracle(lambda prompt: {"A": -0.1, "B": -3.0}).ask({}, {"x": Question("choice", "?", options)})["x"]
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got, key=got.get) == "o0"
    assert abs(margin({"a": 0.6, "b": 0.4}) - 0.2) < 1e-9
    with pytest.raises(ValueError):
        Question("score", "?", ("only",))


class _Fixed:
    def ask(self, state, questions):
        return {n: {o: 1 / len(q.options) for o in q.options} for n, q in questions.items()}


class _Broken:
    def ask(self, state, questions):
        raise AssertionError


@pytest.fixture(scope="module")
def composer(spark, sf_dir):
    b = queries.engine(spark, sf_dir)
    for n, t in b.model.tables.items():
        profile(b.frames[n], t)
    return Composer(b.model, b.frames, queries.CLOCK)


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return lambda q: con.execute(q).fetchall()


MONTH = "o_orderdate >= '2001-06-01' AND o_orderdate < '2001-07-01'"
CASES = [
    Case("count", "How many orders were placed last month?", gold=(f"SELECT count(*) FROM orders WHERE {MONTH}",)),
    Case("sum", "Total order value by nation last quarter", gold=("SELECT n_name, round(sum(o_totalprice), 2) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= '2001-04-01' AND o_orderdate < '2001-07-01' GROUP BY 1",)),
    Case("top", "Top 5 customers by total order value in 2000", gold=("SELECT c_name, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 2000 GROUP BY 1 ORDER BY 2 DESC LIMIT 5",), must_not=("SELECT c_name, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC LIMIT 5",)),
    Case("trend", "How many orders per month this year?", gold=("SELECT date_trunc('month', o_orderdate)::TIMESTAMP, count(*) FROM orders WHERE o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16' GROUP BY 1",)),
    Case("absent", "How many orders have no lineitem?", gold=("SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",)),
    Case("having", "Which customers have more than 5 orders in 2000?", compare="keys", gold=("SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 2000 GROUP BY 1 HAVING count(*) > 5",)),
    Case("share", "Share of orders by status", gold=("SELECT o_orderstatus, count(*), round(count(*) * 100.0 / sum(count(*)) OVER (), 2) FROM orders GROUP BY 1",)),
    Case("threshold", "orders over $400,000 last month", compare="keys", gold=(f"SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND {MONTH}",)),
    Case("value", "How many customers in the BUILDING segment?", gold=("SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'",)),
    Case("not", "Number of parts not in Brand#12", gold=("SELECT count(*) FROM part WHERE p_brand <> 'Brand#12'",)),
    Case("running", "Running total of order value by month this year", gold=("SELECT m, t, sum(t) OVER (ORDER BY m) FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS t FROM orders WHERE o_orderdate >= '2001-01-01' AND o_orderdate < '2001-07-16' GROUP BY 1)",)),
    Case("fan-out", "Total order value by brand", ("clarify",)),
    Case("unknown", "Number of suppliers in Germany", ("clarify",)),
    Case("grain answered", "Total order value by brand", answers=("column:lineitem.l_extendedprice",), gold=("SELECT p_brand, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",)),
    Case("write", "Delete all orders", ("decline",)),
    Case("forecast", "Predict next month orders", ("decline",)),
    Case("spread", "Distribution of order totals", ("decline",)),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c.id)
def test_requests(composer, sql, case):
    got = check(case, composer, sql)
    assert got.passed, got


def test_answers_are_remembered(composer, tmp_path):
    first = composer.compose("Total order value by brand")
    done = composer.answer(first.clarification.id, "column:lineitem.l_extendedprice")
    assert done.outcome == "execute"
    own = Composer(composer.model, composer.frames, queries.CLOCK, store=FolderStore(tmp_path))
    own.accept(done, owner="me")
    again = Composer(composer.model, composer.frames, queries.CLOCK, store=FolderStore(tmp_path))
    assert signature(again.compose("Total order value by brand", owner="me").plan) == signature(done.plan)
    assert again.compose("Total order value by brand", owner="you").outcome == "clarify"
    assert "total" in narrate(done.plan).lower()


def test_follow_up(composer):
    first = composer.compose("How many orders were placed?")
    assert composer.compose("and only last month", first).plan.window is not None


def test_comparison_modes():
    assert matches("unordered", [(1, "a"), (2, "b")], [(2.0, "b"), (1.001, "a")]) and not matches("ordered", [(1,), (2,)], [(2,), (1,)])
    assert matches("keys", [("a",), ("b",)], [(1, "b"), (2, "a")])


@pytest.fixture(scope="module")
def workspace(spark):
    """camelCase, one foreign key undeclared, cents, soft delete, a life cycle."""
    t = datetime
    return {
        "Workspace": spark.createDataFrame([(1, "Acme", "pro", t(2026, 1, 1), None), (2, "Beta", "team", t(2026, 2, 1), None), (3, "Gone", "free", t(2026, 2, 2), t(2026, 5, 1))], "id int, name string, plan string, createdAt timestamp_ntz, deletedAt timestamp_ntz"),
        "Invoice": spark.createDataFrame([(1, "INV-1", 1, 1200, t(2026, 9, 2), t(2026, 9, 9)), (2, "INV-2", 2, 3490, t(2026, 9, 5), t(2026, 9, 6)), (3, "INV-3", 1, 1200, t(2026, 8, 2), None)], "id int, invoiceNumber string, workspaceId int, amount_cents int, issuedAt timestamp_ntz, paidAt timestamp_ntz"),
    }


def test_conventions(workspace, tmp_path):
    m = build_model(workspace, Config(values={"Workspace.plan": ["free", "pro", "team"]}))
    w, i = m.tables["Workspace"], m.tables["Invoice"]
    assert w.pk == ("id",) and w.soft_delete == "deletedAt" and w.display == ("name",) and w.default_time == "createdAt"
    assert [r.id for r in m.relationships] == ["Invoice.workspaceId->Workspace"] and m.relationships[0].source == "inferred"
    assert i.columns["amount_cents"].role == "measure_additive" and i.columns["amount_cents"].unit.divisor == 100
    assert i.default_time == "issuedAt" and i.durations == [("issuedAt", "paidAt")]
    write_lockfile(tmp_path / "lock.json", m)
    assert not is_stale(tmp_path / "lock.json", read_lockfile(tmp_path / "lock.json"))
    del m.tables["Invoice"].columns["paidAt"]
    assert is_stale(tmp_path / "lock.json", m) and isinstance(doctor(m), list)
    c = Composer(build_model(workspace), workspace, NOW)
    assert [tuple(r) for r in c.execute(c.compose("How many workspaces are there?"))] == [(2,)]
    assert sorted(tuple(r) for r in c.execute(c.compose("Total invoice amount by plan last month"))) == [("pro", 12.0), ("team", 34.9)]


def test_star_schema_keys_are_inferred(spark, sf_dir):
    frames = queries.tpch_frames(spark, sf_dir)
    keys = {t: (k,) for t, k in {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}.items()}
    found = {r.id for r in build_model(frames, Config(keys=keys), scan=False).relationships}
    assert {"orders.o_custkey->customer", "lineitem.l_orderkey->orders", "lineitem.l_partkey->part", "lineitem.l_suppkey->supplier", "nation.n_regionkey->region", "customer.c_nationkey->nation"} <= found


@pytest.fixture(scope="module")
def shop(spark):
    """A status that is also a table, a flag, missing times, cents."""
    t = datetime
    orders = [(1, "delivered", 1250, True, t(2026, 8, 1), t(2026, 9, 3)), (2, "refunded", 990, False, t(2026, 8, 2), t(2026, 9, 4)), (3, "pending", 5000, None, t(2026, 9, 9), None), (4, "delivered", 700, True, t(2026, 9, 1), t(2026, 10, 1))]
    frames = {
        "orders": spark.createDataFrame(orders, "id int, status string, total_cents int, is_gift boolean, placed_at timestamp_ntz, delivered_at timestamp_ntz"),
        "refunds": spark.createDataFrame([(1, 1, 300, t(2026, 9, 8)), (2, 2, 990, t(2026, 9, 9))], "id int, order_id int, amount_cents int, refunded_at timestamp_ntz"),
    }
    values = {"orders.status": ["pending", "delivered", "refunded"]}
    return Composer(build_model(frames, Config(values=values)), frames, NOW)


@pytest.mark.parametrize(
    "request_, expected",
    [
        ("How many orders are gift orders?", [(2,)]),
        ("How many non-gift orders?", [(2,)]),
        ("How many orders have a missing delivered at?", [(1,)]),
        ("How many orders were delivered in September?", [(2,)]),
        ("List the status and total of orders", [("delivered", 12.5), ("refunded", 9.9), ("pending", 50.0), ("delivered", 7.0)]),
    ],
)
def test_details(shop, request_, expected):
    r, rows = shop.ask(request_)
    assert r.outcome == "execute", (r.reason, r.clarification)
    assert [tuple(x) for x in rows] == expected, r.narrative


def test_status_or_rows(shop):
    r = shop.compose("How many refunded orders?")
    assert r.outcome == "clarify" and r.clarification.options == ["status", "related"]
    assert [[tuple(x) for x in shop.execute(shop.answer(r.clarification.id, o))] for o in ("status", "related")] == [[(1,)], [(2,)]]


def test_definitions(shop, tmp_path):
    own = Composer(shop.model, shop.frames, NOW, store=FolderStore(tmp_path))
    own.define("net sales", Measure("x", "sum", "orders", "orders.total_cents", filters=(Predicate("orders.status", "not_in", ("refunded",)),)), ("net turnover",), scope="org")
    again = Composer(shop.model, shop.frames, NOW, store=FolderStore(tmp_path))
    for words in ("net sales", "net turnover"):
        r, rows = again.ask(f"What were the {words}?")
        assert r.outcome == "execute" and [tuple(x) for x in rows] == [(69.5,)], r
    assert r.plan.measures[0].filters[0].implied


def test_settled_measures_are_kept_under_their_name(composer, tmp_path):
    own = Composer(composer.model, composer.frames, queries.CLOCK, store=FolderStore(tmp_path))
    asked = own.compose("Total revenue by priority")
    assert asked.outcome == "clarify"
    own.accept(own.answer(asked.clarification.id, "column:lineitem.l_extendedprice"), "revenue", scope="org")
    r = own.compose("Total revenue by nation in 2000")
    assert r.outcome != "clarify" and r.plan.measures[0].column == "lineitem.l_extendedprice"


def test_clauses_and_ranges():
    assert measure_clauses("Number of orders and total value by nation and region") == ["Number of orders", "total value"]
    assert measure_clauses("Total value by nation and region") == [] == measure_clauses("")
    text = "size between 5 and 15 or 20"
    numbers = [s for s in extract_spans(text) if s.kind == "number"]
    assert {a.value: z.value for a, z in between_pairs(text, numbers).items()} == {5: 15}
    assert [s.value for s in text_matches('name containing "a b" of "c"', extract_spans('name containing "a b" of "c"'))] == ["a b"]


def test_server(shop):
    s = serve(shop, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def send(path, **body):
        c = http.client.HTTPConnection(*s.server_address)
        c.request("POST" if body else "GET", path, json.dumps(body) if body else None)
        r = c.getresponse()
        return r.status, json.loads(r.read())

    assert send("/schema")[1]["orders"]["columns"]["status"] == "dimension_categorical"
    status, got = send("/ask", request="How many refunded orders?")
    assert (status, got["outcome"]) == (200, "clarify") and send("/run", result=got["result"])[0] == 422
    got = send("/answer", id=got["clarification"]["id"], option="related")[1]
    assert send("/run", result=got["result"]) == (200, {"columns": ["n"], "rows": [[2]]})
    assert send("/ask", nothing=1)[0] == 400 and send("/other", x=1)[0] == 400
    s.shutdown()


def test_cases_from_a_file(shop, tmp_path, capsys):
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "a", "request": "How many orders?", "gold": ["right"]}, {"id": "b", "request": "How many orders?", "gold": ["wrong"]}, {"id": "c", "request": "Delete all orders", "outcomes": ["decline"]}]))
    assert evaluate(shop, load_cases(tmp_path / "cases.json"), {"right": [(4,)], "wrong": [(5,)]}.get) == 1
    assert capsys.readouterr().out.splitlines()[-1] == "2 / 3"

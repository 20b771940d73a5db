"""What the engine knows and decides, as rows: schema conventions, profiles, words, readings, decisions, saved answers, limits.

Each is a registered query. Some are computed from the tables and have SQL over them; the others are decisions, whose SQL lists
the rows expected (golden values, taken from a run and read through: they guard against change more than they prove).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.periods import Clock, Parts, PeriodSpec, period_bounds
from .language.lexicon import plural, singular, stem
from .language.link import link_values, retrieve_tables
from .language.oracle import Question
from .language.saved import MemoryStore, SavedRecord
from .language.spans import extract_spans
from .operators.guard import TooCostly, check_cost, plan_bytes
from .plans.decode import assign_spans, joint_decode
from .plans.describe import narrate, signature
from .plans.legality import LEGAL, legal_aggregates
from .plans.types import Dimension, Measure, Predicate, QueryPlan
from .sources.catalog import broken_keys
from .sources.conventions import Config, build_model, unit_of, values_of_check
from .sources.doctor import doctor
from .sources.lockfile import fingerprint
from .sources.model import ColumnModel, SchemaModel, TableModel
from .sources.profile import ordered_share, profile
from .sources.tpch import KEYS, tpch_frames, tpch_model

Rows = list[tuple]
_PK = {t: (k,) for t, k in KEYS.items() if k}


def _model(spark: SparkSession, sf_dir: str) -> SchemaModel:
    return build_model(tpch_frames(spark, sf_dir), Config(keys=_PK), scan=False)


def schema_roles(spark: SparkSession, sf_dir: str) -> Rows:
    m = _model(spark, sf_dir)
    return [(t.name, c.name, c.role) for t in m.tables.values() for c in t.columns.values()]


def schema_links(spark: SparkSession, sf_dir: str) -> Rows:
    return [(r.child, r.child_cols[0], r.parent, r.cardinality) for r in _model(spark, sf_dir).relationships]


def schema_shapes(spark: SparkSession, sf_dir: str) -> Rows:
    """Keys, display and default time of the tables; a junction, a snapshot, a tenant, soft deletion and a life cycle on made-up ones."""
    t, at = datetime, "timestamp_ntz"
    frames = {
        "products": spark.createDataFrame([(1, 7, "Nut", None)], f"id int, org_id int, name string, deleted_at {at}"),
        "tags": spark.createDataFrame([(1, 7, "new")], "id int, org_id int, label string"),
        "product_tags": spark.createDataFrame([(1, 1, t(2026, 1, 1))], f"product_id int, tag_id int, created_at {at}"),
        "stock": spark.createDataFrame([(t(2026, 1, 1), 1, 5)], f"day {at}, product_id int, quantity int"),
        "orders": spark.createDataFrame([(1, 7, 1, t(2026, 1, 1), t(2026, 1, 3), t(2026, 1, 2))], f"id int, org_id int, product_id int, placed_at {at}, delivered_at {at}, updated_at {at}"),
    }
    m = build_model(frames, Config(keys={"product_tags": ("product_id", "tag_id"), "stock": ("day", "product_id")}))
    return [(x.name, ",".join(x.pk), ",".join(x.display), x.default_time, x.soft_delete, x.snapshot, x.junction, ",".join(f"{a}>{z}" for a, z in x.durations), ",".join(c.name for c in x.columns.values() if c.role == "tenant")) for x in m.tables.values()]


def column_units(spark: SparkSession, sf_dir: str) -> Rows:
    found = [(n, unit_of(n, "number")) for n in ("amount_cents", "unit_price", "tax_pct", "conversion_rate", "duration_ms", "wait_seconds", "weight_kg", "name_length")]
    return [(n, u.kind if u else None, u.divisor if u else None) for n, u in found]


def check_values(spark: SparkSession, sf_dir: str) -> Rows:
    checks = ("status IN ('open', 'won''t fix')", "((kind)::text = ANY ((ARRAY['a'::text, 'b'::text])::text[]))", "rating BETWEEN 1 AND 5", "(price >= (0)::numeric)", "length(x) > 2 AND x < 9.5")
    return [(c, ",".join(v) if v else None, low, high) for c in checks for v, (low, high) in [values_of_check(c)]]


def declared_keys(spark: SparkSession, sf_dir: str) -> Rows:
    """Rows and different keys of tables whose declared key is none."""
    frames = tpch_frames(spark, sf_dir)
    m = tpch_model(frames)
    m.tables["lineitem"].pk = ("l_orderkey",)
    m.tables["customer"].pk = ("c_nationkey",)
    return [(t, n, d) for t, (n, d) in broken_keys(m, frames).items()]


def column_profiles(spark: SparkSession, sf_dir: str) -> Rows:
    frames = tpch_frames(spark, sf_dir)
    out = []
    for name in ("part", "supplier", "nation"):
        t = tpch_model(frames).tables[name]
        profile(frames[name], t)
        out += [(name, c.name, t.rows, round(c.null_share, 6), float(c.low), float(c.high)) for c in t.columns.values() if c.kind == "number"]
    return out


def value_lists(spark: SparkSession, sf_dir: str) -> Rows:
    frames = tpch_frames(spark, sf_dir)
    t = tpch_model(frames).tables["part"]
    profile(frames["part"], t)
    return [(n, v) for n in ("p_brand", "p_type") for v in t.columns[n].values]


def time_order(spark: SparkSession, sf_dir: str) -> Rows:
    """The share of rows whose times are in order, for pairs that always and never are."""
    orders = tpch_frames(spark, sf_dir)["orders"].select(F.col("o_orderdate").alias("placed_at"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("paid_at"))
    return [(a, z, ordered_share(orders, a, z)) for a, z in (("placed_at", "paid_at"), ("paid_at", "placed_at"))]


def model_identity(spark: SparkSession, sf_dir: str) -> Rows:
    """The fingerprint changes with a column and with a key, not with statistics."""
    m = _model(spark, sf_dir)
    was = fingerprint(m)
    m.tables["part"].rows = 5
    same = fingerprint(m) == was
    m.tables["part"].pk = ()
    key = fingerprint(m) == was
    del m.tables["nation"].columns["n_name"]
    return [("statistics", same), ("key", key), ("column", fingerprint(m) in (was, key))]


def model_doubts(spark: SparkSession, sf_dir: str) -> Rows:
    m = tpch_model(tpch_frames(spark, sf_dir))
    return [(line,) for line in doctor(m)]


def period_values(spark: SparkSession, sf_dir: str) -> Rows:
    clock = Clock(datetime(2026, 10, 5))
    asked = {
        "last_month": PeriodSpec("last_month"), "last_quarter": PeriodSpec("last_quarter"), "this_year": PeriodSpec("this_year"), "last_year": PeriodSpec("last_year"), "last_week": PeriodSpec("last_week"), "this_month": PeriodSpec("this_month"),
        "trailing 8 weeks": PeriodSpec("trailing_n_weeks", 8), "september": PeriodSpec("specific_month", first=Parts(month=9)), "october": PeriodSpec("specific_month", first=Parts(month=10)), "november": PeriodSpec("specific_month", first=Parts(month=11)),
        "Q2 2026": PeriodSpec("specific_quarter", first=Parts(2026, quarter=2)), "since March 2026": PeriodSpec("since_date", first=Parts(2026, 3)), "month that is a quarter": PeriodSpec("specific_month", first=Parts(2026, quarter=1)), "a year without one": PeriodSpec("specific_year"),
    }
    out = [(n, *period_bounds(p, clock)) for n, p in asked.items()]
    return [*out, ("last_week from Sunday", *period_bounds(PeriodSpec("last_week"), replace(clock, week_start=6)))]


def request_spans(spark: SparkSession, sf_dir: str) -> Rows:
    text = 'Top 5 customers in Q2 2000 over $1.5k or 20% with "Acme" in the last 8 weeks, MTD, Sept 2001, past quarter, twenty orders'
    return [(s.kind, s.text, s.value.key if isinstance(s.value, PeriodSpec) else str(s.value), s.value.n if isinstance(s.value, PeriodSpec) else None) for s in extract_spans(text)]


def word_forms(spark: SparkSession, sf_dir: str) -> Rows:
    return [(w, singular(w), plural(singular(w)), stem(w)) for w in ("orders", "categories", "boxes", "status", "shipping", "days")]


def value_links(spark: SparkSession, sf_dir: str) -> Rows:
    """Values named in a request: the longest first, short codes in capitals only, states by their names."""
    columns = {"state": ColumnModel("state", "text", "string", role="dimension_categorical", searchable=True, values=["CA", "OR", "TX"]), "kind": ColumnModel("kind", "text", "string", role="dimension_categorical", searchable=True, values=["new", "new_old", "gift card"])}
    m = SchemaModel({"t": TableModel("t", columns)})
    return [(x.column, x.value, x.start) for r in ("new old in Texas or CA", "gift cards or new") for x in link_values(r, [], m)]


def table_ranking(spark: SparkSession, sf_dir: str) -> Rows:
    """With many tables, those that a request is about."""
    names = [f"archive_{i}" for i in range(26)] + ["warehouse", "shipment", "carrier"]
    m = SchemaModel({n: TableModel(n, {c: ColumnModel(c, "text", "string") for c in ("id", "note", *(("city",) if n == "warehouse" else ("carrier_name",) if n == "shipment" else ()))}) for n in names})
    return [(r, i + 1, t) for r in ("shipments by carrier name", "warehouse city") for i, t in enumerate(retrieve_tables(r, m, [], 2))]


def answer_kinds(spark: SparkSession, sf_dir: str) -> Rows:
    """Questions have as many options as their kind allows."""
    out = []
    for kind, n in (("choice", 1), ("choice", 2), ("choice", 255), ("choice", 256), ("score", 10), ("score", 11)):
        try:
            Question(kind, "?", tuple(map(str, range(n))))
            out.append((kind, n, True))
        except ValueError:
            out.append((kind, n, False))
    return out


def span_roles(spark: SparkSession, sf_dir: str) -> Rows:
    """Numbers' roles are decided together: a role that is used once goes to the number that it fits best overall."""
    cases = {
        "both fit": {"a": {"limit": 0.9, "none": 0.1}, "b": {"limit": 0.8, "threshold": 0.6}},
        "one is none": {"a": {"limit": 0.9, "none": 0.4}, "b": {"limit": 0.95, "none": 0.01}},
        "reusable": {"a": {"threshold": 0.9}, "b": {"threshold": 0.9}},
    }
    return [(n, s, r) for n, p in cases.items() for s, r in assign_spans(p, frozenset({"threshold"})).items()]


def joint_readings(spark: SparkSession, sf_dir: str) -> Rows:
    """The likeliest pair that is legal, and the illegal one that beats it by half."""
    cases = {
        "illegal wins": ({"column:t.price": 0.9, "column:t.amount": 0.1}, {"sum": 0.9, "avg": 0.1}),
        "legal wins": ({"column:t.price": 0.4, "column:t.amount": 0.6}, {"sum": 0.9, "avg": 0.1}),
        "counts": ({"count:t": 0.8, "column:t.amount": 0.2}, {"sum": 0.9}),
    }
    return [(n, " ".join(best or ()), " ".join(bad or ())) for n, (q, a) in cases.items() for best, bad in [joint_decode(q, a, lambda c: ("avg",) if "price" in c else ("sum", "avg"))]]


def legal_measures(spark: SparkSession, sf_dir: str) -> Rows:
    m = tpch_model(tpch_frames(spark, sf_dir))
    asked = ("count:orders", "column:orders.o_totalprice", "column:part.p_retailprice", "column:lineitem.l_quantity")
    return [(c, ",".join(legal_aggregates(m, c))) for c in asked] + [("semi-additive", ",".join(LEGAL["measure_semiadditive"]))]


def plan_identity(spark: SparkSession, sf_dir: str) -> Rows:
    """Labels and the order of filters don't make another plan; a value does."""
    m, f, g = Measure("a", "sum", "orders", "orders.o_totalprice"), Predicate("orders.o_orderstatus", "eq", ("F",)), Predicate("orders.o_orderpriority", "eq", ("5-LOW",))
    p = QueryPlan("breakdown", measures=[m], dimensions=[Dimension("nation", "nation.n_name")], filters=[f, g])
    others = {"filters turned": replace(p, filters=[g, f]), "another label": replace(p, measures=[replace(m, alias="b")]), "another value": replace(p, filters=[replace(f, values=("O",)), g]), "a limit": replace(p, limit=3)}
    return [(n, signature(o) == signature(p)) for n, o in others.items()] + [(narrate(p), True)]


def saved_answers(spark: SparkSession, sf_dir: str) -> Rows:
    """Who finds which saved record, best first."""
    store = MemoryStore()
    for id_, name, scope, owner, status in (("1", "net revenue", "org", "", "canonical"), ("2", "revenue by nation", "user", "me", "active"), ("3", "revenue", "user", "you", "active"), ("4", "revenue", "org", "", "stale")):
        store.put(SavedRecord(id_, "measure", name, name, {}, scope, owner, status))
    return [(who, i + 1, r.id) for who in ("me", "you") for i, r in enumerate(store.search("revenue by nation", "measure", who))]


def cost_limits(spark: SparkSession, sf_dir: str) -> Rows:
    """Plans that read more than they may are refused; a join costs the sum of its tables."""
    frames = tpch_frames(spark, sf_dir)
    orders, customer = frames["orders"], frames["customer"]
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    cases = {"within": (both, 1 << 40), "above": (both, 10)}
    out = []
    for n, (df, most) in cases.items():
        try:
            check_cost(df, most)
            out.append((n, True))
        except TooCostly:
            out.append((n, False))
    return [*out, ("sum of tables", plan_bytes(both)[0] >= plan_bytes(orders)[0])]


# Golden values, one row a line, taken from a run on the smallest tables and read through.

_SCHEMA_ROLES = """
('region', 'r_regionkey', 'identifier'),
('region', 'r_name', 'dimension_text'),
('nation', 'n_nationkey', 'identifier'),
('nation', 'n_name', 'dimension_text'),
('nation', 'n_regionkey', 'foreign_key'),
('customer', 'c_custkey', 'identifier'),
('customer', 'c_name', 'dimension_text'),
('customer', 'c_nationkey', 'foreign_key'),
('customer', 'c_acctbal', 'measure_nonadditive'),
('customer', 'c_mktsegment', 'dimension_text'),
('supplier', 's_suppkey', 'identifier'),
('supplier', 's_name', 'dimension_text'),
('supplier', 's_nationkey', 'foreign_key'),
('supplier', 's_acctbal', 'measure_nonadditive'),
('part', 'p_partkey', 'identifier'),
('part', 'p_name', 'dimension_text'),
('part', 'p_brand', 'dimension_text'),
('part', 'p_type', 'dimension_text'),
('part', 'p_size', 'attribute'),
('part', 'p_retailprice', 'measure_nonadditive'),
('orders', 'o_orderkey', 'identifier'),
('orders', 'o_custkey', 'foreign_key'),
('orders', 'o_orderstatus', 'dimension_text'),
('orders', 'o_totalprice', 'measure_additive'),
('orders', 'o_orderdate', 'timestamp_event'),
('orders', 'o_orderpriority', 'dimension_text'),
('events', 'event_id', 'identifier'),
('events', 'ts', 'timestamp_event'),
('events', 'user_id', 'attribute'),
('events', 'event_type', 'dimension_text'),
('events', 'value', 'measure_additive'),
('events', 'props', 'dimension_text'),
('lineitem', 'l_orderkey', 'foreign_key'),
('lineitem', 'l_partkey', 'foreign_key'),
('lineitem', 'l_suppkey', 'foreign_key'),
('lineitem', 'l_linenumber', 'attribute'),
('lineitem', 'l_quantity', 'measure_additive'),
('lineitem', 'l_extendedprice', 'measure_additive'),
('lineitem', 'l_discount', 'measure_additive'),
('lineitem', 'l_tax', 'measure_additive'),
('lineitem', 'l_returnflag', 'dimension_text'),
('lineitem', 'l_linestatus', 'dimension_text'),
('lineitem', 'l_shipdate', 'timestamp_event')
"""

_SCHEMA_LINKS = """
('nation', 'n_regionkey', 'region', 'N:1'),
('customer', 'c_nationkey', 'nation', 'N:1'),
('supplier', 's_nationkey', 'nation', 'N:1'),
('orders', 'o_custkey', 'customer', 'N:1'),
('lineitem', 'l_orderkey', 'orders', 'N:1'),
('lineitem', 'l_partkey', 'part', 'N:1'),
('lineitem', 'l_suppkey', 'supplier', 'N:1')
"""

_SCHEMA_SHAPES = """
('products', 'id', 'name', NULL, 'deleted_at', NULL, false, '', 'org_id'),
('tags', 'id', '', NULL, NULL, NULL, false, '', 'org_id'),
('product_tags', 'product_id,tag_id', '', 'created_at', NULL, NULL, true, '', ''),
('stock', 'day,product_id', '', 'day', NULL, 'day', false, '', ''),
('orders', 'id', '', 'placed_at', NULL, NULL, false, 'placed_at>delivered_at', 'org_id')
"""

_COLUMN_UNITS = """
('amount_cents', 'money', 100),
('unit_price', 'money', 1),
('tax_pct', 'percent', 1),
('conversion_rate', 'percent', 1),
('duration_ms', 'duration', 1000),
('wait_seconds', 'duration', 1),
('weight_kg', 'weight', 1),
('name_length', NULL, NULL)
"""

_CHECK_VALUES = """
('status IN (''open'', ''won''''t fix'')', 'open,won''t fix', NULL, NULL),
('((kind)::text = ANY ((ARRAY[''a''::text, ''b''::text])::text[]))', 'a,b', NULL, NULL),
('rating BETWEEN 1 AND 5', NULL, 1.0, 5.0),
('(price >= (0)::numeric)', NULL, 0.0, NULL),
('length(x) > 2 AND x < 9.5', NULL, 2.0, 9.5)
"""

_TIME_ORDER = """
('placed_at', 'paid_at', 1.0),
('paid_at', 'placed_at', 0.0)
"""

_MODEL_IDENTITY = """
('statistics', true),
('key', false),
('column', false)
"""

_MODEL_DOUBTS = """
('orders: no display column'),
('events: no display column'),
('lineitem: no key; its rows can be counted only at its own grain'),
('lineitem: no display column')
"""

_PERIOD_VALUES = """
('last_month', TIMESTAMP '2026-09-01', TIMESTAMP '2026-10-01'),
('last_quarter', TIMESTAMP '2026-07-01', TIMESTAMP '2026-10-01'),
('this_year', TIMESTAMP '2026-01-01', TIMESTAMP '2026-10-05'),
('last_year', TIMESTAMP '2025-01-01', TIMESTAMP '2026-01-01'),
('last_week', TIMESTAMP '2026-09-28', TIMESTAMP '2026-10-05'),
('this_month', TIMESTAMP '2026-10-01', TIMESTAMP '2026-10-05'),
('trailing 8 weeks', TIMESTAMP '2026-08-10', TIMESTAMP '2026-10-05'),
('september', TIMESTAMP '2026-09-01', TIMESTAMP '2026-10-01'),
('october', TIMESTAMP '2025-10-01', TIMESTAMP '2025-11-01'),
('november', TIMESTAMP '2025-11-01', TIMESTAMP '2025-12-01'),
('Q2 2026', TIMESTAMP '2026-04-01', TIMESTAMP '2026-07-01'),
('since March 2026', TIMESTAMP '2026-03-01', TIMESTAMP '2026-10-05'),
('month that is a quarter', TIMESTAMP '2026-01-01', TIMESTAMP '2026-04-01'),
('a year without one', NULL, NULL),
('last_week from Sunday', TIMESTAMP '2026-09-27', TIMESTAMP '2026-10-04')
"""

_REQUEST_SPANS = """
('number', '5', '5', NULL),
('date', 'Q2 2000', 'specific_quarter', 1),
('number', '$1.5k', '1500', NULL),
('number', '20%', '20', NULL),
('quoted', '"Acme"', 'Acme', NULL),
('relative', 'in the last 8 weeks', 'trailing_n_weeks', 8),
('relative', 'MTD', 'this_month', 1),
('date', 'Sept 2001', 'specific_month', 1),
('relative', 'past quarter', 'trailing_n_months', 3),
('number', 'twenty', '20', NULL)
"""

_WORD_FORMS = """
('orders', 'order', 'orders', 'order'),
('categories', 'category', 'categories', 'category'),
('boxes', 'box', 'boxes', 'box'),
('status', 'status', 'statuses', 'status'),
('shipping', 'shipping', 'shippings', 'ship'),
('days', 'day', 'days', 'day')
"""

_VALUE_LINKS = """
('t.kind', 'new_old', 0),
('t.state', 'TX', 11),
('t.state', 'CA', 20),
('t.kind', 'gift card', 0)
"""

_TABLE_RANKING = """
('shipments by carrier name', 1, 'shipment'),
('shipments by carrier name', 2, 'carrier'),
('warehouse city', 1, 'warehouse'),
('warehouse city', 2, 'archive_0')
"""

_ANSWER_KINDS = """
('choice', 1, false),
('choice', 2, true),
('choice', 255, true),
('choice', 256, false),
('score', 10, true),
('score', 11, false)
"""

_SPAN_ROLES = """
('both fit', 'a', 'limit'),
('both fit', 'b', 'threshold'),
('one is none', 'a', NULL),
('one is none', 'b', 'limit'),
('reusable', 'a', 'threshold'),
('reusable', 'b', 'threshold')
"""

_JOINT_READINGS = """
('illegal wins', 'column:t.price avg', 'column:t.price sum'),
('legal wins', 'column:t.amount sum', ''),
('counts', 'count:t count_rows', '')
"""

_LEGAL_MEASURES = """
('count:orders', 'count_rows,count_distinct'),
('column:orders.o_totalprice', 'sum,avg,median,min,max'),
('column:part.p_retailprice', 'avg,median,min,max'),
('column:lineitem.l_quantity', 'sum,avg,median,min,max'),
('semi-additive', 'sum,avg,min,max')
"""

_PLAN_IDENTITY = """
('filters turned', true),
('another label', true),
('another value', false),
('a limit', false),
('Total orders totalprice; by nation name; where orders orderstatus is F and orders orderpriority is 5-LOW.', true)
"""

_SAVED_ANSWERS = """
('me', 1, '1'),
('me', 2, '2'),
('you', 1, '1'),
('you', 2, '3')
"""

_COST_LIMITS = """
('within', true),
('above', false),
('sum of tables', true)
"""



def _golden(columns: str, rows: str) -> str:
    """SQL that lists the rows."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    named = [c.split() for c in columns.split(", ")]
    return f"SELECT {', '.join(f'{n}::{kinds[k]} AS {n}' for n, k in named)} FROM (VALUES {rows.strip()}) v({', '.join(n for n, _ in named)})"


_NUMBERS = {"part": ("p_partkey", "p_size", "p_retailprice"), "supplier": ("s_suppkey", "s_nationkey", "s_acctbal"), "nation": ("n_nationkey", "n_regionkey")}
#: name -> (rows, columns, SQL)
KNOWLEDGE: dict[str, tuple[Callable[[SparkSession, str], Rows], str, str]] = {
    "declared_keys": (declared_keys, "tbl string, n long, d long", "SELECT 'lineitem' AS tbl, count(*) AS n, count(DISTINCT l_orderkey) AS d FROM lineitem UNION ALL SELECT 'customer', count(*), count(DISTINCT c_nationkey) FROM customer"),
    "column_profiles": (column_profiles, "tbl string, col string, n int, missing double, low double, high double", " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, count(*)::INTEGER AS n, round(1 - count({c}) / count(*), 6) AS missing, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM {t}" for t, cols in _NUMBERS.items() for c in cols)),
    "value_lists": (value_lists, "col string, value string", "SELECT DISTINCT 'p_brand' AS col, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part"),
}
for _rows, _columns, _values in (
    (schema_roles, "tbl string, col string, role string", _SCHEMA_ROLES),
    (schema_links, "child string, col string, parent string, cardinality string", _SCHEMA_LINKS),
    (schema_shapes, "tbl string, key string, display string, time string, deleted string, snapshot string, junction boolean, durations string, tenant string", _SCHEMA_SHAPES),
    (column_units, "col string, unit string, divisor int", _COLUMN_UNITS),
    (check_values, "condition string, listed string, low double, high double", _CHECK_VALUES),
    (time_order, "a string, z string, share double", _TIME_ORDER),
    (model_identity, "changed string, same boolean", _MODEL_IDENTITY),
    (model_doubts, "doubt string", _MODEL_DOUBTS),
    (period_values, "period string, a timestamp_ntz, z timestamp_ntz", _PERIOD_VALUES),
    (request_spans, "kind string, text string, value string, n int", _REQUEST_SPANS),
    (word_forms, "word string, one string, many string, stem string", _WORD_FORMS),
    (value_links, "col string, value string, place int", _VALUE_LINKS),
    (table_ranking, "request string, rank int, tbl string", _TABLE_RANKING),
    (answer_kinds, "kind string, options int, allowed boolean", _ANSWER_KINDS),
    (span_roles, "reading string, span string, role string", _SPAN_ROLES),
    (joint_readings, "reading string, best string, illegal string", _JOINT_READINGS),
    (legal_measures, "quantity string, aggregates string", _LEGAL_MEASURES),
    (plan_identity, "what string, same boolean", _PLAN_IDENTITY),
    (saved_answers, "who string, rank int, record string", _SAVED_ANSWERS),
    (cost_limits, "what string, passes boolean", _COST_LIMITS),
):
    KNOWLEDGE[_rows.__name__] = (_rows, _columns, _golden(_columns, _values))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f, columns=columns: spark.createDataFrame(f(spark, sf_dir), columns)) for name, (f, columns, _) in KNOWLEDGE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in KNOWLEDGE.items()}

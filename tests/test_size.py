"""Requests over more customers than the engine's cap, names that repeat, tables that are profiled on a sample."""

import os
from collections import Counter

import duckdb
import pytest

from askframe import queries
from askframe.sources import profile as profiles
from askframe.sources.model import ColumnModel, TableModel

KEYS = queries.tpch_frames.__globals__["KEYS"]


@pytest.fixture
def folder(tmp_path, sf_dir):
    """(customers as SQL, orders as SQL) -> a folder whose other tables are those of sf_dir."""

    def make(customers: str, orders: str) -> str:
        for t in KEYS:
            if t not in ("customer", "orders"):
                os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW c AS SELECT * FROM '{sf_dir}/customer.parquet'")
        con.execute(f"CREATE VIEW o AS SELECT * FROM '{sf_dir}/orders.parquet'")
        con.execute(f"COPY ({customers}) TO '{tmp_path}/customer.parquet'")
        con.execute(f"COPY ({orders}) TO '{tmp_path}/orders.parquet'")
        return str(tmp_path)

    return make


def both(spark, sf_dir, name):
    """(columns, rows) of the query and of its SQL."""
    con = duckdb.connect()
    for t in KEYS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = queries.queries()[name](spark, sf_dir), con.execute(queries.oracle_sql()[name])
    return (df.columns, [tuple(r) for r in df.collect()]), ([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("names", ["'Customer#' || c_custkey % 150", "'Customer#' || c_custkey"])
def test_all_customers_between(spark, folder, names):
    """6,000 customers of five orders each, names of their own or shared by 40."""
    at = folder(
        f"SELECT * REPLACE ({names} AS c_name) FROM (SELECT * REPLACE (i AS c_custkey) FROM (SELECT * FROM c LIMIT 1), range(6000) r(i))",
        "SELECT * REPLACE (i AS o_orderkey, i % 6000 AS o_custkey, TIMESTAMP '2000-05-01' AS o_orderdate) FROM (SELECT * FROM o LIMIT 1), range(30000) r(i)",
    )
    (columns, got), (wanted, want) = both(spark, at, "ask_having_between")
    assert columns == wanted and len(got) == 6000 and Counter(got) == Counter(want)


@pytest.mark.parametrize("names", ["'Customer#' || c_custkey % 150", "'Customer#' || c_custkey"])
def test_customers_over_four_millions(spark, folder, names):
    """5,200 customers, 260 of each total, so the limit falls among equal totals; keys and names sort differently."""
    at = folder(f"SELECT * REPLACE ({names} AS c_name) FROM (SELECT * REPLACE (i AS c_custkey) FROM (SELECT * FROM c LIMIT 1), range(5200) r(i))", "SELECT * REPLACE (i AS o_orderkey, i AS o_custkey, 4000000.5::DOUBLE + i % 20 AS o_totalprice) FROM (SELECT * FROM o LIMIT 1), range(5200) r(i)")
    got, want = both(spark, at, "ask_threshold_group")
    assert got == want and len(got[1]) == 5000


def test_one_name_of_two_customers(spark, folder):
    """Names that hardly ever repeat: the two customers of one name are not added up."""
    at = folder("SELECT * REPLACE ('Customer#' || c_custkey // CASE c_custkey WHEN 1 THEN 2 ELSE 1 END AS c_name) FROM (SELECT * REPLACE (i AS c_custkey) FROM (SELECT * FROM c LIMIT 1), range(200) r(i))", "SELECT * REPLACE (i AS o_orderkey, i AS o_custkey, 5000000.0::DOUBLE + i AS o_totalprice) FROM (SELECT * FROM o LIMIT 1), range(200) r(i)")
    got, want = both(spark, at, "ask_threshold_group")
    assert got == want and [r[0] for r in got[1]].count("Customer#0") == 2


def test_names_of_a_sampled_table(spark, monkeypatch):
    """The sample's different names say nothing of the whole."""
    monkeypatch.setattr(profiles, "SAMPLE_ROWS", 100)
    for names, n in (("concat('n', id)", 3000), ("concat('n', id % 1500)", 1500), ("concat('n', id % 7)", 7)):
        t = TableModel("t", {"id": ColumnModel("id", "number", "bigint"), "name": ColumnModel("name", "text", "string")}, ("id",), ("name",))
        profiles.profile(spark.range(3000).selectExpr("id", f"{names} AS name"), t)
        assert (t.columns["name"].n_distinct, t.told_apart) == (n, n == 3000)

"""Declared keys, roles and units of the star-schema Parquet tables (Parquet itself carries none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import declare

# Primary keys, foreign keys, displays and roles of the tables.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "lineitem": ""}
REFERENCES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
DISPLAY = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name"}
TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
MONEY = ("o_totalprice", "l_extendedprice")
NONADDITIVE = ("p_retailprice", "c_acctbal", "s_acctbal", "l_discount", "l_tax", "p_size")


def tpch_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in KEYS}


def tpch_model(frames: dict[str, DataFrame]):
    return declare(frames, keys=KEYS, references=REFERENCES, display=DISPLAY, times=TIMES, money=MONEY, additive=("l_quantity", "value"), nonadditive=NONADDITIVE)

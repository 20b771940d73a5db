"""Columns of any name, repeated rows and empty tables, through operators and every stage of the pipeline."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from askframe.llm import decontaminate, line_dedup, simhash, toxicity
from askframe.llm.common import fresh, quoted

from .test_operators import PASSAGE, TEXTS, prose

NAMES = ("_id", "_hash", "_words", "doc", "hash", "words", "a.b", "with blank", "tick`ed", "node", "fp", "row", "th", "salt", "line")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, n) for n, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    for k, name in enumerate(NAMES):
        df = df.withColumn(name, F.col("n") * 100 + k)
    return df.drop("n")


def test_free_names():
    assert fresh(["doc", "_DOC"], "doc", "hash") == ["__doc", "hash"]


def intact(df):
    """Each row's other columns still belong together."""
    return df.select(*map(quoted, NAMES)).collect()


@pytest.mark.parametrize(
    "apply",
    [
        lambda spark, df: line_dedup.dedup_lines(df, 3),
        lambda spark, df: decontaminate.drop_leaks(df, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")),
        lambda spark, df: simhash.keep_one(df),
        lambda spark, df: toxicity.drop_toxic(df, model=toxicity.BLANK),
    ],
    ids=["lines", "leaks", "near", "toxic"],
)
def test_other_columns_come_back(spark, odd, apply):
    out = apply(spark, odd)
    assert set(odd.columns) <= set(out.columns)
    rows = intact(out)
    assert rows and all(r[k] == r[0] + k for r in rows for k in range(len(NAMES)))
    assert apply(spark, odd.limit(0)).collect() == []


def test_stages_take_any_columns(spark, odd, sf_dir):
    docs = odd.withColumn("n_chars", F.char_length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert all(r[k] == r[0] + k for r in intact(out) for k in range(len(NAMES)))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(TEXTS)


def test_very_long_texts(spark):
    """Texts of megabytes go whole through line dedup and decontamination."""
    text = "\n".join(prose(40, 5000 + i % 700) for i in range(9000)) + "\n" + PASSAGE
    df = spark.createDataFrame([(1, text), *((10 + i, prose(40, 5000)) for i in range(12))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, 10).collect()}
    assert got[1].n_lines == 9001 and got[1].n_dropped == sum(i % 700 == 0 for i in range(9000)) and got[10].text == ""
    leaks = decontaminate.find_leaks(df, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.similarity, r.start) for r in leaks] == [(1, 1.0, 360_000)]


def test_the_sorted_sweep_is_in_the_plan(spark):
    """The optimizer must not drop the secondary sort."""
    df = spark.createDataFrame([(i, f"a\nb{i}") for i in range(30)], "doc_id long, text string")
    plan = line_dedup.common_lines(line_dedup.hashed_lines(df), 10)._jdf.queryExecution().executedPlan().toString()
    sweep = re.search(r"Sort \[a#\d+L[^,]*, b#\d+L[^,]*, salt#\d+[^,]*, doc_id#\d+L[^,]*, line#", plan)
    assert sweep and plan.index("Window") < sweep.start() < plan.index("rangepartitioning")

"""What the pipeline's Python operators ask of an executor's memory, beside their results."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from askframe.llm import bpe, simhash, toxicity


def held(spark):
    """MB that the largest Python worker holds, after its last task."""

    def ask(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        with open("/proc/self/smaps_rollup") as f:
            yield pa.RecordBatch.from_pydict({"mb": pa.array([sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) // 1024], pa.int64())})

    return max(r.mb for r in spark.range(0, 8, 1, 4).mapInArrow(ask, "mb long").collect())


@pytest.fixture
def many(spark):
    """24 MB of texts of 120,000 different pieces in one partition: a worker needs most for their cache and batches."""
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(200)) for _ in range(600)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 25)).coalesce(1)


def test_workers_give_memory_back(spark, many):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe.tokenize(spark.range(8).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text")), path, public_tokenizers.PATTERN).collect()
    before = held(spark)  # with the merge table
    got = bpe.tokenize(many, path, public_tokenizers.PATTERN).agg(F.count("*").alias("n"), F.sum(F.length("decoded")).alias("length")).first()
    assert got == (600, 600 * 25 * 200 * 8)
    assert held(spark) < before + 75


def test_batches_are_small(spark, many, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for use in (lambda: simhash.fingerprints(many, 5, bands=True), lambda: toxicity.score_toxicity(many, model=toxicity.BLANK), lambda: bpe.tokenize(many, "", "")):
        spark.conf.unset(key)
        use()
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20

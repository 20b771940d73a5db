"""A training-corpus pipeline: what toxicity, repeated lines, near-duplicates and benchmark leaks leave of documents, tokenized.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the last
returns the kept documents' token ids. Null texts count as empty; rows without a doc_id pass all stages like others; repeated rows
are one from the near-duplicates on; further columns, whatever their names, come through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm.bpe import tokenize
from askframe.llm.common import quoted, spill
from askframe.llm.decontaminate import drop_leaks
from askframe.llm.line_dedup import dedup_lines
from askframe.llm.simhash import keep_one
from askframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text."""
    kept = dedup_lines(docs, min_docs=10)
    return kept.select(*(F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else quoted(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return keep_one(docs, k=5, radius=18, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of what is left."""
    coded = tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("bpe", tokens)]
#: A learned classifier and min-hash bands have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

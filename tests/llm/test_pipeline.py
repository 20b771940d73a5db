"""The pipeline, stage by stage, against brute force on the same rows."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from askframe.llm import bpe, toxicity

from .test_operators import fingerprint_by_force, groups_by_force, lines_by_force, similarity_by_force


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.score(t) < toxicity.THRESHOLD]
    rows = [(i, t) for (i, t, _, _), n in lines_by_force(rows, 10).items() for _ in range(n)]
    rows.sort()
    sets = [fingerprint_by_force(t, 5) for _, t in rows]
    group = groups_by_force(sets, lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))
    rows = [r for n, r in enumerate(rows) if group[n] == n]
    rows = [(i, t) for i, t in rows if not any(similarity_by_force(t, x) >= 0.8 for x in items)]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f), special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: exact.encode_ordinary(t) for i, t in rows}


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []

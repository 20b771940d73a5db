"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a hash sample of all training documents, whatever their label, is unlabelled.
A linear model over hashed words and word stems (presence, a document's whole text) is fitted by numpy to the non-negative risk
``p R+(1) + max(0, R_u(0) - p R+(0))``, with p the share of toxic documents among the labelled ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import SMALL_BATCH_BYTES, arrow_schema, each, fold, lean, spill

#: Beside each word its first letters, so many of them, are features: inflected forms share a weight.
STEMS = (4, 5, 6)
#: Bounds of the fit: positives and unlabelled documents, each those with the smallest hash of their id. A feature's share among 8,000
#: unlabelled documents is known to 0.001 or better where it is 0.01 or less, a tenth of what LIFT asks for at MIN_DOCS of 4,000 and up.
FIT_POSITIVE, FIT_UNLABELLED = 4000, 8000
#: A word gets a weight if it is in MIN_DOCS positives and its share there is LIFT times that among the unlabelled, or more,
#: and SCREEN standard errors above it; words that merely go with long texts don't pass.
MIN_DOCS, LIFT, SCREEN = 3, 3.0, 5.0
#: Steps, step width and weight decay of the fit.
STEPS, RATE, DECAY = 200, 0.1, 1e-4
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """Sorted hashed words and stems of a text; empty for null."""
    if not text:
        return np.empty(0, np.uint32)
    words = set(_WORD.findall(text.lower()))
    stems = words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))
    return np.array(sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in stems}), np.uint32)


class Model:
    """score = sigmoid(bias + sum of the weights of the features present); known: sorted."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known.astype(np.uint32), weights, bias

    def score(self, text: str | None) -> float:
        x = self.bias
        if len(self.known):
            f = features(text)
            at = np.minimum(np.searchsorted(self.known, f), len(self.known) - 1)
            x += float(self.weights[at[self.known[at] == f]].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


#: Nothing to learn from.
BLANK = Model(np.empty(0), np.empty(0), -60.0)


def _stands_out(pos, free, n_pos: int, n_free: int, sqrt):
    """Whether a feature in pos of the positives and free of the unlabelled gets a weight."""
    share = (free + 1) / (n_free + 2)
    return (pos >= MIN_DOCS) & (pos >= LIFT * n_pos * share) & (pos - n_pos * share >= SCREEN * sqrt(n_pos * share * (1 - share)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Full-batch Adam on the corrected risk; where the unlabelled part turns negative, its gradient is reversed."""
    rows = positive + unlabelled
    if not positive or not unlabelled:
        return BLANK
    n_pos = len(positive)
    names, at = np.unique(np.concatenate(rows), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    in_pos, in_all = np.bincount(at[doc < n_pos], minlength=len(names)), np.bincount(at, minlength=len(names))
    keep = _stands_out(in_pos, in_all - in_pos, n_pos, len(unlabelled), np.sqrt)[at]
    used, at = np.unique(at[keep], return_inverse=True)
    doc = doc[keep]
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    is_pos = np.arange(len(rows)) < n_pos
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, w[at], minlength=len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        lost = np.logaddexp(0, z)  # as if the label were 0
        rest = lost[~is_pos].mean() - prior * lost[is_pos].mean()
        up = np.where(is_pos, 0.0, p / len(unlabelled)) - np.where(is_pos, prior * p / n_pos, 0.0)
        g_doc = np.where(is_pos, -prior * (1 - p) / n_pos, 0.0) + up if rest >= 0 else -up
        g = np.append(np.bincount(at, g_doc[doc], minlength=len(used)), g_doc.sum()) + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(names[used], w[:-1], float(w[-1]))


def _smallest(ids: DataFrame, n: int, kind: int) -> DataFrame:
    """The n ids with the smallest hash."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("kind", F.lit(kind))


def _fit_rows(docs: DataFrame, positive: DataFrame, free: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features of the fit's documents, a row each: of repeated ids the text with the smallest hash. Only features that can get
    a weight reach the driver."""
    spark = docs.sparkSession
    ids = spill(_smallest(positive, FIT_POSITIVE, 1).unionByName(_smallest(free, FIT_UNLABELLED, 0)), "fit_ids")
    near = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, x array<long>"
    out = arrow_schema(spark, schema, SMALL_BATCH_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).astype(np.int64) for t in each(batch.column(2))], pa.list_(pa.int64()))], schema=out)

    once = near.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(lean(pack), schema).groupBy("doc_id").agg(F.min_by("x", "th").alias("x"))
    rows = spill(once.join(F.broadcast(ids), "doc_id").select("kind", "x"), "fit")
    n = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    per = rows.select("kind", F.explode("x").alias("f")).groupBy("f").agg(F.count_if(F.col("kind") == 1).alias("pos"), F.count_if(F.col("kind") == 0).alias("free"))
    known = np.array(sorted(r.f for r in per.filter(_stands_out(F.col("pos"), F.col("free"), n.get(1, 0), n.get(0, 0), F.sqrt)).select("f").collect()), np.int64)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(v.values, np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[np.isin(v, known, assume_unique=True)].astype(np.uint32).tobytes() for v in x], pa.binary())], names=["kind", "x"])

    got = rows.mapInArrow(lean(few), "kind int, x binary").collect()  # FIT_POSITIVE and FIT_UNLABELLED rows, at most
    return tuple([np.frombuffer(r.x, np.uint32) for r in sorted(got, key=lambda r: r.x) if r.kind == kind] for kind in (1, 0))


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit outside the held-out fold. labels: doc_id, toxic (0/1, null: unknown)."""
    ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 1).select("doc_id", "toxic")
    share = known.agg(F.avg("toxic").alias("p")).first().p
    if not share:
        return BLANK
    free = docs.filter("doc_id is not null").filter(fold(F.col("doc_id")) != 1).select("doc_id")
    return fit(*_fit_rows(docs, known.filter("toxic = 1").select("doc_id"), free), float(share))


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; docs: doc_id, text.

    Defined cases: null, empty and wordless texts get the model's bias as score; with no toxic label to learn from all
    scores are about 0; repeated rows come back once each; whole texts count; a null doc_id is neither learned from nor
    held out; further columns are not looked at; an empty table gives an empty one.
    """
    model = model or learn_toxicity(docs, labels)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    out = arrow_schema(docs.sparkSession, schema, SMALL_BATCH_BYTES)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = np.array([model.score(t) for t in each(batch.column(2))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said), pa.array((said >= threshold).astype(np.int32))], schema=out)

    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text").mapInArrow(lean(predict), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score threshold or more; in place, without a shuffle.

    Defined cases: null, empty and wordless texts have the bias as score; repeated rows share their fate; rows without a doc_id are
    scored like others; columns of any name come back as they are; an empty table gives an empty one.
    """
    model = model or learn_toxicity(docs, labels)
    arrow_schema(docs.sparkSession, "doc_id long", SMALL_BATCH_BYTES)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in each(batch.column(at))], pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of any kind don't pass mapInArrow
    return plain.mapInArrow(lean(keep), plain.schema).toDF(*docs.columns)

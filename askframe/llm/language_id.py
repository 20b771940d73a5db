"""Language identification by rank-order profiles.

Each language's most frequent letter n-grams (1 to 3 letters, words padded with blanks) are ranked; a document's own most
frequent n-grams are compared with every profile by out-of-place distance, and the nearest profile names the language.
N-grams are packed into 64-bit integers and counted by numpy, so a whole text costs one sort per n-gram length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from .common import arrow_schema, each, fold, spill

#: Length of profiles.
RANKS = 400
#: Training documents per language, at most: those with the smallest hash of their id. Bounds the fit, not what is predicted.
FIT_PER_LANG = 1500
#: Shares in which a language's n-grams are ranked first.
SHARES = 16

_SYMBOL: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Code point -> lower-case letter's code point, or a blank for all that is no letter."""
    if not _SYMBOL:
        table = np.full(sys.maxunicode + 1, 32, np.uint64)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _SYMBOL.append(table)
    return _SYMBOL[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed, and their counts. No letters: empty arrays."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = _symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate((np.array([32], np.uint64), c, np.array([32], np.uint64)))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    if len(c) <= 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    three = three[c[1:-1] != 32]  # none across two words
    return np.unique(np.concatenate((c[c != 32], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int = RANKS) -> np.ndarray:
    """The n most frequent, ties by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


class Profiles:
    def __init__(self, by_lang: dict[str, list[int]]):
        self.langs = sorted(by_lang)
        self.tables = []
        for lang in self.langs:
            codes = np.array(by_lang[lang], np.uint64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order.astype(np.int64)))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(*grams(text))
        if not len(codes) or not self.langs:
            return "und", 0.0
        place, far = np.arange(len(codes)), []
        for known, rank in self.tables:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            far.append(int(np.where(known[at] == codes, np.minimum(np.abs(rank[at] - place), RANKS), RANKS).sum()))
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - far[best] / (RANKS * len(codes))


def _smallest(ids: DataFrame, per_lang: int) -> DataFrame:
    """doc_id, lang of the per_lang rows of each language whose id has the smallest hash.

    Of a language with many rows only those with a hash small enough for about four times as many are sorted, so that no task
    gets a language's rows; should they be too few (ids repeat), all are.
    """
    spark = ids.sparkSession
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().collect()}  # a row for each language
    hashed = ids.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    limits = spark.createDataFrame([(lang, int(-(2**63) + min(1.0, 4 * per_lang / n) * (2**64 - 2048))) for lang, n in counts.items()], "lang string, most long")
    few = hashed.join(F.broadcast(limits), "lang").filter("h <= most")
    least = Window.partitionBy("lang").orderBy("h", "doc_id")

    def first(rows: DataFrame) -> DataFrame:
        return spill(rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= per_lang).select("doc_id", "lang"), "fit_langs")

    got = first(few)
    found = {r.lang: r["count"] for r in got.groupBy("lang").count().collect()}
    return (got if all(found.get(lang, 0) >= min(per_lang, n) for lang, n in counts.items()) else first(hashed)).distinct()


def learn_profiles(docs: DataFrame, per_lang: int = FIT_PER_LANG) -> Profiles:
    """Profiles from documents with a language outside the held-out fold; per_lang bounds them for each language."""
    ship(docs.sparkSession)
    ids = docs.filter("lang is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 1).select("doc_id", "lang")
    ids = _smallest(ids, per_lang)
    chosen = [r[0] for r in ids.select("doc_id").collect()]  # per_lang ids for each language, at most
    if not chosen:
        return Profiles({})
    few = docs.sparkSession.createDataFrame([(x,) for x in set(chosen)], docs.select("doc_id").schema)
    fit = docs.filter("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                mine = total.setdefault(lang, {})
                for k, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    mine[k] = mine.get(k, 0) + n
        rows = [(lang, k, n) for lang, m in total.items() for k, n in m.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

    sums = fit.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for part in ((F.pmod(F.hash("gram"), F.lit(SHARES)),), ()):  # first in shares of a language, then what they leave
        top = sums = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang", *part).orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= RANKS)
    by_lang: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: (r.lang, r.r)):
        by_lang.setdefault(row.lang, []).append(row.gram)
    return Profiles(by_lang)


def identify_languages(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; docs: doc_id, text, and lang to learn from (if profiles is None).

    Defined cases: null, empty and letterless texts are 'und' with score 0, as is everything when nothing could be learned;
    repeated rows come back once each; whole texts count; equal distances go to the smaller language name; a null doc_id is
    neither learned from nor held out; further columns are not looked at.
    """
    profiles = profiles or learn_profiles(docs)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    out = arrow_schema(docs.sparkSession, schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [profiles.predict(t) for t in each(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], schema=out)

    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text").mapInArrow(predict, schema)

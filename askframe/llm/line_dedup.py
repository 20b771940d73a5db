"""Line dedup, DataFrame functions only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned, salted by document so that no line, however
common, meets in one task, with a secondary sort by document and position. A window streams each run and marks where a
document comes up first; the marks add up to the key's documents. What goes back to the documents is a keep bitmap: of its
64-bit words only those in which a bit is off, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, partitions, quoted, spill

SPACE = " \t\n\x0b\x0c\r"
#: Shares into which the rows of one key are split before they are added up.
SALT = 64


def line_keys(text: Column) -> Column:
    """array<struct<a, b, some>>: two independent hashes of every line's key, and whether it has a code point."""

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE))
        return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"), (F.octet_length(key) > 0).alias("some"))

    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), hashed)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line, a, b: a row for each line with a key."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(line_keys(F.col("text"))).alias("line", "k"))
    return rows.filter("k.some").select("doc_id", "text_hash", "line", "k.a", "k.b", F.pmod(F.hash("doc_id"), F.lit(SALT)).alias("salt"))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """a, b, salt, n_docs and the first document of every key found in min_docs documents or more, once for each salt it comes with."""
    swept = lines.select("a", "b", "salt", "doc_id", "line").repartitionByRange(partitions(lines.sparkSession), "a", "b", "salt")
    run = Window.partitionBy("a", "b", "salt").orderBy(F.asc_nulls_last("doc_id"), "line")
    new = (F.row_number().over(run) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(run))
    part = swept.withColumn("new", new & F.col("doc_id").isNotNull()).groupBy("a", "b", "salt").agg(F.count_if("new").alias("n"), F.min("doc_id").alias("least"))
    whole = Window.partitionBy("a", "b")  # SALT rows, at most
    return part.select("a", "b", "salt", F.sum("n").over(whole).alias("n_docs"), F.min("least").over(whole).alias("first")).filter(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_docs: int, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, words: for each document with lines to drop, the words of its keep bitmap that aren't all ones (word -> bits)."""
    lines = spill(hashed_lines(docs), "lines")
    hit = lines.join(common_lines(lines, min_docs), ["a", "b", "salt"])
    if keep_first:
        hit = hit.withColumn("nth", F.min("line").over(Window.partitionBy("doc_id", "text_hash", "a", "b")))
        hit = hit.filter(~(F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("line") == F.col("nth"))))
    word, bit = (F.col("line") / 64).cast("int"), F.expr("shiftleft(1L, line % 64)")
    bits = hit.groupBy("doc_id", "text_hash", word.alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return bits.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with text replaced by the lines that stay, plus n_lines and n_dropped.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased; keys without a code point are never
    common. keep_first leaves the first document's first copy. Defined cases: null text is one empty line and becomes '';
    a document is a doc_id, so repeated rows count once, and rows without an id are no document (they lose common lines all the
    same); texts of any length are taken whole; an empty table gives an empty one;
    other columns, whatever their names, come back as they are (but for n_lines and n_dropped, which are replaced).
    """
    rest = docs.drop("n_lines", "n_dropped")
    own, hash_, words = fresh(rest.columns, "doc", "hash", "words")
    marks = keep_bitmaps(docs.select("doc_id", "text"), min_docs, keep_first).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hash_), F.col("words").alias(words))
    joined = rest.join(marks, rest["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(rest["text"]) == F.col(hash_)), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")

    def stays(_: Column, i: Column) -> Column:
        return F.coalesce(F.getbit(F.element_at(words, F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1

    kept = F.when(F.col(words).isNull(), lines).otherwise(F.filter(lines, stays))
    dropped = F.when(F.col(words).isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(F.map_values(words), F.lit(0).cast("long"), lambda n, x: n + F.lit(64) - F.bit_count(x)))
    cols = [F.array_join(kept, "\n").alias("text") if c == "text" else quoted(c) for c in rest.columns]
    return joined.select(*cols, F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"))

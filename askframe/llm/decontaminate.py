"""Benchmark decontamination, DataFrame functions only.

Windows of a document, as many words long as a benchmark item, are fingerprinted by SimHash over their five-word shingles;
so are the items. Fingerprints meet through a multi-index: 64 bits in BLOCKS blocks, so any two within RADIUS bits differ by
RADIUS // BLOCKS bits at most in one of them. Items are entered under all block values so near; a window is looked up under its
own. Pairs that meet, each once, are verified by exact weighted (multiset) Jaccard similarity; only then shingles are fetched.

Windows start at every word, but only those that can reach the similarity are fingerprinted. One at 0.8 misses at most a
ninth of the item's shingles (0.2 of them if the document is shorter than the item). The item's keys are those with the
smallest hashes that weigh more than 0.2, so a window at 0.8 holds all of them but a ninth of the item's weight, in whatever
order. That selection loses no window; it is a filter before the fingerprints, not a way round them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, spill

WORDS = 5
SIMILARITY = 0.8
#: Bits in which a window's fingerprint may differ: at similarity 0.8 about 9.7 are expected, with a deviation of 2.9.
RADIUS = 19
#: Blocks of a fingerprint. More and shorter ones tell less apart: with 5 two random fingerprints meet with probability 0.21, with 20 of
#: 3 bits, which need no near values, 2.25 times. Fewer multiply the index (378 entries a block here, 2,517 with 4 blocks).
BLOCKS = 5
#: Keys up to which the benchmark's are broadcast (12 bytes each); beyond, the join shuffles, with a document's shingles in SALT shares.
BROADCAST_ROWS, SALT = 500_000, 16


def shingles(text: Column) -> Column:
    """Hashes of a text's five-word shingles in order; empty below five words."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def joined(h: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(h) - F.lit(WORDS - 1))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + F.lit(j - 1)) for j in range(WORDS))))

    # an array of one element, transformed, names the word hashes so that they are made once
    return F.flatten(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= WORDS, joined(h)).otherwise(F.array().cast("array<long>"))))


#: Every sixteenth bit: so many counters of 16 bits share a long.
LANES = 0x0001000100010001


def simhash(s: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeats weighing."""

    def lane(j: int) -> Column:
        return F.aggregate(s, F.lit(0).cast("long"), lambda n, h: n + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)))

    by_bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(s, F.lit(0).cast("long"), lambda n, h: n + F.getbit(h, b)))
    sums = F.array(*map(lane, range(16)))
    by_lane = F.transform(F.array(sums), lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftrightunsigned", F.get(x, b % 16), b - b % 16).bitwiseAND(F.lit(0xFFFF).cast("long"))))
    counts = F.when(F.size(s) < 0xFFFF, by_lane[0]).otherwise(by_bit)  # longer ones would overflow their lanes
    return F.aggregate(
        F.transform(counts, lambda n, b: F.when(2 * n > F.size(s), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(x),
    )


def _blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    cut = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, z - a) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def block_values(fp: Column, near: int = 0) -> Column:
    """array<struct<b, v>>: the values of the fingerprint's blocks, and those that differ by up to near bits."""

    def entries(b: int, first: int, bits: int) -> Column:
        own = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long")), lambda x: F.bit_count(x) <= near) if near else F.array(F.lit(0).cast("long"))
        return F.transform(flips, lambda x: F.struct(F.lit(b).alias("b"), own.bitwiseXOR(x).alias("v")))

    return F.concat(*(entries(b, first, bits) for b, (first, bits) in enumerate(_blocks())))


def multiset(s: Column) -> Column:
    """The array's elements as a set: each hashed with how many of its equals stand before it."""
    sorted_ = F.array_sort(s)
    return F.flatten(F.transform(F.array(sorted_), lambda a: F.transform(a, lambda x, i: F.xxhash64(x, i.cast("long") - F.array_position(a, x)))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, m (shingles), words, s, of items with five words or more."""
    rows = benchmark.filter("item_id is not null").select("item_id", shingles(F.col("text")).alias("s"))
    return rows.select("item_id", "s", F.size("s").alias("m")).filter("m > 0")


def _keys(items: DataFrame) -> DataFrame:
    """h, m: an item's shingles with the smallest hashes, over 0.2 of its weight."""
    return items.select("m", F.explode(F.slice(F.array_sort("s"), F.lit(1), _weight(F.col("m")))).alias("h")).select("h", "m").distinct()


def _weight(m: Column) -> Column:
    """How many shingles of an item its keys are, at least."""
    return (F.floor(m * F.lit(1 - SIMILARITY) + F.lit(1e-9)) + 1).cast("int")


def _starts(hits: Column, n: Column, m: Column) -> Column:
    """Starts, each once, of all windows of m out of n shingles with enough of the sorted places of keys to reach the similarity."""
    last = F.greatest(n - m, F.lit(0))
    need = F.when(n <= m, 1).otherwise(_weight(m) - F.floor(m * F.lit((1 - SIMILARITY) / (1 + SIMILARITY)) + F.lit(1e-9)).cast("int"))

    def runs(a: Column) -> Column:
        """For each run of as many keys as needed, first and last start of the windows that hold it and aren't named before."""

        def run(_: Column, i: Column) -> Column:
            high = F.least(F.get(a, i), last)
            low = F.greatest(F.get(a, i + need - 1) - m + 1, F.lit(0), F.when(i > 0, F.least(F.get(a, i - 1), last) + 1).otherwise(0))
            return F.struct(low.alias("low"), high.alias("high"))

        return F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - need + 1, F.lit(0))), run)

    some = F.filter(F.flatten(F.transform(F.array(hits), runs)), lambda r: r["low"] <= r["high"])
    return F.flatten(F.transform(some, lambda r: F.sequence(r["low"], r["high"])))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start (word): the best window of every leak; clean documents have no row.

    docs: doc_id, text; benchmark: item_id, text. A leak is a window, as long as the item and wherever it starts, of weighted
    shingle similarity 0.8 or more; a document shorter than the item is one window. Defined cases: items
    and documents of fewer than five words, null or empty have no shingles and match nothing; items without an id are
    left out; repeated items and rows don't multiply the result (one row for each doc_id and item_id; equal windows: the first);
    a null doc_id is an id like any other; texts of any length are taken whole; further columns are not looked at.
    """
    items = _items(benchmark)
    keys = _keys(items)
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text")
    spots = texts.select("doc_id", F.posexplode(shingles(F.col("text"))).alias("p", "h"))
    if few:
        hits = spots.join(F.broadcast(keys), "h")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
        hits = spots.withColumn("salt", F.pmod("p", F.lit(SALT))).join(keys.withColumn("salt", every), ["h", "salt"])
    hits = hits.groupBy("doc_id", "m").agg(F.array_sort(F.collect_set("p")).alias("hits"))
    places = hits.groupBy("doc_id").agg(F.collect_list(F.struct("m", "hits")).alias("places")).withColumnRenamed("doc_id", "_id")
    near = texts.join(places, F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.uuid().alias("row"), "doc_id", shingles(F.col("text")).alias("all"), "places")
    near = spill(near.filter(F.size("all") > 0), "near")

    def of_window(start: Column) -> Column:
        return F.slice("all", start + 1, F.col("m"))

    asked = near.select("row", "all", F.explode("places").alias("w")).select("row", "all", F.col("w.m").alias("m"), F.explode(_starts(F.col("w.hits"), F.size("all"), F.col("w.m"))).alias("start"))
    asked = spill(asked.select("row", "m", "start", simhash(of_window(F.col("start"))).alias("fp")), "windows")  # so that fingerprints are made once
    asked = asked.select("row", "m", "start", "fp", F.explode(block_values(F.col("fp"))).alias("k")).select("row", "m", "start", "fp", "k.b", "k.v")
    marked = items.select("item_id", "m", simhash(F.col("s")).alias("item_fp"))
    index = marked.select("item_id", "m", "item_fp", F.explode(block_values(F.col("item_fp"), RADIUS // BLOCKS)).alias("k")).select("item_id", "m", "item_fp", "k.b", "k.v")
    met = asked.join(index, ["m", "b", "v"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = met.groupBy("row", "item_id", "m").agg(F.collect_set("start").alias("starts"))  # a document's windows near one item
    both = pairs.join(near.select("row", "doc_id", "all"), "row").join(items.select("item_id", "m", multiset(F.col("s")).alias("y")), ["item_id", "m"])
    judged = F.transform("starts", lambda i: F.struct(weighted_jaccard(multiset(of_window(i)), F.col("y")).alias("similarity"), (-i).alias("back")))
    best = both.select("doc_id", "item_id", F.array_max(judged).alias("w")).filter(F.col("w.similarity") >= SIMILARITY).groupBy("doc_id", "item_id").agg(F.max("w").alias("w"))
    return best.select("doc_id", "item_id", F.col("w.similarity").alias("similarity"), (-F.col("w.back")).cast("long").alias("start"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the documents in which an item leaks.

    Defined cases: rows that share a doc_id, null too, go together; null and empty texts stay; columns of any name come back as
    they are; an empty table gives an empty one, an empty benchmark all rows.
    """
    (own,) = fresh(docs.columns, "doc")
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col(own)), "left_anti")

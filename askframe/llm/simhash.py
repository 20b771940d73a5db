"""SimHash near-duplicates: fingerprints, a binary trie self-join, connected components.

Distinct fingerprints are what is joined; copies share one. Any two within r bits agree in at least one of r + 1 blocks,
so each fingerprint goes to r + 1 groups, and each group is joined by its trie (see trie.py). A block value that very many
fingerprints share is cut again by the blocks of the remaining bits, by the same argument. Only links that connect are
passed on, and components are found by star steps over tables.

For wide radii, as a shingle similarity of 0.8 needs, blocks would be too short to tell anything apart. There the groups
are min-hash bands instead (20 bands of 3 rows: a pair at 0.8 misses all with probability 6e-7). Small groups give all their
pairs, the trie join runs inside the others, and links are verified by exact shingle similarity. The trie's forest, and with
it the radius, is only a first guess: groups that its verified links don't make one component are compared by exact
similarity, every pair of members of different components. Fingerprints weigh repeats and similarity doesn't, so no distance
between them rules a pair out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import SMALL_BATCH_BYTES, arrow_schema, each, lean, partitions, quoted, spill, words_of
from .components import components
from .trie import _expand, trie_links

SEED = 42
#: Distinct fingerprints of a block value above which it is cut again.
CUT_ABOVE = 2000
#: Rows that a task joins at once, at least; it ends at a group's end.
AT_ONCE = 200_000
BANDS, ROWS = 20, 3
#: Groups of so few members give all their pairs for verification, others a spanning forest of the nearest first.
ALL_PAIRS = 16
#: Members of a part of a group; a task compares two parts at a time.
PART = 2000

_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words: one shingle of all; none: empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    end = np.cumsum([len(w) + 1 for w in words])
    start = [0, *end[:-1].tolist()]
    stop = (end - 1).tolist()
    h = xxhash.xxh64_intdigest
    last = max(1, len(words) - k + 1)
    stop = stop[k - 1 :] if len(words) >= k else stop[-1:]
    return np.array([h(joined[a:b], SEED) for a, b in zip(start[:last], stop, strict=True)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if set in over half the hashes."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        total += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def bands_of(h: np.ndarray) -> list[int]:
    """One 64-bit key for each band of min-hashes."""
    if not len(h):
        return [0] * BANDS
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        x = h[at : at + 2048, None] * _A + _B
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(0))
    return [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) - 2**63 for i in range(BANDS)]


def fingerprints(docs: DataFrame, k: int, bands: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), fp (signed long with the fingerprint's bits) and, if asked for, node (hash of the shingle set) and bands."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long" + ", node long, bands array<long>" * bands
    out = arrow_schema(docs.sparkSession, schema, SMALL_BATCH_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, keys = [], [], []
            for text in each(batch.column(2)):
                h = shingle_hashes(text, k)
                fps.append(fingerprint(h))
                if bands:
                    h = np.unique(h)
                    nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                    keys.append(bands_of(h))
            cols = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))] * bands, schema=out)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(lean(work), schema)


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of parts blocks of width bits."""
    cut = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def block_groups(fps: DataFrame, radius: int) -> DataFrame:
    """fp, g1, g2: the groups in which a distinct fingerprint meets all others within radius bits."""
    blocks = _blocks(64, radius + 1)

    def value(c, first: int, bits: int):
        return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    fp = F.col("fp")
    one = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("b"), value(fp, a, n).alias("v")) for i, (a, n) in enumerate(blocks)))).alias("k")).select("fp", "k.b", "k.v")
    large = one.groupBy("b", "v").count().filter(F.col("count") > CUT_ABOVE).select("b", "v", F.lit(True).alias("large"))
    sub = []
    for i, (a, n) in enumerate(blocks):  # the other bits, moved together, in radius + 1 blocks
        rest = value(fp, 0, a) if a else F.lit(0).cast("long")
        if a + n < 64:
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, a + n), a))
        sub.append((i, F.array(*(F.shiftleft(value(rest, x, m), 4).bitwiseOR(F.lit(j + 1).cast("long")) for j, (x, m) in enumerate(_blocks(64 - n, radius + 1))))))
    pick = sub[0][1]
    for i, s in sub[1:]:
        pick = F.when(F.col("b") == i, s).otherwise(pick)
    cut = one.join(large, ["b", "v"], "left").withColumn("g2", F.explode(F.when(F.col("large"), pick).otherwise(F.array(F.lit(0).cast("long")))))
    return cut.select("fp", F.shiftleft("v", 8).bitwiseOR(F.col("b").cast("long")).alias("g1"), "g2")


def join_groups(rows: DataFrame, radius: int, full: int = 0) -> DataFrame:
    """a, b: connecting links between fingerprints, or nodes if there is such a column, of the same group (g1, g2).

    Groups of at most ``full`` members give all their pairs, whatever their distance.
    """
    spark = rows.sparkSession
    out = arrow_schema(spark, "a long, b long", SMALL_BATCH_BYTES)
    n = partitions(spark)
    named = ["g1", "g2", "fp", *(["node"] if "node" in rows.columns else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(parts: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(parts, axis=1)
            fp = x[2].view(np.uint64)
            order = np.lexsort((fp, x[1], x[0]))
            g1, g2, fp, node = x[0][order], x[1][order], fp[order], x[-1][order]
            new = np.concatenate(([True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])))
            group = np.cumsum(new)
            keep = np.concatenate(([True], (fp[1:] != fp[:-1]) | new[1:]))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(fp))
            few = ends - starts <= full
            rest = ~np.repeat(few, ends - starts)
            some = np.flatnonzero(keep & rest)
            i, j = trie_links(fp[some], group[some], radius)
            again = np.flatnonzero(~keep & rest)  # nodes of one fingerprint are linked in a row
            a, b = _expand(starts[few], ends[few], starts[few], ends[few])
            i, j = np.concatenate((some[i], again - 1, a[a < b])), np.concatenate((some[j], again, b[a < b]))
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], schema=out)

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(named))])
            if size >= AT_ONCE and x.shape[1]:
                last = held[-1][:2, -1:]
                other = np.flatnonzero((x[:2] != last).any(0))
                if len(other):
                    held.append(x[:, : other[0]])
                    yield joined(held)
                    held, size, x = [], 0, x[:, other[0] :]
            if x.shape[1]:
                held.append(x)
                size += x.shape[1]
        if held:
            yield joined(held)

    return rows.select(named).repartition(n, "g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(lean(work), "a long, b long").distinct()


def _shingle_sets(nodes: DataFrame, docs: DataFrame, prints: DataFrame, k: int) -> DataFrame:
    """node, s: the distinct shingles of the first document of each of nodes(node)."""
    first = prints.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("d")).select("node", F.col("d.doc_id").alias("_id"), F.col("d.th").alias("_th"))
    texts = docs.select("doc_id", "text").join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))).select("node", "text")
    out = arrow_schema(docs.sparkSession, "node long, s array<long>", SMALL_BATCH_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, k)).view(np.int64) for t in each(batch.column(1))], pa.list_(pa.int64()))], schema=out)

    return spill(texts.mapInArrow(lean(work), "node long, s array<long>"), "shingles")


def _similar(links: DataFrame, docs: DataFrame, prints: DataFrame, k: int, least: float) -> DataFrame:
    """The links whose nodes have a shingle similarity of at least ``least``."""
    ids = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    sets = _shingle_sets(ids, docs, prints, k)
    both = links.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def similar_pairs(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Index pairs at similarity ``least`` or more that join the labels: between side 0 and side 1, or among all if there is one side.

    A list of members for each shingle gives the exact shared counts of a member with all others; pairs whose labels are
    joined already are left out.
    """
    label = np.unique(label, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    two = side.any() and not side.all()
    listed = np.flatnonzero(side) if two else np.arange(len(sets))
    token = np.concatenate([sets[i] for i in listed])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], np.repeat(listed, size[listed])[order]
    out = []
    for i in np.flatnonzero(side == 0) if two else listed:
        if not (label[listed] != label[i]).any():
            continue
        lo, hi = np.searchsorted(token, sets[i]), np.searchsorted(token, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        ok = (shared > 0) & (shared >= least * (size[i] + size - shared))
        for j in np.flatnonzero(ok & (label != label[i])).tolist():
            if label[j] != label[i]:
                out.append((int(i), j))
                label[label == label[j]] = label[i]
    return out


def _among_groups(rows: DataFrame, links: DataFrame, docs: DataFrame, prints: DataFrame, k: int, least: float) -> DataFrame:
    """a, b: the links that groups of more than ALL_PAIRS members still need, as their verified links don't make them one component."""
    spark = rows.sparkSession
    group = components(links)
    size = rows.groupBy("g1", "g2").agg(F.count("*").alias("n")).filter(F.col("n") > ALL_PAIRS)
    named = rows.join(size, ["g1", "g2"]).join(group, "node", "left").select("g1", "g2", "n", "node", F.coalesce("component", "node").alias("label"))
    mixed = named.groupBy("g1", "g2").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("g1", "g2")
    named = spill(named.join(mixed, ["g1", "g2"]), "members")
    # a group is cut into parts by hash and every two parts meet in a unit of their own
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    unit = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(j, part).alias("i"), F.greatest(j, part).alias("j"), (part > j).cast("long").alias("side")))
    dealt = named.withColumn("u", F.explode(unit)).select("g1", "g2", "u.i", "u.j", "u.side", "node", "label")
    sets = _shingle_sets(named.select("node").distinct(), docs, prints, k)
    out = arrow_schema(spark, "a long, b long", SMALL_BATCH_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> pa.RecordBatch:
            node = np.array([x[0] for x in held], np.int64)
            got = similar_pairs([x[3] for x in held], np.array([x[1] for x in held]), np.array([x[2] for x in held]), least)
            return pa.RecordBatch.from_arrays([pa.array(node[[x[c] for x in got]] if got else node[:0]) for c in range(2)], schema=out)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(7)]
            for r, key in enumerate(zip(*cols[:4], strict=True)):
                if key != now:
                    if held:
                        yield found()
                    now, held = key, []
                held.append((cols[5][r], cols[6][r], cols[4][r], np.array(batch.column(7)[r].values, np.int64)))
        if held:
            yield found()

    units = dealt.join(sets, "node").select("g1", "g2", "i", "j", "side", "node", "label", "s")
    return units.repartition(partitions(spark), "g1", "g2", "i", "j").sortWithinPartitions("g1", "g2", "i", "j").mapInArrow(lean(work), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id for every document; docs: doc_id, text.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, shingles are k words. Without similarity, fingerprints at radius bits
    or fewer link. With it, documents whose shingle sets reach it link, and no others, whatever their fingerprints (radius then only
    says which pairs of a large group are tried first).
    Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; fewer than k words are one
    shingle; repeated rows come back once each and are copies; a null doc_id links like any other but is no component's
    smallest id (component_id is null if there is no other); further columns are not looked at; texts count whole.
    """
    ship(docs.sparkSession)
    prints = spill(fingerprints(docs, k, bands=similarity is not None), "fingerprints")
    if similarity is None:
        rows = block_groups(prints.select("fp").distinct(), radius)
        links = join_groups(rows, radius)
        prints = prints.select("doc_id", "fp", F.col("fp").alias("node"))
    else:
        once = prints.groupBy("node").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"))
        rows = spill(once.select("node", "fp", F.posexplode("bands").alias("g1", "g2")).withColumn("g1", F.col("g1").cast("long")), "bands")
        links = spill(_similar(spill(join_groups(rows, radius, ALL_PAIRS), "candidates"), docs, prints, k, similarity), "similar")
        links = links.unionByName(spill(_among_groups(rows, links, docs, prints, k, similarity), "among"))
        prints = prints.select("doc_id", "fp", "node")
    group = components(links).withColumnRenamed("node", "_node")
    first = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    known = first.join(group, first["node"] == group["_node"], "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select("node", "component_id")
    return prints.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, radius: int = 18, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one document of each near-duplicate group: the smallest doc_id, once.

    Defined cases: rows without a doc_id stay; repeated rows become one; rows of one doc_id with different texts stay, if that id
    stays; null, empty and wordless texts are one group; columns of any name come back as they are; an empty table gives an empty one.
    """
    stay = near_duplicates(docs, k, radius, similarity).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").repartition("doc_id").dropDuplicates(["doc_id", "text"])
    return named.join(stay, "doc_id", "left_semi").select(*map(quoted, docs.columns)).unionByName(docs.filter("doc_id is null"))

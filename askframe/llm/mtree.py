"""Exact top-k inner products with paged M-trees.

Vectors are quantised to integers. Each candidate goes to the nearest of a bounded number of pivots, and a pivot's rows are
dealt to pages of a bounded size. Each page becomes an M-tree once and is written to the shared folder: nodes hold a pivot, a
covering radius and, for each entry, its distance to the pivot. Queries go in blocks by their nearest pivots; a block meets the
pages of its own pivots first, carries its k-th best scores on from page to page, and searches each tree best-first:
<q, x> = <q, p> + <q, x - p> <= <q, p> + |q| * d(x, p) bounds an entry by its stored distance and a subtree by its covering
radius, so products with entries that can't reach the k-th best score are never computed.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, partitions, spill

#: Vectors of a tree page; entries of a leaf; children of an inner node.
PAGE, LEAF, FANOUT = 8192, 128, 16
#: Queries of a block.
BLOCK = 2048
#: Rows that serve as pivots, at most: those with the smallest hash of their id. They only decide what lies together.
PIVOTS = 256
#: Products below this are exact in doubles; pages with larger components are multiplied as 64-bit integers, without bounds.
EXACT = float(1 << 53)
#: Tasks of a search; one takes several cells, one after the other.
MOST_TASKS = 20_000


def quantised(v: Column) -> Column:
    """floor(256 x) of every component; null where the vector or a component is null or not finite."""
    x = F.transform(v, lambda c: c.cast("double"))
    bad = v.isNull() | F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(c * 256.0).cast("long")))


class Tree:
    """An M-tree over the rows of ids and vectors (int64), built by recursive pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.whole = ids[order], vectors[order].astype(np.float64), None
        self.large = float(np.abs(self.x).max()) if vectors.size else 0.0
        self.products = 0  # computed so far
        if self.large**2 * max(1, vectors.shape[-1]) >= EXACT:
            self.whole = vectors[order]
        #: per node: pivot (row), covering radius, rows with distances to the pivot (leaf), or children with theirs
        self.nodes: list[tuple[int, float, np.ndarray | None, np.ndarray | None, list[int], np.ndarray | None]] = []
        self.root = self._build(np.arange(len(ids)), 0) if len(ids) else -1

    def __getstate__(self) -> dict:
        """Components travel in the shortest integers that hold them."""
        x = self.x.astype(np.int64) if self.whole is None else self.whole
        least = np.result_type(*(np.min_scalar_type(int(v)) for v in (x.min(initial=0), x.max(initial=0))))
        return self.__dict__ | {"x": x.astype(np.int64 if least.kind == "f" else least), "whole": self.whole is not None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.whole = state["x"].astype(np.int64) if state["whole"] else None
        self.x = state["x"].astype(np.float64)

    def _far(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self.x[rows] - self.x[pivot]) ** 2).sum(1))

    def _build(self, rows: np.ndarray, pivot_at: int) -> int:
        pivot = int(rows[pivot_at])
        far = self._far(rows, pivot)
        radius = float(far.max())
        if len(rows) <= LEAF or radius == 0:  # equal vectors are one leaf, whatever their number
            order = np.argsort(far, kind="stable")
            self.nodes.append((pivot, radius, rows[order], far[order], [], None))
            return len(self.nodes) - 1
        chosen, near = [pivot_at], far.copy()
        owner = np.zeros(len(rows), np.int64)
        for k in range(1, FANOUT):  # the farthest row so far is the next pivot
            at = int(near.argmax())
            if near[at] == 0:
                break
            chosen.append(at)
            d = self._far(rows, int(rows[at]))
            closer = d < near
            owner[closer], near[closer] = k, d[closer]
        children, to = [], []
        for k, at in enumerate(chosen):
            mine = np.flatnonzero(owner == k)
            if len(mine):
                children.append(self._build(rows[mine], int(np.searchsorted(mine, at))))
                to.append(far[at])
        self.nodes.append((pivot, radius, None, None, children, np.array(to)))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, own: np.ndarray, best: "Best") -> None:
        """Best-first for a block of queries: the node that promises most to any of them comes next, with those it can still serve."""
        if self.root < 0 or self.x.shape[1] != queries.shape[1]:
            return
        q = queries.astype(np.float64)
        if self.whole is not None or (len(q) and np.abs(q).max(initial=0.0) * self.large * max(1, q.shape[1]) >= EXACT):
            whole = self.x.astype(np.int64) if self.whole is None else self.whole
            self.products += len(q) * len(whole)
            if (np.abs(q) @ np.abs(self.x).T).max(initial=0.0) >= 0.99 * 2**63:
                raise OverflowError("a score has more than 64 bits")
            best.add(np.arange(len(q)), self.ids, queries @ whole.T, own)
            return
        length = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
        pivot, radius, *_ = self.nodes[self.root]
        score = q @ self.x[pivot]
        bound = score + length * radius
        heap = [(-float(bound.max()), self.root, np.arange(len(q)), score, bound)] if len(q) else []
        while heap:
            _, node, who, score, bound = heapq.heappop(heap)
            able = bound >= best.least[who] - 1e-6
            if not able.any():
                continue
            who, score = who[able], score[able]
            pivot, radius, rows, far, children, to = self.nodes[node]
            if rows is not None:
                # entries are sorted by distance: those too near the pivot for every query need no product
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(length[who] > 0, (best.least[who] - 1e-6 - score) / length[who], -np.inf).min()
                skip = int(np.searchsorted(far, need - 1e-9)) if np.isfinite(need) else 0
                rows = rows[skip:]
                self.products += len(who) * len(rows)
                best.add(who, self.ids[rows], q[who] @ self.x[rows].T, own)
                continue
            for child, d in zip(children, to.tolist(), strict=True):
                r = self.nodes[child][1]
                near = score + length[who] * (d + r) >= best.least[who] - 1e-6  # parent distance: no product needed for the others
                some = who[near]
                if not len(some):
                    continue
                self.products += len(some) * (self.nodes[child][0] != pivot)
                s = score[near] if self.nodes[child][0] == pivot else q[some] @ self.x[self.nodes[child][0]]
                up = s + length[some] * r
                ok = up >= best.least[some] - 1e-6
                if ok.any():
                    heapq.heappush(heap, (-float(up[ok].max()), child, some[ok], s[ok], up[ok]))


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id; least: what a newcomer must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.kept, self.least = k, [[] for _ in range(n)], np.full(n, -np.inf)

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        k = self.k
        none = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
        scores = np.where(ids[None, :] == own[who][:, None], none, scores)  # rows with the query's own id, however many
        if scores.shape[1] > k:  # the k best and their ties are enough
            cut = np.maximum(self.least[who], np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
        else:
            cut = self.least[who]
        if scores.dtype.kind != "f":  # compared as doubles: what rounding could hide stays in
            cut = cut - np.abs(cut) * 1e-15 if np.isfinite(cut).all() else np.where(np.isfinite(cut), cut - np.abs(cut) * 1e-15, cut)
        r, c = np.nonzero(scores >= cut[:, None])
        for i, v, s in zip(who[r].tolist(), ids[c].tolist(), scores[r, c].tolist(), strict=True):
            if v == own[i]:
                continue
            best = self.kept[i]
            if len(best) < k:
                heapq.heappush(best, (s, -v))
            elif (s, -v) > best[0]:
                heapq.heapreplace(best, (s, -v))
            if len(best) == k:
                self.least[i] = best[0][0]

    def rows(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        return [(int(own[i]), -v, int(s)) for i, best in enumerate(self.kept) for s, v in best]


def _grouped(rows: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """vec_id, x, g: the number of the nearest pivot of the vector's length, or -1."""
    schema = "vec_id long, x array<long>, g int"
    out = arrow_schema(rows.sparkSession, schema)
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(pivots):
        by_length.setdefault(len(p), []).append(i)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(v.values, np.float64) for v in batch.column(1)]
            g = np.full(len(x), -1, np.int32)
            for n, which in by_length.items():
                at = [i for i, v in enumerate(x) if len(v) == n]
                for part in range(0, len(at) if n else 0, 1024):
                    some, p = at[part : part + 1024], np.stack([pivots[i] for i in which]).astype(np.float64)
                    v = np.stack([x[i] for i in some])
                    g[some] = np.array(which, np.int32)[((p * p).sum(1)[None, :] - 2 * (v @ p.T)).argmin(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(g)], schema=out)

    return rows.mapInArrow(deal, schema)


def _packed(df: DataFrame, size: int, tree: bool) -> DataFrame:
    """g, slot, blob: runs of at most size vectors of one slot and one length; as trees, or as ids and components. g: the first one's."""
    schema = "g int, slot int, blob binary"
    out = arrow_schema(df.sparkSession, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def packed() -> pa.RecordBatch:
            ids, x = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64).reshape(len(held), -1)
            return pa.RecordBatch.from_arrays([pa.array([held[0][2]], pa.int32()), pa.array([now[0]], pa.int32()), pa.array([pickle.dumps(Tree(ids, x) if tree else (ids, x), 5)], pa.binary())], schema=out)

        for batch in batches:
            for g, slot, i, v in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                key = (slot, len(v))
                if held and (key != now or len(held) == size):
                    yield packed()
                    held = []
                now = key
                held.append((i, v, g))
        if held:
            yield packed()

    return df.select("g", "slot", "vec_id", "x").sortWithinPartitions("slot", F.size("x")).mapInArrow(pack, schema)


def _chain(pivots: list[np.ndarray]) -> list[int]:
    """The pivots' numbers, each followed by the nearest of its length that is left; -1 comes last."""
    left, out = list(range(len(pivots))), []
    while left:
        same = [i for i in left if out and len(pivots[i]) == len(pivots[out[-1]])]
        out.append(min(same, key=lambda i: ((pivots[i] - pivots[out[-1]]) ** 2).sum()) if same else left[0])
        left.remove(out[-1])
    return [*out, -1]


def _slots(chain: list[int], sizes: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int], int]:
    """For each pivot its first slot and how many it has; all slots. Neighbours with few rows share one, a pivot with many has several."""
    first, many, at, filled = {}, {}, 0, 0
    for g in chain:
        n = sizes.get(g, 0)
        if not n:
            continue
        if filled and filled + n > size:
            at, filled = at + 1, 0
        first[g], many[g] = at, max(1, -(-n // size))
        if many[g] > 1:
            at += many[g]
        else:
            filled += n
    return first, many, at + (filled > 0)


def _of(numbers: dict[int, int], otherwise: int) -> Column:
    """The number of the pivot g."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in numbers.items() for v in pair)), F.col("g")), F.lit(otherwise))


def _dealt(rows: DataFrame, first: dict[int, int], many: dict[int, int], n: int) -> DataFrame:
    """rows with their slot, on n partitions."""
    return rows.withColumn("slot", (_of(first, 0) + F.floor(F.rand(7) * _of(many, 1))).cast("int")).repartition(n, "slot")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of every row whose vec_id is divisible by ``every``.

    vectors: vec_id, embedding. Defined cases: vectors that are null, or hold null or non-finite components, and null ids take
    no part; ties go to the smaller vec_id; a row is no candidate of a query with the same id; repeated rows of another id
    are candidates each, and repeated query rows ask each, so that their pairs are ranked together; vectors of another length than the query's are none; fewer candidates give fewer rows; empty vectors
    score 0; further columns are not looked at. Scores are exact; what could exceed 64 bits raises.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("x")).filter("x is not null and vec_id is not null")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(PIVOTS)  # PIVOTS rows reach the driver, at most
    pivots = [np.array(x, np.float64) for x in dict.fromkeys(tuple(r.x) for r in chosen.collect())]
    rows = spill(_grouped(rows, pivots), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0)
    counts = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()  # a row for each pivot
    sizes, asks = {r.g: r.n for r in counts}, {r.g: r.q for r in counts if r.q}
    schema = "query_id long, vec_id long, score long"
    if not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chain, page = _chain(pivots), min(PAGE, max(512, -(-sum(sizes.values()) // n)))
    *of_rows, pages = _slots(chain, sizes, page)
    *of_queries, cells = _slots(chain, asks, BLOCK)
    trees = spill(_packed(_dealt(rows, *of_rows, min(pages, MOST_TASKS)), PAGE, True), "trees")
    blocks = spill(_packed(_dealt(queries, *of_queries, min(cells, MOST_TASKS)), BLOCK, False), "queries")
    out = arrow_schema(spark, schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []  # the cell's blocks: ids, queries, best so far

        def found() -> pa.RecordBatch:
            got = [g for own, _, best in held for g in best.rows(own)]
            return pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], pa.int64()) for c in range(3)], schema=out)

        for batch in batches:
            for s, b, kind, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if (s, b) != cell:
                    if held:
                        yield found()
                    cell, held = (s, b), []
                got = pickle.loads(blob.as_buffer())
                if kind:
                    for own, q, best in held:
                        got.search(q, own, best)
                else:
                    held.append((*got, Best(len(got[0]), k)))
        if held:
            yield found()

    # A grid: pages are copied along the query blocks and query blocks along the shares of pages; a cell is read as a stream, queries first.
    shares = min(pages, n)

    def along(last: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(last - 1)))

    asked = blocks.select(along(shares).alias("s"), F.col("slot").alias("b"), F.lit(0).alias("kind"), F.lit(0).alias("far"), "blob")
    spread = trees.select("g", F.pmod("slot", F.lit(shares)).alias("s"), along(cells).alias("b"), "blob")
    spread = spread.select("s", "b", F.lit(1).alias("kind"), F.abs(F.col("b") - _of(of_queries[0], 0)).alias("far"), "blob")
    met = asked.unionByName(spread).repartition(min(shares * cells, MOST_TASKS), "s", "b").sortWithinPartitions("s", "b", "kind", "far")
    found = met.select("s", "b", "kind", "blob").mapInArrow(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

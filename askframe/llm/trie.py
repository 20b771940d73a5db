"""Self-join of 64-bit fingerprints within a Hamming radius, on binary tries, with numpy.

The fingerprints of a group, sorted, are a binary trie: a node is a range, its children are cut where the next bit turns
to 1. Pairs of nodes go down together, a level at a time, adding the bits in which they differ, and are dropped when the
sum exceeds the radius. Only links for connected components are asked for: pairs of nodes that already lie wholly in
one component are dropped too, so a dense cluster costs little more than its size.
"""

from __future__ import annotations

import numpy as np

#: Node pairs that go down together; more wait on a stack. They cost 40 bytes each, and up to three lots wait on each of 64 levels.
FRONTIER = 200_000
#: Node pairs of so few fingerprint pairs are compared directly.
SMALL = 8


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        parent = _roots(parent)
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return parent
        i, j = i[open_], j[open_]
        np.minimum.at(parent, np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_]))


def _expand(lo1, hi1, lo2, hi2):
    """All index pairs of node pairs."""
    n2 = hi2 - lo2
    size = (hi1 - lo1) * n2
    which = np.repeat(np.arange(len(size)), size)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return lo1[which] + nth // n2[which], lo2[which] + nth % n2[which]


def trie_links(fps: np.ndarray, groups: np.ndarray, radius: int, full: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect, within each group, all fingerprints reachable by steps of at most radius bits.

    fps: uint64, groups: integers; both sorted by (group, fp), no repeats. Groups of at most ``full`` members give all
    their pairs within the radius, others a spanning forest that prefers small distances.
    """
    n = len(fps)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    keep_all = np.repeat(ends - starts <= full, ends - starts)
    all_of = np.zeros(n, bool)
    all_of[_range_members(starts, ends)] = keep_all
    counts = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in counts:
            counts[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return counts[bit]

    parent = np.arange(n)
    run = parent  # numbers of runs of one component; made anew when components were joined
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(63, starts[k : k + FRONTIER], ends[k : k + FRONTIER], starts[k : k + FRONTIER], ends[k : k + FRONTIER], np.zeros(min(FRONTIER, len(starts) - k), np.int64)) for k in range(0, len(starts), FRONTIER)]
    while stack:
        bit, lo1, hi1, lo2, hi2, d = stack.pop()
        if run is None:
            run = np.cumsum(np.concatenate(([0], parent[1:] != parent[:-1])))
        done = (run[lo1] == run[hi1 - 1]) & (run[lo2] == run[hi2 - 1]) & (parent[lo1] == parent[lo2]) & ~all_of[lo1]
        if done.any():
            lo1, hi1, lo2, hi2, d = (x[~done] for x in (lo1, hi1, lo2, hi2, d))
        if not len(lo1):
            continue
        small = (hi1 - lo1) * (hi2 - lo2) <= SMALL
        if bit < 0:
            small[:] = True
        if small.any():
            i, j = _expand(lo1[small], hi1[small], lo2[small], hi2[small])
            ok = i < j
            i, j = i[ok], j[ok]
            far = np.bitwise_count(fps[i] ^ fps[j])
            ok = far <= radius
            i, j, far = i[ok], j[ok], far[ok]
            if len(i):
                whole = all_of[i]
                if whole.any():
                    out.append((i[whole], j[whole]))
                for r in np.unique(far[~whole]):
                    at = ~whole & (far == r)
                    a, b = i[at], j[at]
                    fresh = parent[a] != parent[b]
                    a, b = a[fresh], b[fresh]
                    if len(a):
                        before = parent
                        parent, run = _union(parent.copy(), a, b), None
                        out.append(_forest(before, a, b))
            lo1, hi1, lo2, hi2, d = (x[~small] for x in (lo1, hi1, lo2, hi2, d))
            if not len(lo1):
                continue
        c = ones(bit)
        m1, m2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
        same = lo1 == lo2
        other = ~same
        parts = [(lo1, m1, lo2, m2, d), (m1, hi1, m2, hi2, d), (lo1, m1, m2, hi2, d + 1), (m1[other], hi1[other], lo2[other], m2[other], d[other] + 1)]
        a1, b1, a2, b2, e = (np.concatenate([p[k] for p in parts]) for k in range(5))
        ok = (a1 < b1) & (a2 < b2) & (e <= radius) & ~((a1 == a2) & (b1 - a1 == 1))
        a1, b1, a2, b2, e = a1[ok], b1[ok], a2[ok], b2[ok], e[ok]
        stack += [(bit - 1, a1[k : k + FRONTIER], b1[k : k + FRONTIER], a2[k : k + FRONTIER], b2[k : k + FRONTIER], e[k : k + FRONTIER]) for k in range(0, len(a1), FRONTIER)]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _range_members(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


def _forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b between components, as many as join them: a small union-find over their roots."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    keep = []
    for k, (x, y) in enumerate(zip(parent[a].tolist(), parent[b].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]

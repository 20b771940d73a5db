"""From distributions over options to one consistent reading."""

from __future__ import annotations

import heapq
import math

NONE_FLOOR, ROLE_FLOOR, NONE_PRIOR = 1e-6, 1e-9, 0.05


def assignment(cost: list[list[float]]) -> list[int]:
    """For each row the column of the cheapest one-to-one assignment (rows <= columns).

    Rows are few, so partial assignments are grown cheapest first; what the open rows cost at least is the sum of their cheapest
    columns, and the first complete assignment to come up is the best.
    """
    if cost and len(cost) > len(cost[0]):
        raise ValueError("more rows than columns")
    rest = [sum(min(r) for r in cost[i:]) for i in range(len(cost) + 1)]
    grown: list[tuple[float, float, tuple[int, ...]]] = [(rest[0], 0.0, ())]
    while True:
        _, spent, chosen = heapq.heappop(grown)
        n = len(chosen)
        if n == len(cost):
            return list(chosen)
        for j, c in enumerate(cost[n]):
            if j not in chosen:
                heapq.heappush(grown, (spent + c + rest[n + 1], spent + c, (*chosen, j)))


def assign_spans(probs: dict[str, dict[str, float]], reusable: frozenset[str] = frozenset()) -> dict[str, str | None]:
    """Each span's role, most likely together; a role is used once unless reusable, and a span may have none."""
    spans = list(probs)
    single = sorted({r for p in probs.values() for r in p if r not in reusable and r != "none"})
    columns: list[tuple[str, str | None]] = [(r, None) for r in single] + [(r, s) for s in spans for r in (*sorted(reusable), "none")]

    def cost(s: str, col: tuple[str, str | None]) -> float:
        role, own = col
        if own is not None and own != s:
            return 1e6
        p = probs[s].get(role, NONE_PRIOR if role == "none" else 0.0)
        return -math.log(max(p, NONE_FLOOR if role == "none" else ROLE_FLOOR))

    if not spans:
        return {}
    picked = assignment([[cost(s, c) for c in columns] for s in spans])
    return {s: None if columns[j][0] == "none" else columns[j][0] for s, j in zip(spans, picked, strict=True)}


def joint_decode(quantity: dict[str, float], agg: dict[str, float], legal) -> tuple[tuple[str, str] | None, tuple[str, str] | None]:
    """The likeliest legal (quantity, aggregate), and the illegal one that beats it by half, if any. Counts ignore the aggregate."""
    best: dict[bool, tuple[float, tuple[str, str] | None]] = {True: (0.0, None), False: (0.0, None)}
    for q, p in quantity.items():
        allowed = legal(q)
        if q.startswith("count:"):
            if p > best[True][0]:
                best[True] = (p, (q, "count_rows"))
            continue
        for a, w in agg.items():
            ok = a in allowed
            if p * w > best[ok][0]:
                best[ok] = (p * w, (q, a))
    return best[True][1], best[False][1] if best[False][0] > 1.5 * best[True][0] else None

"""Exact substring dedup with suffix arrays sorted deep-shallow.

Wanted: every 100-byte string that also starts earlier. A corpus's suffixes can't be sorted in one place, so windows are
dealt by content: a window's minimizer (the smallest hash of its 32-byte substrings, the leftmost of equals) is the same
wherever the window stands. Consecutive windows with one minimizer travel as one segment, so a window costs a few bytes.

1. Each document's segments are found by numpy. Only hashes go through the shuffle, packed in blobs: minimizer, segment,
   document, place. Equal segments of a batch are settled before it, so a passage however common sends one entry a batch.
2. Of equal segments all but the earliest are repeats. Minimizers with a single segment are done. For the others, each distinct
   segment's earliest copy is cut out of its text.
3. These segments' suffixes, one for each window, are sorted: multikey quicksort on 8-byte characters to a shallow depth,
   then blind tries for the groups that are still together. Runs with 100 bytes in common are equal windows; all but the
   earliest are repeats. Minimizers with very many segments are first cut by what surrounds the minimizer.
4. Repeats become byte ranges for each document, and documents lose them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, partitions, spill

#: Bytes of a repeated string, and of the substrings whose hashes make minimizers.
LENGTH, KMER = 100, 32
#: Depth in bytes to which multikey quicksort goes.
SHALLOW = 32
#: Distinct segments of a minimizer above which it is cut into stripes of so many windows.
CUT_ABOVE, STRIPE = 512, 8
#: Bytes of cut segments that are dealt to their buckets together, at least.
CUT_BYTES = 4 << 20
#: Bytes of a text that numpy works on at once; a power of two.
PIECE = 1 << 20

_RANDOM = np.random.default_rng(11)
_TABLE = _RANDOM.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C13, 0xD1342543DE82EF93)
#: Columns of a packed table of segments: minimizer, segment hash, document, hash of its text, first window, windows, minimizer's place from there.
_ENTRY = (("k", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("at", "<i8"), ("n", "<i4"), ("o", "<i2"))
#: Of ranges to remove, and of segments to cut out (cut: 1 if the minimizer is to be cut into stripes).
_RANGE = (("doc", "<i8"), ("th", "<i4"), ("at", "<i8"), ("end", "<i8"))
_WANT = (("k", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("at", "<i8"), ("n", "<i4"), ("o", "<i2"), ("cut", "<i1"))
_PIECES = (("k", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("at", "<i8"), ("n", "<i4"))
_TEXTS = (("doc", "<i8"), ("th", "<i4"), ("size", "<i8"))
#: Kinds of blobs; in a bucket they come in this order.
SEGMENTS, RANGES, WANTED, CUTS, TEXTS = range(5)
_NO_ID = np.iinfo(np.int64).min
BLOB = "bucket int, kind int, blob binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.cumprod(np.full(n - 1, base, np.uint64)) if n > 1 else out[1:]
    return out


_POW = [_powers(b, PIECE + 2 * LENGTH + 2) for b in _BASE]
_INVERSE = [np.uint64(pow(b, -1, 1 << 64)) for b in _BASE]
_INV_POW = [_powers(int(i), PIECE + 2 * LENGTH + 2) for i in _INVERSE]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _prefix(b: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of table[b[i]] * base**i, modulo 2**64."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[which][b] * _POW[which][: len(b)], out=out[1:])
    return out


def _spans_hash(prefix: np.ndarray, which: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of b[lo:hi]: the same for equal contents."""
    return _mix((prefix[hi] - prefix[lo]) * _INV_POW[which][lo])


def segments(text: bytes) -> tuple[np.ndarray, ...]:
    """Minimizer hash, segment hash, first window, number of windows and minimizer's place of each segment; windows in order, each in one."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for at in range(0, max(0, len(text) - LENGTH + 1), PIECE):
        b = np.frombuffer(text[at : at + PIECE + LENGTH - 1], np.uint8)
        n_windows = len(b) - LENGTH + 1
        p0, p1 = _prefix(b, 0), _prefix(b, 1)
        start = np.arange(len(b) - KMER + 1)
        h = _mix((p0[KMER:] - p0[:-KMER]) * _INV_POW[0][: len(start)])
        low = (h & ~np.uint64(PIECE * 2 - 1)) | start.astype(np.uint64)
        span, width = 1, LENGTH - KMER + 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: n_windows], low[width - span : width - span + n_windows])
        place = (low[:n_windows] & np.uint64(PIECE * 2 - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, n_windows))
        parts[0].append(h[place[first]])
        end = first + count + LENGTH - 1
        parts[1].append(_spans_hash(p0, 0, first, end) ^ _mix(_spans_hash(p1, 1, first, end) + count.astype(np.uint64)))
        parts[2].append(first + at)
        parts[3].append(count)
        parts[4].append(place[first] - first)
    if not parts[0]:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(p) for p in parts)


def _pack(cols: dict[str, np.ndarray], kind: tuple, tail: bytes = b"") -> bytes:
    n = len(cols[kind[0][0]])
    raw = [np.array([n], "<i8").tobytes()]
    for name, t in kind:
        x = cols[name].astype(t)
        raw.append((np.diff(x, prepend=x.dtype.type(0)) if name in ("doc", "at") else x).tobytes())
    return zstandard.compress(b"".join(raw) + tail, 1)


def _unpack(blob: bytes, kind: tuple) -> tuple[dict[str, np.ndarray], memoryview]:
    raw = memoryview(zstandard.decompress(blob))
    n, at, cols = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
    for name, t in kind:
        x = np.frombuffer(raw, t, n, at)
        at += x.nbytes
        cols[name] = np.cumsum(x, dtype=t) if name in ("doc", "at") else x
    return cols, raw[at:]


def _gather(blobs: list[bytes], kind: tuple) -> dict[str, np.ndarray]:
    cols = [_unpack(b, kind)[0] for b in blobs]
    return {name: np.concatenate([c[name] for c in cols]) if cols else np.empty(0, t) for name, t in kind}


def _take(cols: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in cols.items()}


def _dealt(cols: dict[str, np.ndarray], kind: tuple, bucket: np.ndarray, what: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows in blobs, one for each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, z in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), what, _pack(_take(cols, order[a:z]), kind)


def _of_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _of_key(key: np.ndarray, n: int) -> np.ndarray:
    return ((_mix(key) >> np.uint64(8)) % np.uint64(n)).astype(np.int64)


def _firsts(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries sorted by minimizer, segment and place, repeated rows once; True for the earliest of equal segments."""
    e = _take(e, np.lexsort((e["at"], e["th"], e["doc"], e["s"], e["k"])))
    same = np.ones(max(0, len(e["k"]) - 1), bool)
    for c in ("k", "s"):
        same &= e[c][1:] == e[c][:-1]
    row = same.copy()
    for c in ("doc", "th", "at"):
        row &= e[c][1:] == e[c][:-1]
    keep = np.concatenate((np.ones(min(1, len(e["k"])), bool), ~row))
    first = np.concatenate((np.ones(min(1, len(e["k"])), bool), ~same))
    return _take(e, keep), first[keep]


def _ranges(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"doc": e["doc"], "th": e["th"], "at": e["at"], "end": e["at"] + e["n"] + (LENGTH - 1)}


def _find(batches, n: int) -> Iterator[tuple[int, int, bytes]]:
    """Documents -> segments (by minimizer) and the ranges of segments that the batch itself shows to be repeats."""
    import xxhash

    for ids, texts in batches:
        parts: list[tuple] = []
        for doc, text in zip(ids, texts, strict=True):
            found = segments(text)
            if len(found[0]):
                m = len(found[0])
                parts.append((*found, np.full(m, doc, np.int64), np.full(m, np.uint32(xxhash.xxh32_intdigest(text)).view(np.int32))))
        if not parts:
            continue
        k, s, at, count, o, doc, th = (np.concatenate([p[i] for p in parts]) for i in range(7))
        e, first = _firsts({"k": k, "s": s, "doc": doc, "th": th, "at": at, "n": count, "o": o})
        again = _ranges(_take(e, ~first))
        yield from _dealt(again, _RANGE, _of_doc(again["doc"], n), RANGES)
        e = _take(e, first)
        e = _take(e, np.lexsort((e["at"], e["doc"])))
        yield from _dealt(e, _ENTRY, _of_key(e["k"], n), SEGMENTS)


def _match(blobs: list[bytes], n: int) -> Iterator[tuple[int, int, bytes]]:
    """All segments of a bucket of minimizers -> ranges of repeats, and the segments whose bytes must be compared."""
    e, first = _firsts(_gather(blobs, _ENTRY))
    again = _ranges(_take(e, ~first))
    yield from _dealt(again, _RANGE, _of_doc(again["doc"], n), RANGES)
    e = _take(e, first)
    start = np.concatenate(([True], e["k"][1:] != e["k"][:-1]))
    group = np.cumsum(start) - 1
    size = np.bincount(group)[group]
    want = _take(e, size > 1) | {"cut": (size > CUT_ABOVE)[size > 1].astype(np.int8)}
    yield from _dealt(want, _WANT, _of_doc(want["doc"], n), WANTED)


def _texts(batches, n: int) -> Iterator[tuple[int, int, bytes]]:
    """Documents in blobs, by document."""
    import xxhash

    for ids, texts in batches:
        doc = np.array(ids, np.int64)
        bucket = _of_doc(doc, n)
        for b in np.unique(bucket):
            mine = np.flatnonzero(bucket == b)
            some = [texts[i] for i in mine]
            cols = {"doc": doc[mine], "th": np.array([xxhash.xxh32_intdigest(t) for t in some], np.uint32).view(np.int32), "size": np.array([len(t) for t in some], np.int64)}
            yield int(b), TEXTS, _pack(cols, _TEXTS, b"".join(some))


def _by_doc(cols: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """(doc, th) -> its rows."""
    if not len(cols["doc"]):
        return {}
    order = np.lexsort((cols["at"], cols["th"], cols["doc"]))
    doc, th = cols["doc"][order], cols["th"][order]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))))
    return {(int(doc[a]), int(th[a])): order[a:z] for a, z in zip(cut, np.append(cut[1:], len(order)), strict=True)}


def _each_text(blob: bytes) -> Iterator[tuple[int, int, memoryview]]:
    cols, raw = _unpack(blob, _TEXTS)
    at = 0
    for doc, th, size in zip(cols["doc"].tolist(), cols["th"].tolist(), cols["size"].tolist(), strict=True):
        yield doc, th, raw[at : at + size]
        at += size


def _cut(wanted: list[bytes], texts: Iterator[bytes], n: int) -> Iterator[tuple[int, int, bytes]]:
    """The wanted segments' bytes, by minimizer, or by stripe and what all its windows share."""
    import xxhash

    want = _gather(wanted, _WANT)
    of = _by_doc(want)
    rows: list[tuple[int, int, int, int, int, bytes]] = []
    size = 0

    def packed() -> Iterator[tuple[int, int, bytes]]:
        cols = {c: np.array([r[i] for r in rows], t) for i, (c, t) in enumerate(_PIECES)}
        bucket = _of_key(cols["k"], n)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, z in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            mine = order[a:z]
            yield int(bucket[mine[0]]), CUTS, _pack(_take(cols, mine), _PIECES, b"".join([rows[i][5] for i in mine]))

    for blob in texts:
        before = len(rows)
        for doc, th, text in _each_text(blob):
            for i in of.pop((doc, th), ()):
                k, at, count, o, cut = (int(want[c][i]) for c in ("k", "at", "n", "o", "cut"))
                if not cut:
                    rows.append((k, doc, th, at, count, bytes(text[at : at + count + LENGTH - 1])))
                    continue
                anchor = at + o
                for j in range((o - count + 1) // STRIPE, o // STRIPE + 1):  # windows with the minimizer STRIPE * j and more bytes in
                    a, z = max(at, anchor - STRIPE * j - STRIPE + 1), min(at + count - 1, anchor - STRIPE * j)
                    shared = text[anchor - STRIPE * j : anchor - STRIPE * j - STRIPE + 1 + LENGTH]
                    rows.append((xxhash.xxh64_intdigest(shared, j + 1), doc, th, a, z - a + 1, bytes(text[a : z + LENGTH])))
        size += sum(len(r[5]) for r in rows[before:])
        if size >= CUT_BYTES:  # few blobs, whatever the number of text blobs
            yield from packed()
            rows, size = [], 0
    if rows:
        yield from packed()


class BlindTrie:
    """A Patricia trie of equally long strings as integers: inner nodes hold a branching byte's place only; one comparison
    with the leaf that a blind descent reaches places a string."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def insert(self, s: int, item: int) -> None:
        raw = s.to_bytes(self.size)
        if self.root is None:
            self.root = [-1, s, [item]]
            return
        node, path = self.root, []
        while node[0] >= 0:
            path.append(node)
            node = node[1].get(raw[node[0]]) or next(iter(node[1].values()))
        differ = s ^ node[1]
        if not differ:
            node[2].append(item)
            return
        at = self.size - 1 - (differ.bit_length() - 1) // 8
        other = node[1].to_bytes(self.size)[at]
        parent = None
        for p in path:
            if p[0] >= at:
                break
            parent = p
        below = self.root if parent is None else parent[1][raw[parent[0]]]
        leaf = [-1, s, [item]]
        if below[0] == at:
            below[1][raw[at]] = leaf
            return
        new = [at, {other: below, raw[at]: leaf}, None]
        if parent is None:
            self.root = new
        else:
            parent[1][raw[parent[0]]] = new

    def classes(self) -> Iterator[list[int]]:
        """Items of equal strings, strings in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def sort_windows(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the LENGTH-byte windows at start, and, in that order, their class: equal windows share one."""
    n = len(start)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.concatenate((buf, np.zeros(8, np.uint8))).astype(np.uint64)
    word = padded[: len(buf)].copy()
    for i in range(1, 8):
        word = (word << np.uint64(8)) | padded[i : i + len(buf)]
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order whose group has several members
    for depth in range(0, SHALLOW, 8):  # multikey quicksort, all groups a level at a time, 8 bytes a key
        key = word[start[order[open_]] + depth]
        by = np.lexsort((key, group[open_]))
        order[open_], key = order[open_][by], key[by]
        g = group[open_]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        group[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        lone = new & np.append(new[1:], True)
        open_ = open_[~lone]
        if not len(open_):
            return order, group
    g = group[open_]
    lead = np.concatenate(([True], g[1:] != g[:-1]))
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    at = start[order[open_]]
    alike = np.ones(len(open_), bool)
    for depth in [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]:
        w = word[at + depth]
        alike &= w == w[head]
    bounds = np.append(np.flatnonzero(lead), len(open_))
    mixed = np.flatnonzero(np.add.reduceat(~alike, bounds[:-1]) > 0)
    raw = buf.tobytes()
    for k in mixed:  # blind tries for groups that share the shallow depth and then part
        places = open_[bounds[k] : bounds[k + 1]]
        members = order[places]
        trie = BlindTrie(LENGTH - SHALLOW)
        for m in members.tolist():
            a = int(start[m])
            trie.insert(int.from_bytes(raw[a + SHALLOW : a + LENGTH]), m)
        at_place = 0
        for items in trie.classes():
            order[places[at_place : at_place + len(items)]] = items
            group[places[at_place : at_place + len(items)]] = places[at_place]
            at_place += len(items)
    return order, group


def _sort(blobs: list[bytes], n: int) -> Iterator[tuple[int, int, bytes]]:
    """All cut segments of a bucket -> ranges of windows that an earlier window equals."""
    cols, raws = [], []
    for b in blobs:
        c, raw = _unpack(b, _PIECES)
        cols.append(c)
        raws.append(raw)
    e = {name: np.concatenate([c[name] for c in cols]) for name, _ in _PIECES}
    buf = np.frombuffer(b"".join(raws), np.uint8)
    count = e["n"].astype(np.int64)
    size = count + LENGTH - 1
    which = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    order, group = sort_windows(buf, (np.cumsum(size) - size)[which] + nth)
    which, nth = which[order], nth[order]
    doc, th, at = e["doc"][which], e["th"][which], e["at"][which] + nth
    several = np.concatenate(([False], group[1:] == group[:-1])) | np.concatenate((group[1:] == group[:-1], [False])) if len(group) else np.empty(0, bool)
    doc, th, at, group = doc[several], th[several], at[several], group[several]
    by = np.lexsort((at, th, doc, group))
    doc, th, at, group = doc[by], th[by], at[by], group[by]
    later = np.concatenate((np.zeros(min(1, len(group)), bool), group[1:] == group[:-1]))
    same = np.concatenate((np.zeros(min(1, len(group)), bool), (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (at[1:] == at[:-1])))
    keep = later & ~(same & ~np.concatenate(([False], later[:-1])) if len(later) else later)
    doc, th, at = doc[keep], th[keep], at[keep]
    by = np.lexsort((at, th, doc))
    doc, th, at = doc[by], th[by], at[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (at[1:] > at[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    out = {"doc": doc[first], "th": th[first], "at": at[first], "end": at[last] + LENGTH} if len(first) else {c: np.empty(0, t) for c, t in _RANGE}
    yield from _dealt(out, _RANGE, _of_doc(out["doc"], n), RANGES)


def _strip(ranges: list[bytes], texts: Iterator[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int]], bytes]]:
    """doc, n_bytes, removed spans and the bytes that stay."""
    all_ = _gather(ranges, _RANGE)
    of = _by_doc(all_)
    for blob in texts:
        for doc, th, text in _each_text(blob):
            spans: list[tuple[int, int]] = []
            rows = of.get((doc, th))
            if rows is not None:
                at, reach = all_["at"][rows], np.maximum.accumulate(all_["end"][rows])
                new = np.flatnonzero(np.concatenate(([True], at[1:] > reach[:-1])))
                spans = list(zip(at[new].tolist(), reach[np.append(new[1:], len(at)) - 1].tolist(), strict=True))
            kept, done = [], 0
            for a, z in spans:
                kept.append(text[done:a])
                done = z
            kept.append(text[done:])
            yield doc, len(text), spans, b"".join(kept)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    for batch in batches:
        yield [_NO_ID if i is None else i for i in batch.column(0).to_pylist()], [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]


def _blobs(rows: Iterator[tuple[int, int, bytes]], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r[2])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], out.field(i).type) for i in range(3)], schema=out)
            some, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], out.field(i).type) for i in range(3)], schema=out)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Each bucket with its (kind, blob) rows, which must be read before the next bucket."""
    from itertools import groupby

    rows = ((b, k, x) for batch in batches for b, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (y.as_py() for y in batch.column(2)), strict=True))
    for b, some in groupby(rows, key=lambda r: r[0]):
        yield b, ((k, x) for _, k, x in some)


def _led(rows: Iterator[tuple[int, bytes]]) -> tuple[list[bytes], Iterator[bytes]]:
    """Blobs before the texts, and the texts, read as they come."""
    led: list[bytes] = []
    for kind, blob in rows:
        if kind == TEXTS:
            return led, (b for part in ([blob], (x for _, x in rows)) for b in part)
        led.append(blob)
    return led, iter(())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed start, end; maximal runs), kept (binary) for every document; docs: doc_id, text.

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Strings never cross documents and are judged on the input. Defined cases: null text is empty; a null doc_id
    comes before all others; rows of one doc_id and different texts are ordered by a hash of the text; fully repeated rows are
    one document, returned once for each row; texts of any length are taken whole; further columns are not looked at; a doc_id
    must be, or read as, a 64-bit integer (others raise); an empty table gives an empty one. Whole segments are equal if their minimizers and their 64-bit hashes are.
    """
    spark = docs.sparkSession
    out = arrow_schema(spark, BLOB)
    width = partitions(spark)
    n = 4 * width
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def find(batches):
        return _blobs(_find(_documents(batches), n), out)

    def match(batches):
        def work():
            for b, rows in _buckets(batches):
                mine: list[bytes] = []
                for kind, blob in rows:
                    if kind == SEGMENTS:
                        mine.append(blob)
                    else:
                        yield b, kind, blob
                if mine:
                    yield from _match(mine, n)

        return _blobs(work(), out)

    def texts(batches):
        return _blobs(_texts(_documents(batches), n), out)

    def cut(batches):
        return _blobs((r for _, rows in _buckets(batches) for r in _cut(*_led(rows), n)), out)

    def sort(batches):
        return _blobs((r for _, rows in _buckets(batches) for r in _sort([x for _, x in rows], n)), out)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(width, "bucket").sortWithinPartitions("bucket", "kind")

    matched = spill(dealt(base.mapInArrow(find, BLOB)).mapInArrow(match, BLOB), "matched")
    packed = base.mapInArrow(texts, BLOB)
    cuts = dealt(matched.filter(F.col("kind") == WANTED).unionByName(packed)).mapInArrow(cut, BLOB)
    ranges = spill(dealt(cuts).mapInArrow(sort, BLOB), "ranges")

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    final = arrow_schema(spark, schema)

    def strip(batches):
        for _, rows in _buckets(batches):
            some: list[tuple] = []
            size = 0
            for r in _strip(*_led(rows)):
                some.append(r)
                size += r[1]
                if size > 8 << 20:
                    yield _stripped(some, final)
                    some, size = [], 0
            if some:
                yield _stripped(some, final)

    return dealt(matched.filter(F.col("kind") == RANGES).unionByName(ranges).unionByName(packed)).mapInArrow(strip, schema)


def _stripped(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    spans = [[{"start": a, "end": z} for a, z in r[2]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([None if r[0] == _NO_ID else r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, out.field(2).type), pa.array([r[3] for r in rows], pa.binary())], schema=out)

"""Byte-level BPE with DuckDB recursive queries, one in-process database per Python worker.

A batch is cut into pieces by the tokenizer's pattern. Pieces not seen before by the task go to DuckDB as token-position
rows (piece, position, token). A recursive query joins each row's pair with its successor to the merge table, contracts
every piece's leftmost pair of minimum rank and repeats until no pair merges; ordered aggregation then gives each piece's
ids and, from the vocabulary, its decoded bytes. That holds for all pieces; one that is a token as a whole is that token,
by a join. A document's ids and decoded bytes are its pieces' in order.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCH_BYTES, arrow_schema, lean

#: Pieces of a cache generation, about 300 bytes each; a task keeps two.
CACHE = 350_000
#: Pieces, and bytes of them, that go to one recursive query: bounds the database's memory. It has no folder to spill to.
AT_ONCE, BYTES_AT_ONCE, MEMORY = 20_000, 400_000, 200_000_000
#: Contractions that one recursive query makes in a piece, at most; a piece with more goes on in the next query.
ROUNDS = 64
#: Pieces of more bytes contract all pairs of the minimum rank in a round where that is the same; rows of all their rounds in a query.
LONG, LONG_ROWS = 512, 1_000_000

#: words: piece, bytes. Pieces that are tokens as they are.
WHOLE = "CREATE OR REPLACE TEMP TABLE whole AS SELECT piece, token FROM words JOIN vocabulary USING (bytes)"
#: start has a row for each byte: piece, place (a position that counts on from piece to piece, with a gap between them), token, width (in
#: bytes). A piece in which nothing merges comes out once more in state -1, and no further.
RECURSION = """
CREATE OR REPLACE TEMP TABLE reached AS
WITH RECURSIVE step(piece, place, token, width, state) AS (
    SELECT piece, place, token, width::{wide}, 0::SMALLINT FROM start ANTI JOIN whole USING (piece)
  UNION ALL
    (WITH best AS (
        SELECT a.piece, min((m.rank::{kind} << {r}) | (a.place::{kind} << {p}) | (a.width::{kind} << {w}) | b.width::{kind}) AS k
        FROM step a JOIN step b ON b.place = a.place + a.width JOIN merges m ON m.pair = a.token::BIGINT << 32 | b.token
        WHERE a.state >= 0 AND a.state < {rounds} GROUP BY a.piece
     ),
     found AS (SELECT piece, (k >> {r})::INTEGER AS rank, ((k >> {p}) & {pm}::{kind})::INTEGER AS place, ((k >> {w}) & {wm}::{kind})::{wide} AS own, (k & {wm}::{kind})::{wide} AS next FROM best)
     SELECT s.piece, s.place, CASE WHEN s.place = f.place THEN f.rank ELSE s.token END, CASE WHEN s.place = f.place THEN f.own + f.next ELSE s.width END::{wide}, CASE WHEN f.piece IS NULL THEN -1 ELSE s.state + 1 END::SMALLINT
     FROM step s LEFT JOIN found f USING (piece) WHERE s.state >= 0 AND s.state < {rounds} AND (f.piece IS NULL OR s.place <> f.place + f.own))
)
SELECT * FROM step WHERE state = -1 OR state = {rounds}
"""
#: The same for long pieces. Where all merges that a token takes part in rank behind it (safe), no pair that it makes comes before
#: its other occurrences, so a round contracts them all: of pairs in a row (a a a), every other one from the left.
LONG_RECURSION = """
CREATE OR REPLACE TEMP TABLE reached AS
WITH RECURSIVE step(piece, place, token, width, state) AS (
    SELECT piece, place, token, width::{wide}, 0::SMALLINT FROM start ANTI JOIN whole USING (piece)
  UNION ALL
    (WITH pairs AS (
        SELECT a.piece, a.place, a.width AS own, b.width AS next, m.rank, m.safe FROM step a JOIN step b ON b.place = a.place + a.width JOIN merges m ON m.pair = a.token::BIGINT << 32 | b.token
        WHERE a.state >= 0 AND a.state < {rounds}
     ),
     low AS (SELECT piece, min(rank) AS rank FROM pairs GROUP BY piece),
     hits AS (SELECT *, lag(place + own) OVER (PARTITION BY piece ORDER BY place) AS before FROM pairs JOIN low USING (piece, rank)),
     runs AS (SELECT *, max(CASE WHEN before IS DISTINCT FROM place THEN place END) OVER (PARTITION BY piece ORDER BY place) AS first, min(place) OVER (PARTITION BY piece) AS least FROM hits),
     found AS (SELECT * FROM runs WHERE CASE WHEN safe THEN (place - first) // own % 2 = 0 ELSE place = least END)
     SELECT s.piece, s.place, coalesce(f.rank, s.token), coalesce(f.own + f.next, s.width)::{wide}, CASE WHEN low.piece IS NULL THEN -1 ELSE s.state + 1 END::SMALLINT
     FROM step s LEFT JOIN low ON low.piece = s.piece LEFT JOIN found f ON f.place = s.place ANTI JOIN found g ON g.place + g.own = s.place WHERE s.state >= 0 AND s.state < {rounds})
)
SELECT * FROM step WHERE state = -1 OR state = {rounds}
"""
#: The decoded bytes of a piece are its list of bytes.
DECODE = """
SELECT piece, list(token ORDER BY place) AS ids, list(v.bytes ORDER BY place) AS decoded
FROM (SELECT piece, place, token FROM reached WHERE state = -1 UNION ALL SELECT piece, 0, token FROM whole) JOIN vocabulary v USING (token) GROUP BY piece
"""
UNDONE = "SELECT piece, place, token, width FROM reached WHERE state >= 0"


class Encoder:
    """Encodes pieces; holds the database with the merge table."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 31:
            raise ValueError("ranks must be below 2^31")
        #: rank, place and both widths in one number, whose least is the pair to contract
        narrow = max(ranks.values(), default=0) < 1 << 16 and max(map(len, ranks)) < 1 << 10
        kind, r, p, w, wide = ("UBIGINT", 48, 20, 10, "SMALLINT") if narrow else ("UHUGEINT", 96, 48, 24, "INTEGER")
        self.packed = {"kind": kind, "r": r, "p": p, "w": w, "pm": (1 << r - p) - 1, "wm": (1 << w) - 1, "wide": wide}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        unsafe = {x for a, b, r in merges for x in (a, b) if r < x}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": "", "preserve_insertion_order": False})
        table = pa.table({"pair": pa.array([a << 32 | b for a, b, _ in merges], pa.int64()), "rank": pa.array([r for _, _, r in merges], pa.int32()), "safe": pa.array([r not in unsafe for _, _, r in merges], pa.bool_())})
        words = pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())})
        for name, rows in (("merges", table), ("vocabulary", words)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def encode(self, pieces: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
        """Runs of pieces, in any order: their numbers in the list, their ids (4 bytes each), and the bytes that these decode to."""
        for long in (False, True):
            for some in self._runs(pieces, sorted((i for i, p in enumerate(pieces) if (len(p) > LONG) is long), key=lambda i: len(pieces[i]))):
                yield from self._some(pieces, some, long)

    @staticmethod
    def _runs(pieces: list[bytes], which) -> Iterator[list[int]]:
        some, n = [], 0
        for i in which:
            if some and (len(some) >= AT_ONCE or n + len(pieces[i]) > BYTES_AT_ONCE):
                yield some
                some, n = [], 0
            some.append(i)
            n += len(pieces[i])
        if some:
            yield some

    def _some(self, pieces: list[bytes], some: list[int], long: bool) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
        all_ = b"".join([pieces[k] for k in some])
        lengths = [len(pieces[k]) for k in some]
        rows = np.repeat(np.array(some, np.int32), lengths)
        todo = pa.table({"piece": rows, "place": np.arange(len(rows), dtype=np.int32) + np.repeat(np.arange(len(some), dtype=np.int32), lengths), "token": self.byte[np.frombuffer(all_, np.uint8)], "width": np.ones(len(rows), np.int32)})
        words = pa.table({"piece": np.array(some, np.int32), "bytes": pa.array([pieces[k] for k in some], pa.binary())})
        if len(rows) > BYTES_AT_ONCE:  # one piece of so many bytes
            self.db.execute(f"SET memory_limit = '{MEMORY + 500 * len(rows)}B'")
        while len(todo):
            rounds = max(1, min(ROUNDS, LONG_ROWS // len(todo)))
            self.db.register("start", todo)
            self.db.register("words", words)
            self.db.execute(WHOLE)
            self.db.execute((LONG_RECURSION if long else RECURSION).format(rounds=rounds, **self.packed))
            self.db.unregister("start")
            got = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            if len(got):
                ids, back = got.column("ids").chunk(0), got.column("decoded").chunk(0)
                at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4").tobytes()
                ends, data = np.frombuffer(back.values.buffers()[1], np.int32)[back.values.offset :], back.values.buffers()[2]
                data, at, cut = data.to_pybytes() if data else b"", (4 * at).tolist(), ends[back.offsets.to_numpy()].tolist()
                yield got.column("piece").to_pylist(), [flat[a:z] for a, z in zip(at, at[1:])], [data[a:z] for a, z in zip(cut, cut[1:])]
            todo, words = self.db.sql(UNDONE).to_arrow_table(), words.slice(0, 0)
        if len(rows) > BYTES_AT_ONCE:
            self.db.execute(f"SET memory_limit = '{MEMORY}B'")


def load_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_ENCODERS: dict[str, Encoder] = {}


class Numbers(dict):
    """piece -> number, given out when a piece is first looked up; coded and decoded: what is known of each number."""

    def __init__(self, older: Numbers | None = None):
        self.older, self.coded, self.decoded, self.todo, self.places = older, [], [], [], []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.coded)
        was = self.older.get(piece) if self.older is not None else None
        if was is None:
            self.todo.append(piece)
            self.places.append(n)
        self.coded.append(None if was is None else self.older.coded[was])
        self.decoded.append(None if was is None else self.older.decoded[was])
        return n


class Cache:
    """Pieces already encoded, in two generations: what is still in use moves on when the younger is full, the rest goes."""

    def __init__(self):
        self.known = Numbers()

    def renew(self) -> Numbers:
        """To be asked for before each run of texts."""
        if len(self.known) > CACHE:
            self.known.older = None
            self.known = Numbers(self.known)
        return self.known


def _encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = Encoder(load_ranks(f))
    return _ENCODERS[path]


def encode_texts(texts: list[str | None], split: Callable[[str], list[str]], encoder: Encoder, cache: Cache) -> list[tuple[bytes, bytes]]:
    """Ids (4 bytes each) and decoded bytes of each text; the texts' new pieces are encoded together."""
    known = cache.renew()
    number, coded, decoded = known.__getitem__, known.coded, known.decoded
    cut = [list(map(number, split(t))) if t else () for t in texts]
    todo, places = known.todo, known.places
    known.todo, known.places = [], []
    for which, ids, back in encoder.encode([p.encode("utf-8", "surrogatepass") for p in todo]):
        for i, x, y in zip(which, ids, back, strict=True):
            n = places[i]
            coded[n], decoded[n] = x, y
    return [(b"".join(map(coded.__getitem__, c)), b"".join(map(decoded.__getitem__, c))) for c in cut]


def chunks(texts: list[str | None], size: int = 4_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters: what is held at once stays small."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t or "")
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def tokenize(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary) for every document; docs: doc_id, text.

    ranks_path: a tiktoken rank file on every worker (a parameter; the file is never part of the library). Special tokens
    are ordinary text. Defined cases: null is the empty text, with no ids; repeated rows come back once each; pieces of any
    length are contracted in queries of ROUNDS rounds; ranks of 2^31 or more are refused; further columns are not looked at; an empty table gives an empty one.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary"
    out = arrow_schema(docs.sparkSession, schema, SMALL_BATCH_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = regex.compile(pattern).findall, Cache()  # a task's own: what follows in the worker gets its memory
        encoder = _encoder(ranks_path)
        for batch in batches:
            at = 0
            for some in chunks(batch.column(1).to_pylist()):
                rows = encode_texts(some, split, encoder, cache)
                ends = np.cumsum([0, *(len(r[0]) // 4 for r in rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([r[0] for r in rows]), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), ids.cast(out.field(1).type), pa.array([r[1] for r in rows], pa.binary())], schema=out)
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(lean(encode), schema)


def digests(tokenized: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one blank), decoded_sha256."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokenized.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

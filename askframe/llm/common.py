"""What the corpus operators share: spilling to the shared folder, free column names, folds, word splitting."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..deploy import ship
from ..shared import shared_dir, spill

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only; bytes.split() then splits on exactly [\x20\x09-\x0D].
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def quoted(name: str) -> Column:
    """A column by its name, whatever the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: remainder 1 is held out (null ids are never learned from and never held out)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII strings take Spark's fast lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x20\\x09-\\x0D]+ of a text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def each(column: pa.Array, some: int = 512) -> Iterator:
    """The values of an Arrow column as Python objects, a few at a time: a batch of long texts is never held twice."""
    for at in range(0, len(column), some):
        yield from column.slice(at, some).to_pylist()


#: Bytes of a batch that goes to Python, about; the JVM and the worker hold it several times over. Small ones are for the pipeline's operators,
#: whose executors come to it with memory that earlier stages left in use.
BATCH_BYTES, SMALL_BATCH_BYTES = 16 << 20, 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What the allocators of this process keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow; after a task its worker process, which is kept for later ones, gives back the memory it no longer needs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return task


def arrow_schema(spark: SparkSession, ddl: str, batch_bytes: int = BATCH_BYTES) -> pa.Schema:
    """The Arrow form of a DDL schema; whoever needs it runs Python on the executors, so the package is sent there and batches
    are bounded in bytes (in rows alone, ten thousand long texts would be one)."""
    ship(spark)
    now = spark.conf.get(_BATCH).rstrip("b")
    if not now.isdigit() or int(now) > batch_bytes:
        spark.conf.set(_BATCH, str(batch_bytes))
    return to_arrow_schema(T.StructType.fromDDL(ddl))


__all__ = ["ASCII_LOWER", "LOWER", "SMALL_BATCH_BYTES", "UPPER", "arrow_schema", "ascii_lower", "each", "fold", "fresh", "lean", "partitions", "quoted", "shared_dir", "spill", "words_of"]

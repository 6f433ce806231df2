"""Helpers shared by the corpus operators.

Two kinds: cutting lineage in the folder that the cluster shares, and numpy views of
Arrow string columns, so that Python operators work on bytes without making objects.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.sources.shared import BROADCAST_BYTES, new_path

U64 = np.uint64
WRAP = 1 << 64
#: Odd multiplier of the polynomial hashes; its inverse modulo 2**64 exists.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, WRAP)


#: Bytes of an Arrow batch that written() sends to a Python worker, about; long rows make small batches.
BATCH_BYTES = 16 << 20


@contextmanager
def bounded_batches(spark: SparkSession):
    """Bounds Arrow batches by bytes, too, while a table is written."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage is cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns this process's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """Wraps an Arrow function of a stage: when a task ends, its worker gives freed memory back to the system.

    Workers outlive their tasks, and the executor shares its memory with them.
    """

    @functools.wraps(run)
    def wrapper(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapper


def measured(table: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table written and measured: marked for broadcast if it is small, else left for a shuffled join."""
    table = written(table, name)
    size = table.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like written(), in buckets of a key, so that joins on the key need no exchange of this side.

    df must come dealt by repartition(buckets, key), so that each task writes one bucket. The table's entry in the
    catalog goes when the driver ends, as its files do.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = new_path(spark, table)
    with bounded_batches(spark):
        df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, key).saveAsTable(table)
    atexit.register(_forget, spark, table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    if spark.getActiveSession() is not None and spark.sparkContext._jsc is not None:
        with suppress(Exception):  # the session may be ending, too
            spark.sql(f"drop table if exists {table}")


def text_key(column: str = "text"):
    """Binary SHA-256 of a text; null counts as empty. Operators key distinct texts by it."""
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column, and the offsets of each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if not pa.types.is_large_string(column.type) else column.type)
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def spans_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of about limit bytes each; a longer value comes alone and whole."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes (splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        out = np.full(size, base & (WRAP - 1), U64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        _POWERS[base] = have
    return have[:n]


def range_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, for range_hashes."""
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=prefix[1:])
    return prefix


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte range [start, end)."""
    prefix = range_sums(data) if prefix is None else prefix
    h = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts]
    return mixed(h ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of texts: lower-cased bytes, word starts, word ends, word hashes, and each text's first word.

    Words are runs of ASCII letters, digits and bytes from 0x80; A-Z is lower-cased. Starts and
    ends count from offsets[0]. The last array has one entry more than there are texts.
    """
    low = _LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    inside = _WORD[low]
    before = np.zeros(len(low), bool)
    before[1:] = inside[:-1]
    edge = at[:-1][at[:-1] < len(low)]
    first = inside & ~before
    first[edge] = inside[edge]
    after = np.zeros(len(low), bool)
    after[:-1] = inside[1:]
    last = inside & ~after
    close = at[1:][at[1:] > 0] - 1
    last[close] = inside[close]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, range_hashes(low, starts, ends), np.searchsorted(starts, at)

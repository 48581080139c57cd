"""Shared pieces of the training-data operators.

Words everywhere are maximal runs of ``[^\\x20\\x09-\\x0D]``; that is exactly
what ``bytes.split()`` yields on UTF-8 text, and ``WORD`` is the same rule as a
regular expression. ``packed_*`` turn numpy arrays into Arrow binary cells, the
form in which the two-stage operators ship many small values per row.
"""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.session import written

WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; whole, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Written once below the shared checkpoint folder and read back.
persisted = written


def with_row_key(df: DataFrame, name: str, purpose: str) -> DataFrame:
    """``df`` with a column ``name``: a long of its own for every row. Written and
    read back, so every reader sees the same keys."""
    return persisted(df.withColumn(name, F.monotonically_increasing_id()), purpose)


HOT_PARTS = 1024


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` (one row per key), where one key may have a
    third of all rows. ``weight``: the column of ``table`` that says how many rows
    have the key, at most; ``total``: their sum. Keys with a HOT_PARTS-th of the
    total, of which there are HOT_PARTS at most, are broadcast, so their rows aren't
    shuffled; no key of the shuffled join has more than that share. ``table`` is
    read twice (a written one)."""
    hot = F.col(weight) * HOT_PARTS >= F.lit(total)
    tried = rows.join(F.broadcast(table.where(hot).withColumn("_hot", F.lit(True))), on, "left")
    rest = tried.where("_hot IS NULL").select(*rows.columns).join(table.where(~hot), on)
    return tried.where("_hot").drop("_hot").unionByName(rest)


def row_keyed(df: DataFrame, name: str, purpose: str) -> DataFrame:
    """``df`` with a column ``name`` that differs between any two rows and is the same
    whenever it is read: file and row number, where ``df`` is a table of Parquet
    files as read, else a long, for which ``df`` is written."""
    try:
        return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
    except AnalysisException:        # not a plain table of files
        return with_row_key(df, name, purpose)


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partition count: what the cluster's owner sized to
    the input. Numbers of buckets are derived from it, so a bucket's size stays
    the same as data and cluster grow together."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---- hashing words with numpy ------------------------------------------------

MASK64 = (1 << 64) - 1
_LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class PowerTable:
    """base^0.. and base^-0.. mod 2^64, grown on demand and kept per worker."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, math.ceil(math.log2(n)))
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_TABLES: dict[int, PowerTable] = {}


def _table_for(base: int) -> PowerTable:
    return _TABLES.setdefault(base, PowerTable(base))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash per word ``data[start:end]``: a polynomial in the bytes
    taken from prefix sums, then mixed. Depends on the word alone."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _table_for(_LANES[lane][0]).get(len(data) + 1)
    letters = mix(np.arange(256, dtype=np.uint64) * np.uint64(_LANES[lane][1]) + np.uint64(lane + 1))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(letters[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes."""
    n = len(words)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    up, down = _table_for(_LANES[lane][1]).get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n - size + 1])


# ---- Arrow helpers -----------------------------------------------------------

def text_bytes(column: pa.Array, i: int) -> bytes:
    """UTF-8 of row ``i`` of a string column (null: empty)."""
    value = column[i]
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def concat_binary(column, dtype) -> np.ndarray:
    """All cells of a binary column as one array of ``dtype``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs run meanwhile send ``rows`` rows at a time to Python, so that what a task
    holds is so many texts, not ten thousand. The session's own value comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_LIBC = ctypes.CDLL(None)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at the end the memory that Arrow and the C library keep for
    later is given back, for the worker lives on."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):        # glibc
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows``: what a task makes of one at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def split_by(values: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions) for each part number occurring in ``values``."""
    order = np.argsort(values, kind="stable")
    cuts = np.searchsorted(values[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p]:cuts[p + 1]]

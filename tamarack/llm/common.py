"""Things several of the training-data operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tamarack.session import delete, discard, shared_dir, stored, written  # noqa: F401


materialize = stored


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives freed memory back when its task ends: workers are reused by later stages."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


#: Of an Arrow batch that an executor sends to Python. Batches lie outside the JVM's heap, in buffers that double as they fill.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES in the actions that run inside; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_or_empty(text: str = "text") -> F.Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def training_row(doc_id: str = "doc_id") -> F.Column:
    """True for rows labels may be learnt from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def crc_bucket(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column, nulls as empty, without a copy where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int):
    """Runs [a, b) of rows of about `most` bytes each; a longer row is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a counter-based stream of 64-bit draws."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Draws in (0, 1) from 64-bit states."""
    return ((splitmix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))

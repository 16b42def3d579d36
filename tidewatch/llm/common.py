"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.shared import BROADCAST_ROWS, discard, measured, new_path, partitions, shared_dir, small_side, stored

__all__ = ["BROADCAST_ROWS", "NOT_WORD", "bounded_batches", "discard", "measured", "new_path", "partitions", "release", "shared_dir", "small_side", "stored", "tidy", "trim", "words"]

#: Words are maximal runs of letters and digits, in lower case.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


#: What operators keep in a Python worker between tasks; each frees it and says whether there was any.
CACHES: list[Callable[[], bool]] = []


def trim() -> None:
    """Gives back to the system what this worker's allocators hold but do not use; a worker keeps it through its idle minute otherwise."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release(keep: Callable[[], bool] | None = None) -> None:
    """Spark hands a worker from one stage to the next: frees what other operators have kept in it (all but `keep`), and what is left unused."""
    for free in CACHES:
        if free is not keep:
            free()
    gc.collect()
    trim()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInPandas and the like; when a task has ended, its memory goes back."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


#: Bytes of an Arrow batch. Spark's own 64 MB is held by the JVM and by the worker, in each several times over.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the bytes of an Arrow batch for the session, unless it has been set there. Results do not depend on it."""
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))

"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that a Python worker is handed at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in small batches, so that a worker's memory is
    bounded whatever the texts' length; only lowers what the session has set."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_held: dict[Hashable, object] = {}
_settled: list[bool] = []


def settle() -> None:
    """Once per process: let the C library return large freed blocks at once instead
    of keeping them for later."""
    if not _settled:
        _settled.append(True)
        try:
            libc = ctypes.CDLL(None)
            for option, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):  # mmap threshold, trim threshold, arenas
                libc.mallopt(option, value)
        except (AttributeError, OSError):  # not every C library has it
            pass


def held(key: Hashable, make: Callable[[], object]):
    """The tool of this key, kept for later tasks.  Workers serve one stage after the
    other, so only the latest tool is kept: memory is that of one stage."""
    settle()
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop the tool of an earlier stage and give freed memory back to the system:
    workers wait for later stages, and what they keep is missing there."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass

"""Bounds of what Python workers hold of Arrow data."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that one Arrow batch holds; the session's setting counts if it is lower.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold ``BATCH_BYTES`` at most, so that the memory of Python workers has a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name).rstrip("bB")
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give memory that is free in this process back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass

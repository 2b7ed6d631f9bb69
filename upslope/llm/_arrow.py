"""Arrow functions over partitions that keep the memory of Python workers bounded."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Largest batches that the executors exchange with Python workers.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Give memory that Arrow and the C library hold free back to the system; reused workers otherwise only grow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Batches], Batches], schema) -> DataFrame:
    """``df.mapInArrow`` with small batches; a worker releases its free memory when a task ends.

    The limits are settings of the session; lower ones that it already has stay.
    """
    conf = df.sparkSession.conf
    for key, most in BATCH_LIMITS.items():
        now = conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))

    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``rows`` rows and about ``limit`` bytes; a longer row stands alone."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > limit:
            n //= 2
        yield batch.slice(at, n)
        at += n

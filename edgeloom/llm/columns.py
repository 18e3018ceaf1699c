"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Rows of a few numbers each that a join may broadcast, some tens of MB.
BROADCAST_ROWS = 1_000_000


_RESIDENT: dict[str, Any] = {}


def resident(key: str, build: Callable[[], Any]) -> Any:
    """The model that a worker holds between tasks. It holds one: another takes its place."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        release()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Returns the memory that a finished task no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(doc_id: str = "doc_id") -> Column:
    """Remainder of the id's checksum; 0 marks held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, tidy: bool = True) -> Iterator[pa.Table]:
    """Cuts Arrow batches into tables of at most ``limit`` bytes of text, or one row.

    With ``tidy`` memory is released when the last has been handled.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > limit and i > start:
                yield pa.Table.from_batches([batch.slice(start, i - start)])
                start, total = i, 0
            total += int(size)
        yield pa.Table.from_batches([batch.slice(start)])
    if tidy:
        release()


def bounded_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table of narrow rows for a broadcast join if it is counted to be small.

    Beyond the bound the join shuffles; the result is the same.
    """
    return F.broadcast(table) if table.count() <= rows else table

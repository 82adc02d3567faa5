"""Arrow batches of whole texts, a slice at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of whole texts that are Python objects at a time. The batches they are cut from are bounded in bytes by Spark.
TEXT_ROWS = 500


def sliced(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of a task cut to at most ``rows`` rows each, so that few texts are Python objects at a time; empty ones go."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _give_back() -> None:
    """Return memory that was freed to the system: workers are used again, and each operator would add what it needed at most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, whose tasks give their memory back when they end."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(lean, schema)

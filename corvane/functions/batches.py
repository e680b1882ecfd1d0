"""Arrow batches in pieces, so that a worker's memory grows neither with its task nor with its batch."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows, and bytes of text, that are made into Python objects at once; a longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 1024, 1 << 20


#: Most bytes in one Arrow batch handed to a worker, in which it is held whole whatever the pieces.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES at most for what runs inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Give freed memory of this worker back to the system: an idle worker stays, and shares its executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices of at most PIECE_ROWS rows and PIECE_BYTES of the column ``text``, one row at least; trimmed at the end.  An empty batch is a piece."""
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes, dtype=np.int64), 0
            if not batch.num_rows:
                yield batch
            while at < batch.num_rows:
                room = PIECE_BYTES + (int(ends[at - 1]) if at else 0)
                stop = max(at + 1, min(at + PIECE_ROWS, int(np.searchsorted(ends, room, side="right"))))
                yield batch.slice(at, stop - at)
                at = stop
    finally:
        trim()

"""Arrow batches cut to slices of bounded size, so that what a task holds beside a batch follows neither its rows nor its longest text; and small inputs dealt to all cores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text and rows of a slice; a single longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512


def slices(batch: pa.RecordBatch, text_col: str | int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    stops, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        before = int(stops[at - 1]) if at else 0
        n = min(rows, max(1, int(np.searchsorted(stops, before + most, "right")) - at))
        yield batch.slice(at, n)
        at += n


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows as they are read, or dealt to all cores where a table has fewer files than the session has cores: a file may be a single row group, which one task reads.

    A larger table is never shuffled for this. With keys the deal is by their hash, the same in every pass over the same rows.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= 4 * n or len(rows.inputFiles()) >= n:
        return rows
    return rows.repartition(n, *keys)

"""Integer vectors that the vector operators share: exact components, and matrices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components within this keep every squared distance of up to 128 of them, and of every part, inside 64 bits.
MAX_COMPONENT = 1 << 27
#: Numbers of a matrix that a task works on at a time.
SLICE_NUMBERS = 1 << 21


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def scaled(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down. One above ``MAX_COMPONENT`` is an error: its distances fit no long."""

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) <= MAX_COMPONENT, y.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {MAX_COMPONENT}")).cast("int")
        )

    return F.transform(vector, whole)


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """Rows of a column of lists that all have ``width`` numbers."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def slices(batches: Iterator[pa.RecordBatch], numbers_per_row: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in batches that hold a bounded count of numbers."""
    step = max(1, SLICE_NUMBERS // max(1, numbers_per_row))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def lists(rows: np.ndarray) -> pa.Array:
    """A column of lists from the rows of a matrix."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

"""Finding a few rows of a large table again: a bit table of fixed size, then an exact join on what passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsentry.llm.common import batches, reduce_vectors

#: Bits of the table, whatever the input: the more of them are set, the more rows pass that the join then drops.
BITS, SLICES = 1 << 26, 64


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype("u8")) & np.uint64(BITS - 1)).astype("i8")


def wanted_rows(ids: DataFrame) -> np.ndarray:
    """The table with the bit of every long in ``ids`` (one column) set."""
    schema = pa.schema([("slice", pa.int32()), ("data", pa.binary())])

    def mark(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BITS // 8, "u1")
        for frame in frames:
            at = place(frame.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype("u1"))
        yield from batches(((i, p.tobytes()) for i, p in enumerate(table.reshape(SLICES, -1)) if p.any()), schema)

    data = reduce_vectors(ids.mapInArrow(mark, "slice int, data binary"), BITS // 8 // SLICES, "u1", "or", SLICES)
    return np.frombuffer(data, "u1")


def among(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be wanted; those that are not in the table are certainly not."""
    at = place(ids)
    return (table[at >> 3] >> (at & 7).astype("u1")) & 1 == 1

"""What the keyed stream operators share: rows in time order in bounded memory, and sliding windows over arrays.

The operators are stateful processors (``transformWithStateInPandas``): state variables and timers live in the RocksDB
state store, which sessions that run them must name as provider (``ROCKS``).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import pairwise, zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An end marker's time: so much after the last row. No row of data is that far ahead.
END_SHIFT_US = 100 * 365 * 86_400 * 1_000_000
END_MS = END_SHIFT_US // 1000


def with_event_time(df: DataFrame, delay: str, time_us: str = "ts_us") -> DataFrame:
    """Adds the event time ``ts`` and the watermark; rows later than that are dropped by Spark."""
    return df.withColumn("ts", F.timestamp_micros(time_us)).withWatermark("ts", delay)


def end_of_stream_us(watermark_ms: int, delay: str) -> int | None:
    """The time of the last row, to the millisecond, if the watermark has passed an end marker."""
    at = watermark_ms + int(pd.Timedelta(delay).total_seconds() * 1000)
    return (at - END_MS) * 1000 if at > END_MS + END_MS // 4 else None


class Pieces:
    """Packed rows with their first times, in memory or, beyond ``MEMORY`` bytes, in a file that ends with its task."""

    MEMORY = 64 << 20

    def __init__(self):
        self.file, self.places, self.end = tempfile.SpooledTemporaryFile(self.MEMORY), [], 0

    def add(self, first: int, data: bytes) -> None:
        self.places.append((first, self.end, len(data)))
        self.end += self.file.write(data)

    def by_time(self) -> Iterator[tuple[bytes, int | None]]:
        """Each piece and the first time of the next."""
        places = sorted(self.places)
        with self.file:
            for (_, at, size), after in zip_longest(places, places[1:]):
                self.file.seek(at)
                yield self.file.read(size), after and after[0]


class KeyedRows(StatefulProcessor):
    """A processor with one value ``kept`` (of ``STATE``) and rows of a key in the order of ``ORDER``, whose first column is a time.

    Spark hands a key's rows over in chunks, in no order. Up to ``HOLD`` rows are sorted as they are. More are sorted ``HOLD`` at a
    time and wait in a file of the task's own in pieces of ``SLICE`` rows, which come back by their first times. Each row is stored once;
    held are ``HOLD`` rows, or of each ``HOLD`` rows of the batch one piece.
    """

    ORDER: list[str] = []
    STATE = ""
    HOLD, SLICE = 100_000, 5_000

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.STATE)

    def in_order(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, pieces = 0, Pieces()

        def in_memory() -> pd.DataFrame:
            return pd.concat(held, ignore_index=True).sort_values(self.ORDER, kind="stable")

        def wait() -> None:
            table = pa.Table.from_pandas(in_memory(), preserve_index=False)
            for at in range(0, len(table), self.SLICE):
                pieces.add(table[self.ORDER[0]][at].as_py(), packed(table.slice(at, self.SLICE)))

        for frame in chunks:
            if held and size + len(frame) > self.HOLD:
                wait()
                held, size = [], 0
            held.append(frame)
            size += len(frame)
        if not pieces.places:
            if held:
                yield in_memory()
            return
        wait()
        held = []
        for table in self.merged(pieces):
            yield table.to_pandas()

    def merged(self, pieces: Pieces) -> Iterator[pa.Table]:
        """The rows of all pieces in order; a piece is in order itself."""
        opened: list[pa.Table] = []
        for data, upto in pieces.by_time():
            opened.append(unpacked(data))
            if upto is not None and sum(map(len, opened)) < self.HOLD // 4:
                continue
            # rows before the next piece's first time are complete
            ends = [len(t) if upto is None else int(np.searchsorted(t[self.ORDER[0]].to_numpy(), upto)) for t in opened]
            ready = pa.concat_tables([t.slice(0, n) for t, n in zip(opened, ends)], promote_options="permissive")
            opened = [t.slice(n) for t, n in zip(opened, ends) if n < len(t)]
            if len(ready):
                yield ready.sort_by([(c, "ascending") for c in self.ORDER])

    def close(self) -> None:
        pass


def in_pieces(rows: DataFrame, key: str, order: list[str], run: int = 200_000, piece: int = 250) -> DataFrame:
    """``key``, first time and rows of pieces: each task sorts ``run`` rows at a time and packs ``piece`` of a key together."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in (key, *order)]).combine_chunks()
            keys = table[key].to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            starts = [at for low, high in pairwise([*new.tolist(), len(keys)]) for at in range(low, high, piece)]
            for some in range(0, len(starts), 100):
                spans = list(pairwise([*starts, len(keys)]))[some : some + 100]
                first = table[order[0]].take([low for low, _ in spans]).cast(pa.int64(), safe=False)
                data = [packed(table.slice(low, high - low)) for low, high in spans]
                yield pa.RecordBatch.from_arrays([pa.array([keys[low] for low, _ in spans], pa.string()), first.combine_chunks(), pa.array(data)], names=[key, "first", "piece"])

        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= run:
                yield from cut(held)
                held, size = [], 0
        if size:
            yield from cut(held)

    return rows.mapInArrow(pack, f"{key} string, first bigint, piece binary")


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def to_bytes(frame: pd.DataFrame) -> bytes:
    return packed(pa.Table.from_pandas(frame, preserve_index=False))


def from_bytes(data: bytes) -> pd.DataFrame:
    return unpacked(data).to_pandas()


def sums_in_window(times: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """For each of the sorted rows: weight of the rows up to it, itself included, that are at most ``width`` older."""
    total = np.concatenate([[0], np.cumsum(weights)])
    return total[1:] - total[np.searchsorted(times, times - width, "left")]


def distinct_in_window(times: np.ndarray, labels: np.ndarray, width: int) -> np.ndarray:
    """For each of the sorted rows: different labels among the rows up to it that are at most ``width`` older.

    Rows in the window, less those whose label comes again in it: row k takes one away from its own place on, for as long as
    the row before it with its label is in the window too.
    """
    n = len(times)
    first = np.searchsorted(times, times - width, "left")
    by = np.lexsort((np.arange(n), labels))
    same = labels[by][1:] == labels[by][:-1]
    row, before = by[1:][same], by[:-1][same]
    out = np.searchsorted(first, before, "right")  # the first row whose window has lost ``before``
    again = np.zeros(n + 1, "i8")
    lasting = out > row
    np.add.at(again, row[lasting], 1)
    np.add.at(again, out[lasting], -1)
    return np.arange(n) + 1 - first - np.cumsum(again)[:n]

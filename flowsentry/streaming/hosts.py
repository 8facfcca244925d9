"""Process and file snapshots as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from flowsentry.operators.snapshots import normalize_processes, process_checks
from flowsentry.sources.files import check_files
from flowsentry.streaming.state import KeyedRows, from_bytes, to_bytes

_PROCESS = {
    "scan_no": "bigint", "host": "string", "pid": "bigint", "ppid": "bigint", "name": "string", "cmdline": "string",
    "parent_name": "string",
}


class Arrivals(KeyedRows):
    """Processes that a host's last known scan, whatever its number, did not have.

    The state is that scan's pids and what is known of the scan that is coming in. With ``end_rows`` a scan's rows wait in the state until
    its end row or a later scan comes, so parents are found however batches cut a scan; those of a scan that begins and ends within the rows at hand
    do not go through the state. Without, rows are judged as they come, by the part of their scan that is there.
    """

    ORDER = ["scan_no", "pid"]
    STATE = "scan_no bigint, before array<bigint>, pids array<bigint>, names array<string>, held int"

    def __init__(self, end_rows: bool):
        self.end_rows = end_rows

    def init(self, handle) -> None:
        super().init(handle)
        self.scan_rows = handle.getMapState("scan_rows", "piece int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        scan, before, names, held = None, None, {}, 0
        if self.kept.exists():
            scan, known, pids, texts, held = self.kept.get()
            before, names = (set(known) if known is not None else None), dict(zip(pids, texts))
        for frame in self.in_order(rows):
            numbers, known = frame["scan_no"].to_numpy("i8"), frame["pid"].notna().to_numpy()
            pids, parents, texts = np.where(known, frame["pid"], -1).astype("i8").tolist(), frame["ppid"].tolist(), frame["name"].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(frame)]
            found, found_parents = [], []
            for low, high in zip(cuts, cuts[1:]):
                number = int(numbers[low])
                if scan is not None and number < scan:
                    continue  # a scan that later ones have replaced
                if number != scan:
                    if held:
                        yield from self.judged(held, before, names)
                    before, scan, names, held = (None if scan is None else set(names)), number, {}, 0
                here = low + int(known[low:high].sum())  # end rows come last
                names.update(zip(pids[low:here], texts[low:here]))
                if self.end_rows and here == high == len(frame):  # the scan may go on in later rows
                    self.scan_rows.updateValue((held,), (to_bytes(frame.iloc[low:here].astype({"pid": "int64"})),))
                    held += 1
                    continue
                if held:
                    yield from self.judged(held, before, names)
                    held = 0
                if before is not None:
                    new = [i for i in range(low, here) if pids[i] not in before]
                    found += new
                    found_parents += [names.get(parents[i], "") for i in new]
            if found:
                yield frame.iloc[found].astype({"pid": "int64"}).assign(parent_name=found_parents)[list(_PROCESS)]
        self.kept.update((scan, None if before is None else [int(p) for p in before], [int(p) for p in names], list(names.values()), held))

    def judged(self, held: int, before: set | None, names: dict) -> Iterator[pd.DataFrame]:
        for piece in range(held):
            part = from_bytes(self.scan_rows.getValue((piece,))[0])
            self.scan_rows.removeKey((piece,))
            if before is not None:
                yield from fresh(part, before, names)


def fresh(part: pd.DataFrame, before: set, names: dict) -> Iterator[pd.DataFrame]:
    new = part[~part["pid"].isin(before)]
    if len(new):
        yield new.assign(parent_name=[names.get(p, "") for p in new["ppid"].tolist()])[list(_PROCESS)]


def stream_process_anomalies(snapshots: DataFrame, end_rows: bool = False) -> DataFrame:
    """Same findings as ``process_anomalies``; scans of a host come in the order of their numbers, which may have gaps.

    With ``end_rows`` a collector closes each scan by a row with a null pid, and a scan may be cut over any batches.
    """
    schema = ", ".join(f"{n} {t}" for n, t in _PROCESS.items())
    arrivals = normalize_processes(snapshots).groupBy("host").transformWithStateInPandas(Arrivals(end_rows), schema, "append", "None")
    return process_checks(arrivals)


def file_integrity_sink(table: str, on_events: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Batch sink: a micro-batch is one scan, stored under its batch id; changes go to ``on_events``.

    A batch that is repeated after a failure stores the same scan and hands over the same changes.
    """

    def write(scan: DataFrame, batch_id: int) -> None:
        on_events(check_files(scan, table, batch_id), batch_id)

    return write

"""The alert stream: limit, suppress, complete, hand to sinks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowsentry.functions.alerting import alert_fingerprint
from flowsentry.operators.alerts import alert_defaults
from flowsentry.sources.tables import fan_out
from flowsentry.streaming.state import KeyedRows, Pieces, in_pieces


class Admission(KeyedRows):
    """Accepted times and fingerprints of a tenant's last window, at most ``limit`` of each.

    The walk sees times and, of accepted rows, fingerprints; rows come sorted and packed (``in_pieces``), only accepted ones are unfolded.
    """

    STATE = "taken array<bigint>, prints array<string>, printed array<bigint>"

    def __init__(self, limit: int, rate_window: int, dedup_window: int, time: str, tie: str, columns: list[str]):
        self.limit, self.rate_window, self.dedup_window, self.columns = limit, rate_window, dedup_window, columns
        self.ORDER = [time, tie]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken, printed = deque(), {}
        if self.kept.exists():
            old, prints, times = self.kept.get()
            taken, printed = deque(old), dict(zip(prints, times))
        pieces = Pieces()
        for frame in rows:
            for first, data in zip(frame["first"].tolist(), frame["piece"]):
                pieces.add(first, data)
        for table in self.merged(pieces):
            keep, prints = [], table["print_of"]
            for i, now in enumerate(table[self.ORDER[0]].to_pylist()):
                while taken and now - taken[0] >= self.rate_window:
                    taken.popleft()
                if len(taken) < self.limit:
                    taken.append(now)
                    fingerprint = prints[i].as_py()
                    if fingerprint not in printed or now - printed[fingerprint] >= self.dedup_window:
                        printed[fingerprint] = now
                        keep.append(i)
            printed = {p: t for p, t in printed.items() if now - t < self.dedup_window}
            if keep:
                yield table.select(self.columns).take(keep).to_pandas()
        self.kept.update(([int(t) for t in taken], list(printed), [int(t) for t in printed.values()]))


def stream_admitted(
    alerts: DataFrame, limit: int = 100, window: int = 60, tenant: Column | None = None, time: str = "ts_s", tie: str = "id"
) -> DataFrame:
    """Same result as ``admit_alerts``.

    One state per tenant holds the accepted times and the fingerprints of the last
    window, at most ``limit`` of each.  Tenants (sensors) are handled in parallel.
    """
    keyed = alerts.withColumns({"tenant_of": (F.lit("all") if tenant is None else tenant).cast("string"), "print_of": alert_fingerprint()})
    schema: StructType = alerts.schema
    kept = in_pieces(keyed, "tenant_of", [time, tie]).groupBy("tenant_of").transformWithStateInPandas(
        Admission(limit, window, window, time, tie, alerts.columns), schema, "append", "None"
    )
    return alert_defaults(kept)


def start_alert_sinks(
    alerts: DataFrame,
    sinks: list[Callable[[DataFrame, int], None]] | dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str,
    failures: list | None = None,
    manifest: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Every admitted alert batch to every sink; with a ``manifest``, once to each (see ``fan_out``)."""
    writer = alerts.writeStream.foreachBatch(fan_out(sinks, failures, manifest)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""Flows from a packet stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowsentry.operators.flows import CLOSING_BITS, FLOW_KEY, flow_columns, sensor_of, with_flow_key
from flowsentry.streaming.state import KeyedRows, end_of_stream_us, with_event_time

_STATE = (
    "start_us bigint, end_us bigint, first_seq bigint, forward_low boolean, low_packets bigint, high_packets bigint, "
    "low_bytes bigint, high_bytes bigint, bits int"
)
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]
_OUT = "lo_ip string, lo_port int, hi_ip string, hi_port int, protocol int, " + _STATE + ", close_reason string"


class FlowAssembler(KeyedRows):
    """The open flow of a conversation; what closes it comes with the rows, with a timer, or with the end of the stream."""

    ORDER, STATE = ["ts_us", "seq"], _STATE

    def __init__(self, key: list[str], idle_us: int, max_packets: int, delay: str):
        self.key, self.idle_us, self.max_packets, self.delay = key, idle_us, max_packets, delay

    def closed(self, key: tuple, flows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f) for f in flows], columns=[*self.key, *_FIELDS, "close_reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] is None:  # an end marker: it only moves the watermark
            for _ in rows:
                pass
            return
        flow = list(self.kept.get()) if self.kept.exists() else None
        idle_us, cap = self.idle_us, self.max_packets
        for frame in self.in_order(rows):
            out: list[tuple] = []
            columns = (frame[c].tolist() for c in ("ts_us", "seq", "low_first", "length", "bits"))
            for ts, seq, low, length, bits in zip(*columns):
                if flow and ts - flow[1] > idle_us:
                    out.append((*flow, "idle"))
                    flow = None
                if flow is None:
                    flow = [ts, ts, seq, low, 0, 0, 0, 0, 0]
                side = 0 if low else 1
                flow[4 + side] += 1
                flow[6 + side] += length
                flow[8] |= bits
                flow[1] = max(flow[1], ts)
                if flow[8] & CLOSING_BITS:
                    out.append((*flow, "fin_rst"))
                    flow = None
                elif flow[4] + flow[5] >= cap:
                    out.append((*flow, "cap"))
                    flow = None
            if out:
                yield self.closed(key, out)
        if flow:
            self.kept.update(tuple(flow))
            self.handle.registerTimer(self.deadline(flow))
        elif self.kept.exists():
            self.kept.clear()

    def deadline(self, flow: list) -> int:
        return (flow[1] + self.idle_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.kept.exists():
            return
        flow, now = list(self.kept.get()), timerValues.getCurrentWatermarkInMs()
        if self.deadline(flow) > now:  # packets came after this timer was set
            return
        last = end_of_stream_us(now, self.delay)
        self.kept.clear()
        yield self.closed(key, [(*flow, "open" if last is not None and last - flow[1] <= self.idle_us else "idle")])


def stream_flows(packets: DataFrame, idle_seconds: int = 60, max_packets: int = 1000, delay: str = "30 seconds") -> DataFrame:
    """Same flows as ``build_flows``, each emitted when it closes.

    FIN/RST and the packet cap close at once; an idle flow closes when the watermark passes its last packet by
    ``idle_seconds``. A source that ends sends an end marker (see ``replay.replay``): then the flows that are still open
    come out as ``open``. A sensor column is part of the key.
    """
    key = [*sensor_of(packets), *FLOW_KEY]
    schema = "".join(f"{c} string, " for c in sensor_of(packets)) + _OUT
    keyed = with_event_time(with_flow_key(packets), delay)
    closed = keyed.groupBy(*key).transformWithStateInPandas(
        FlowAssembler(key, idle_seconds * 1_000_000, max_packets, delay), schema, "append", "EventTime"
    )
    return closed.select(*flow_columns(F.col("close_reason"), sensor_of(packets)))

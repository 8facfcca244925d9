"""Sliding-window detectors over flow and log streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowsentry.operators.flows import sensor_of
from flowsentry.operators.signatures import SECOND, best_matches
from flowsentry.streaming.state import KeyedRows, distinct_in_window, from_bytes, sums_in_window, to_bytes, with_event_time

_FLOW_FIELDS = {
    "flow_id": "bigint", "start_us": "bigint", "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int",
    "protocol": "int", "fwd_bytes": "bigint", "bwd_bytes": "bigint", "has_syn": "boolean", "flags": "string",
    "counts_syn": "boolean",
}


class Rates(KeyedRows):
    """Window counts of sources' flows in slices of time, many sources and slices (*pairs*) of a key at once.

    ``by`` names the columns that tell sources apart (none: a key is one source and, at its end, a slice). A pair gets the flows of its slice and, not
    to be counted out again, those of the last window before; so slices of one source need nothing of each other. The state
    holds, of what a pair's windows can still reach, the last time of each port and the times of SYN and ICMP flows.
    """

    ORDER = ["start_us", "flow_id"]
    STATE = "past binary"
    PORT, SYN, ICMP = range(3)

    def __init__(self, columns: list[str], scan_us: int, by: list[str] = (), span_us: int | None = None):
        self.columns, self.scan_us, self.pair = columns, scan_us, [*by, "slice"]
        self.reach = max(scan_us, SECOND)
        self.span_us = span_us or self.reach

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past, done = from_bytes(self.kept.get()[0]) if self.kept.exists() else None, []
        for frame in self.in_order(rows):
            if len(self.pair) > 1:
                frame = frame[frame[self.pair[-2]].notna()]  # an end marker has no source
            else:
                frame = frame.assign(slice=key[-1])
            if frame.empty:
                continue
            counts, past = self.counted(frame, past)
            own = frame["own"].to_numpy(bool)
            if own.any():
                yield frame.assign(**counts).loc[own, [*self.columns, *counts]]
            over = past["slice"] < frame["start_us"].iloc[-1] // self.span_us  # no later row of this batch is in these
            done.append(past[over])
            past = past[~over]
        if past is not None:
            self.keep(pd.concat([*done, past], ignore_index=True), timerValues)

    def counted(self, frame: pd.DataFrame, past: pd.DataFrame | None) -> tuple[dict[str, np.ndarray], pd.DataFrame]:
        """The three counts of each row, and what later rows need."""
        if past is None:
            past = frame[self.pair].iloc[:0].assign(kind=0, label=0, time=0, n=0)
        old, both = len(past), pd.concat([past[self.pair], frame[self.pair]], ignore_index=True)
        code = both.groupby(self.pair, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]
        kind, time = past["kind"].to_numpy(), np.concatenate([past["time"].to_numpy("i8"), frame["start_us"].to_numpy("i8")])
        # pairs one behind the other on one line, further apart than a window
        line = code * (self.span_us + 3 * self.reach) + time - both["slice"].to_numpy("i8") * self.span_us
        latest = np.full(len(first), np.iinfo("i8").min)
        np.maximum.at(latest, code, line)
        new = np.arange(old, len(both))
        counts, kept = {}, []
        known, port = past["label"].to_numpy("i8"), frame["dst_port"].to_numpy("i8")
        weight = {self.SYN: frame["counts_syn"].to_numpy(bool), self.ICMP: frame["protocol"].to_numpy() == 1}
        for name, what, width in (("n_syn", self.SYN, SECOND), ("n_icmp", self.ICMP, SECOND), ("n_ports", self.PORT, self.scan_us)):
            was = np.flatnonzero(kind == what)
            rows = np.concatenate([was, new])
            rows = rows[np.argsort(line[rows], kind="stable")]
            number = np.zeros(len(both), "i8")
            if what == self.PORT:
                label = np.concatenate([known, port])
                number[rows] = distinct_in_window(line[rows], label[rows], width)
                by = rows[np.lexsort((line[rows], label[rows], code[rows]))]
                last = np.append((code[by][1:] != code[by][:-1]) | (label[by][1:] != label[by][:-1]), True)
                left, n = by[last], 1
            else:
                label, weights = np.zeros(len(both), "i8"), np.concatenate([past["n"].to_numpy("i8"), weight[what].astype("i8")])
                number[rows] = sums_in_window(line[rows], weights[rows], width)
                counting = rows[weights[rows] > 0]
                left = counting[np.append(True, line[counting][1:] != line[counting][:-1])] if len(counting) else counting
                n = np.add.reduceat(weights[counting], np.searchsorted(line[counting], line[left])) if len(left) else 0
            counts[name] = number[new]
            near = line[left] >= latest[code[left]] - width
            needed = both.iloc[first[code[left]]].assign(kind=what, label=label[left], time=time[left], n=n)
            kept.append(needed[near])
        return counts, pd.concat(kept, ignore_index=True)

    def keep(self, past: pd.DataFrame, timerValues) -> None:
        """Stores what rows that are not late can need, until the last slice is over."""
        if timerValues is not None:
            past = past[(past["slice"] + 1) * self.span_us >= timerValues.getCurrentWatermarkInMs() * 1000]
        if past.empty:
            self.kept.clear()
            return
        self.kept.update((to_bytes(past),))
        self.handle.registerTimer((int(past["slice"].max()) + 1) * self.span_us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            past = from_bytes(self.kept.get()[0])
            if not ((past["slice"] + 1) * self.span_us >= timerValues.getCurrentWatermarkInMs() * 1000).any():
                self.kept.clear()
        return iter(())


def stream_signatures(
    flows: DataFrame, scan_seconds: int = 10, exclude_ack: bool = False, delay: str = "30 seconds", buckets: int = 128, **thresholds
) -> DataFrame:
    """Same matches as ``signature_matches``, each with its flow's batch.

    A source is cut into slices of time, four of the longest windows each, and a flow of a slice's last window goes to the next one too. Slices are dealt by
    hash over ``buckets``, so the flows of a flooding source spread over tasks, and the many slices with few flows share their calls to the state.
    """
    sensor = sensor_of(flows)
    syn = F.col("has_syn") & (~F.col("flags").contains("A") if exclude_ack else F.lit(True))
    columns = [*sensor, *_FLOW_FIELDS]
    rows = flows.withColumn("counts_syn", F.coalesce(syn, F.lit(False))).select(*columns)
    width = max(scan_seconds, 1) * SECOND
    span = 4 * width
    own_slice = F.floor(F.col("start_us") / span).cast("bigint")
    own, after = [F.struct((own_slice + i).alias("slice"), F.lit(i == 0).alias("own")) for i in (0, 1)]
    copies = F.inline(F.when(F.col("start_us") >= (own_slice + 1) * span - width, F.array(own, after)).otherwise(F.array(own)))
    schema = ", ".join([*[f"{c} string" for c in sensor], *[f"{n} {t}" for n, t in _FLOW_FIELDS.items()]])
    source = [*sensor, "src_ip"]
    rated = (
        with_event_time(rows, delay, "start_us").select("*", copies)
        .withColumn("bucket", F.pmod(F.xxhash64(*source, "slice"), F.lit(buckets)))
        .groupBy("bucket")
        .transformWithStateInPandas(Rates(columns, scan_seconds * SECOND, source, span), schema + ", n_syn bigint, n_icmp bigint, n_ports bigint", "append", "EventTime")
    )
    return best_matches(rated, scan_seconds=scan_seconds, **thresholds)


def stream_port_fanout(flows: DataFrame, ports: int = 20, delay: str = "30 seconds") -> DataFrame:
    """Cheap, approximate scan detector: distinct ports per source in 10 s windows sliding by 1 s."""
    fanout = (
        with_event_time(flows, delay, "start_us")
        .groupBy(F.window("ts", "10 seconds", "1 second"), *sensor_of(flows), "src_ip")
        .agg(F.approx_count_distinct("dst_port").alias("n_ports"))
    )
    return fanout.where(F.col("n_ports") >= ports).select(*sensor_of(flows), "src_ip", F.col("window.end").alias("at"), "n_ports")


_EVENT = (
    "line_no bigint, ts timestamp, event_type string, hostname string, user string, source_ip string, pid int, command string, "
    "description string, severity string, raw_line string, n_fails bigint"
)
_EVENT_COLUMNS = [c.split()[0] for c in _EVENT.split(", ")]


class Failures(KeyedRows):
    """Failed logins of an address in the window; the state holds the times that a window can still reach."""

    ORDER, STATE = ["ts_us", "line_no"], "times array<bigint>"

    def __init__(self, width: int):
        self.width = width

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.array(self.kept.get()[0], "i8") if self.kept.exists() else np.zeros(0, "i8")
        last = None
        for frame in self.in_order(rows):
            fails, now = frame["fails"].to_numpy(bool), frame["ts_us"].to_numpy("i8")
            every = np.concatenate([times, now])
            order = np.argsort(every, kind="stable")
            counts = np.empty(len(every), "i8")
            weights = np.concatenate([np.ones(len(times), "i8"), fails.astype("i8")])
            counts[order] = sums_in_window(every[order], weights[order], self.width)
            times = np.sort(every[(weights > 0) & (every >= every.max() - self.width)])
            last = int(every.max())
            yield frame.assign(n_fails=np.where(fails, counts[len(counts) - len(now) :], 0))[_EVENT_COLUMNS]
        self.kept.update((times.tolist(),))
        if last is not None:
            self.handle.registerTimer((last + self.width) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.kept.exists() and all(t + self.width < now * 1000 for t in self.kept.get()[0]):
            self.kept.clear()
        return iter(())


def stream_brute_force(events: DataFrame, failures: int = 5, seconds: int = 60, delay: str = "30 seconds") -> DataFrame:
    """Same result as ``auth_brute_force`` on failed logins; other events pass as they are, without a place in the state."""
    timed = events.withColumn("ts_us", F.unix_micros("ts")).withWatermark("ts", delay)
    fails = F.coalesce((F.col("event_type") == "AUTH_FAIL") & F.col("source_ip").isNotNull(), F.lit(False))
    counted = (
        timed.withColumns({"key": F.coalesce("source_ip", F.concat(F.lit("host "), "hostname")), "fails": fails})
        .groupBy("key")
        .transformWithStateInPandas(Failures(seconds * 1_000_000), _EVENT, "append", "EventTime")
    )
    over = F.col("n_fails") >= failures
    text = F.format_string(f"SSH brute force from %s: %d failures in {seconds}s", "source_ip", "n_fails")

    def marked(name: str, value: Column) -> Column:
        return F.when(over, value).otherwise(F.col(name))

    return counted.withColumns(
        {
            "event_type": marked("event_type", F.lit("BRUTE_FORCE")),
            "severity": marked("severity", F.lit("CRITICAL")),
            "description": marked("description", text),
        }
    ).drop("n_fails")


def traffic_rate(packets: DataFrame, window: str = "1 minute", delay: str = "30 seconds", by: list[str] = ()) -> DataFrame:
    """Packets, bytes and SYN packets per tumbling window (and sensor)."""
    syn = (F.col("protocol") == 6) & F.col("flags").contains("S")
    by = [*sensor_of(packets), *[c for c in by if c not in sensor_of(packets)]]
    return (
        with_event_time(packets, delay)
        .groupBy(F.window("ts", window), *by)
        .agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.count_if(syn).alias("syns"))
        .select(F.col("window.start").alias("start"), *by, "packets", "bytes", "syns")
    )

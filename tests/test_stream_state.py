import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from flowsentry.streaming.alerts import Admission
from flowsentry.streaming.detectors import Rates
from flowsentry.streaming.hosts import Arrivals
from flowsentry.streaming import state as stream_state
from flowsentry.streaming.state import KeyedRows, distinct_in_window, end_of_stream_us, from_bytes, packed, sums_in_window, to_bytes


@pytest.mark.parametrize("seed", range(8))
def test_windows_over_arrays_equal_walks(seed):
    r = random.Random(seed)
    n, width = r.randint(1, 80), r.choice([0, 1, 5, 30])
    times = sorted(r.randrange(60) for _ in range(n))
    labels, weights = [r.randrange(6) for _ in range(n)], [r.randrange(3) for _ in range(n)]
    inside = [[j for j in range(i + 1) if times[i] - times[j] <= width] for i in range(n)]
    t = np.array(times)
    assert sums_in_window(t, np.array(weights), width).tolist() == [sum(weights[j] for j in w) for w in inside]
    assert distinct_in_window(t, np.array(labels), width).tolist() == [len({labels[j] for j in w}) for w in inside]


class Fake:
    """State variables as dictionaries; counts the rows that are held at once."""

    def __init__(self):
        self.values, self.most = {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def updateValue(self, key, value):
        self.values[key] = value

    def getValue(self, key):
        return self.values[key]

    def removeKey(self, key):
        del self.values[key]


class Rows(KeyedRows):
    ORDER, STATE, HOLD, SLICE = ["t", "k"], "n int", 20, 10

    def handleInputRows(self, key, rows, timerValues):
        yield from self.in_order(rows)


def chunks(seed, n):
    r = np.random.default_rng(seed)
    frame = pd.DataFrame({"t": r.integers(0, 95, n), "k": np.arange(n), "s": [None if i % 3 else str(i) for i in range(n)]})
    return frame, [frame.iloc[i : i + 7] for i in range(0, n, 7)]


@pytest.mark.parametrize("n", [1, 7, 8, 100])
def test_rows_come_back_in_order_slice_by_slice(n):
    frame, parts = chunks(n, n)
    fake, rows = Fake(), Rows()
    rows.init(fake)
    got = list(rows.in_order(iter(parts)))
    whole = pd.concat(got, ignore_index=True)
    want = frame.sort_values(["t", "k"]).reset_index(drop=True)
    assert whole["t"].tolist() == want["t"].tolist() and whole["k"].tolist() == want["k"].tolist()
    assert [x if isinstance(x, str) else None for x in whole["s"]] == [x if isinstance(x, str) else None for x in want["s"]]
    assert not fake.values and (n <= 20 or len(got) > 2 and max(map(len, got)) < 60)


def test_bytes_and_end_of_stream():
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", None], "c": [True, False]})
    assert from_bytes(to_bytes(frame)).equals(frame)
    assert end_of_stream_us(1_700_000_000_000, "30 seconds") is None
    last = 1_700_000_000_123
    assert end_of_stream_us(last - 30_000 + 100 * 365 * 86_400 * 1000, "30 seconds") == last * 1000


@pytest.mark.parametrize("n", [700, 2800])
def test_waiting_rows_are_stored_in_pieces_that_do_not_shrink(monkeypatch, n):
    """Before, each chunk was cut by all slices, so pieces grew with the square of the rows."""
    sizes = []
    monkeypatch.setattr(stream_state, "packed", lambda t: sizes.append(len(t)) or packed(t))
    frame, parts = chunks(n, n)
    rows = Rows()
    rows.init(Fake())
    got = pd.concat(rows.in_order(iter(parts)), ignore_index=True)
    assert got["k"].tolist() == frame.sort_values(["t", "k"])["k"].tolist()
    assert sum(sizes) == n and len(sizes) <= n / 7


def test_packed_alerts_are_admitted_in_order_whatever_memory_holds(monkeypatch):
    r = random.Random(5)
    rows = [(r.randrange(300), k, f"p{r.randrange(8)}") for k in range(600)]
    taken, printed, want = [], {}, []
    for t, k, print_of in sorted(rows):
        if sum(t - x < 60 for x in taken) < 9:
            taken.append(t)
            if t - printed.get(print_of, -1000) >= 60:
                printed[print_of] = t
                want.append(k)
    for memory in (10, 1 << 20):
        monkeypatch.setattr(stream_state.Pieces, "MEMORY", memory)
        pieces = []
        for lane in range(3):  # as three tasks pack them
            part = sorted(rows[lane::3])
            for at in range(0, len(part), 7):
                t, k, print_of = zip(*part[at : at + 7])
                pieces.append((t[0], packed(pa.table({"t": t, "k": k, "print_of": print_of}))))
        r.shuffle(pieces)
        walk = Admission(9, 60, 60, "t", "k", ["t", "k"])
        walk.HOLD = 40
        walk.init(Handle())
        frame = pd.DataFrame(pieces, columns=["first", "piece"])
        got = pd.concat(walk.handleInputRows(("all",), iter([frame.iloc[:50], frame.iloc[50:]]), None))
        assert got["k"].tolist() == want


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value

    def clear(self):
        self.now = None


class Handle(Fake):
    def __init__(self):
        super().__init__()
        self.kept, self.timers = Value(), []

    def getValueState(self, *_):
        return self.kept

    def registerTimer(self, at):
        self.timers.append(at)


def walked(rows, scan_us):
    """Counts of each flow, from a walk that looks back over all of them."""
    out = {}
    for i, (t, flow, port, syn, proto) in enumerate(rows):
        near = [r for r in rows[: i + 1] if t - r[0] <= scan_us]
        second = [r for r in near if t - r[0] <= 1_000_000]
        out[flow] = (len({r[2] for r in near}), sum(r[3] for r in second), sum(r[4] == 1 for r in second))
    return out


@pytest.mark.parametrize("seed,hold", [(1, 100_000), (2, 40), (3, 10)])
def test_a_flooding_source_in_slices_equals_one_walk(seed, hold):
    """Flows of one source over three slices and two batches, in chunks; each slice has its own state, as in its own task."""
    r, scan = random.Random(seed), 3_000_000
    rows = sorted((r.randrange(9_000_000), k, r.randrange(12), r.random() < 0.4, r.choice([1, 6])) for k in range(260))
    want = walked(rows, scan)
    names = ["start_us", "flow_id", "dst_port", "counts_syn", "protocol"]
    got, slices = {}, {}
    for batch in (rows[:130], rows[130:]):
        groups: dict[int, list] = {}
        for row in batch:
            for step in (0, 1):
                groups.setdefault(row[0] // scan + step, []).append((*row, step == 0))
        for at, part in sorted(groups.items()):
            if at not in slices:
                slices[at] = Rates(names, scan)
                slices[at].HOLD, slices[at].SLICE = hold, max(1, hold // 2)
                slices[at].init(Handle())
            frame = pd.DataFrame(part, columns=[*names, "own"]).sample(frac=1, random_state=seed)
            chunks_of = [frame.iloc[i : i + 25] for i in range(0, len(frame), 25)]
            for out in slices[at].handleInputRows(("10.0.0.1", at), iter(chunks_of), None):
                got |= {x.flow_id: (x.n_ports, x.n_syn, x.n_icmp) for x in out.itertuples()}
            assert not slices[at].handle.values and slices[at].handle.timers
    assert got == want


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("seed,hold", [(1, 100_000), (2, 40)])
def test_many_sources_of_a_bucket_share_one_state(seed, hold):
    """Each source's counts are those of its own walk; one value is stored a batch, and it ends with its last slice."""
    r, scan, span = random.Random(seed), 3_000_000, 12_000_000
    names = ["start_us", "flow_id", "src_ip", "dst_port", "counts_syn", "protocol"]
    rows = sorted((r.randrange(40_000_000), k, f"10.0.0.{r.randrange(4)}", r.randrange(9), r.random() < 0.4, r.choice([1, 6])) for k in range(500))
    want = {}
    for source in {x[2] for x in rows}:
        want |= walked([(x[0], x[1], *x[3:]) for x in rows if x[2] == source], scan)
    rates, got, updates = Rates(names, scan, ["src_ip"], span), {}, 0
    rates.HOLD, rates.SLICE = hold, max(1, hold // 2)
    rates.init(Handle())
    for batch in (rows[:250], rows[250:]):
        part = [(*x, x[0] // span, True) for x in batch] + [(*x, x[0] // span + 1, False) for x in batch if x[0] >= (x[0] // span + 1) * span - scan]
        part.append((10**15, 10**6, None, 1, False, 6, 10**15 // span, True))  # an end marker
        frame = pd.DataFrame(part, columns=[*names, "slice", "own"]).sample(frac=1, random_state=seed)
        for out in rates.handleInputRows((7,), iter([frame.iloc[i : i + 25] for i in range(0, len(frame), 25)]), Now(batch[0][0] // 1000)):
            got |= {x.flow_id: (x.n_ports, x.n_syn, x.n_icmp) for x in out.itertuples()}
        updates += 1
        assert len(rates.handle.timers) == updates
    assert got == want
    assert from_bytes(rates.kept.get()[0])["slice"].min() >= rows[250][0] // span - 1
    list(rates.handleExpiredTimer((7,), Now(rates.handle.timers[0]), None))
    assert rates.kept.exists()
    list(rates.handleExpiredTimer((7,), Now(rates.handle.timers[-1] + 1), None))
    assert not rates.kept.exists()


class Kept(Fake):
    """A value and the pieces of a map; counts what is written to the map."""

    value, writes = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.writes += 1
        super().updateValue(key, value)


@pytest.mark.parametrize("cuts", [[120], [60, 60], [50, 1, 1, 68]])
def test_only_open_scans_go_through_the_state(cuts):
    rows = []
    for scan in range(0, 30, 2):  # seven processes and an end row a scan; one process is new in each
        rows += [(scan, "h", pid, 1, f"n{pid}", "c") for pid in [1, 2, 3, 4, 5, 6, 100 + scan]] + [(scan, "h", None, None, None, None)]
    frame = pd.DataFrame(rows, columns=["scan_no", "host", "pid", "ppid", "name", "cmdline"]).astype({"pid": "Int64"}).astype({"pid": "float"})
    state = Kept()
    arrivals, found, at = Arrivals(True), [], 0
    arrivals.init(state)
    for n in cuts:
        found += list(arrivals.handleInputRows(("h",), iter([frame.iloc[at : at + n]]), None))
        at += n
    got = pd.concat(found)
    assert got["pid"].tolist() == [100 + scan for scan in range(2, 30, 2)]
    assert set(got["parent_name"]) == {"n1"}
    assert state.writes == sum(sum(cuts[: i + 1]) % 8 != 0 for i in range(len(cuts))) and not state.values

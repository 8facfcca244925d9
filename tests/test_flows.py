import random

import pytest

from flowsentry.operators import flows as fl
from flowsentry.operators.features import flow_features, features_json
from flowsentry import dims
from tests import models

SCHEMA = "seq bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, length bigint, flags string"


def random_packets(n, seed, hot=0.34):
    """A third of the packets belong to one conversation; times repeat."""
    rng, ts, out = random.Random(seed), 0, []
    for i in range(n):
        ts += rng.choice([0, 0, 1000, 500_000, 70_000_000 if rng.random() < 0.05 else 10])
        a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80)
        if rng.random() > hot:
            a, b = (f"10.0.0.{rng.randint(1, 4)}", rng.randint(1, 3)), (f"10.0.0.{rng.randint(1, 4)}", rng.randint(1, 3))
        if rng.random() < 0.5:
            a, b = b, a
        out.append((i, ts, a[0], a[1], b[0], b[1], rng.choice([6, 17]), rng.randint(40, 1500), rng.choice(["", "S", "A", "A", "A", "A", "FA", "R"])))
    return out


def got(df):
    return sorted(
        (r.flow_id, (r.src_ip, r.src_port), (r.dst_ip, r.dst_port), r.fwd_packets, r.bwd_packets, r.total_bytes, r.start_us, r.end_us,
         r.close_reason if r.close_reason != "open" else None)
        for r in df.collect()
    )


def expected(packets, **kw):
    last = max(p[1] for p in packets)
    out = []
    for f in models.flows(packets, **kw):
        reason = f["reason"] or ("idle" if last - f["end"] > 60_000_000 else None)
        out.append((f["seq"], f["a"], f["b"], f["fwd"], f["bwd"], f["bytes"], f["start"], f["end"], reason))
    return sorted(out)


@pytest.mark.parametrize("chunks", [1, 2, 7])
@pytest.mark.parametrize("cap", [3, 1000])
def test_flows_equal_sequential_model(spark, chunks, cap):
    packets = random_packets(900, seed=cap + chunks)
    df = spark.createDataFrame(packets, SCHEMA)
    assert got(fl.build_flows(df, max_packets=cap, chunks=chunks)) == expected(packets, cap=cap)


@pytest.mark.parametrize("n,flows", [(999, 1), (1000, 1), (1001, 2)])
def test_packet_cap(spark, n, flows):
    packets = [(i, i * 1000, "a", 1, "b", 2, 17, 60, "") for i in range(n)]
    rows = fl.build_flows(spark.createDataFrame(packets, SCHEMA), chunks=3).orderBy("flow_id").collect()
    assert len(rows) == flows
    assert rows[0].close_reason == ("cap" if n >= 1000 else "open")


@pytest.mark.parametrize("gap,flows", [(60_000_000, 1), (60_000_001, 2)])
def test_idle_gap_boundary(spark, gap, flows):
    packets = [(0, 0, "a", 1, "b", 2, 17, 60, ""), (1, gap, "b", 2, "a", 1, 17, 60, "")]
    assert fl.build_flows(spark.createDataFrame(packets, SCHEMA)).count() == flows


def test_direction_flags_and_rates(spark):
    packets = [
        (0, 0, "z", 50000, "a", 443, 6, 100, "S"),
        (1, 500_000, "a", 443, "z", 50000, 6, 200, "SA"),
        (2, 1_000_000, "z", 50000, "a", 443, 6, 300, "FA"),
        (3, 1_000_001, "a", 443, "z", 50000, 6, 40, "A"),
    ]
    first, second = fl.build_flows(spark.createDataFrame(packets, SCHEMA)).orderBy("flow_id").collect()
    assert (first.src_ip, first.dst_port, first.fwd_packets, first.bwd_packets) == ("z", 443, 2, 1)
    assert (first.flags, first.has_syn, first.has_fin, first.has_rst) == ("AFS", True, True, False)
    assert first.duration_ms == 1000.0 and abs(first.byte_rate - 600) < 1e-3 and abs(first.pkt_rate - 3) < 1e-6
    assert (second.src_ip, second.duration_ms, second.close_reason) == ("a", 0.001, "open")


def test_talking_to_itself_is_forward(spark):
    packets = [(0, 0, "a", 1, "a", 1, 17, 60, ""), (1, 1, "a", 1, "a", 1, 17, 60, "")]
    (row,) = fl.build_flows(spark.createDataFrame(packets, SCHEMA)).collect()
    assert (row.fwd_packets, row.bwd_packets) == (2, 0)


def test_empty_input(spark):
    assert fl.build_flows(spark.createDataFrame([], SCHEMA)).count() == 0


FLOW = dict(
    flow_id=1, src_ip="192.168.1.1", dst_ip="10.0.0.1", src_port=12345, dst_port=80, protocol=6, duration_ms=100.0,
    total_packets=10, total_bytes=1500, fwd_packets=6, bwd_packets=4, fwd_bytes=900, bwd_bytes=600, pkt_rate=100.0,
    byte_rate=15000.0, has_syn=True, has_fin=True, has_rst=False,
)
FLOW_SCHEMA = (
    "flow_id bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, duration_ms double, total_packets bigint, "
    "total_bytes bigint, fwd_packets bigint, bwd_packets bigint, fwd_bytes bigint, bwd_bytes bigint, pkt_rate double, byte_rate double, "
    "has_syn boolean, has_fin boolean, has_rst boolean"
)


def features(spark, **kw):
    row = tuple((FLOW | kw).values())
    return flow_features(spark.createDataFrame([row], FLOW_SCHEMA)).first()


def test_feature_order_and_type(spark):
    df = flow_features(spark.createDataFrame([tuple(FLOW.values())], FLOW_SCHEMA))
    assert df.columns[1:] == dims.FEATURES and len(dims.FEATURES) == 24
    assert {t for _, t in df.dtypes[1:]} == {"float"}


def test_features_of_an_empty_flow(spark):
    row = features(spark, **{k: None for k in FLOW if k != "flow_id"})
    assert all(v is not None and v == v and abs(v) != float("inf") for v in row)
    assert row.total_packets == 1.0 and row.duration_ms == pytest.approx(0.001)


@pytest.mark.parametrize(
    "change,name",
    [({}, "is_tcp"), ({"protocol": 17, "dst_port": 53}, "is_udp"), ({"dst_port": 443}, "dst_port_well_known"),
     ({"dst_port": 55000}, "dst_port_ephemeral"), ({"dst_port": 1024}, "dst_port_registered"), ({"dst_port": 0}, "dst_port_well_known"),
     ({"dst_port": 49152}, "dst_port_ephemeral"), ({"src_port": 1023}, "src_port_privileged")],
)
def test_feature_flags(spark, change, name):
    assert features(spark, **change)[name] == 1.0


def test_feature_json(spark):
    made = features_json(flow_features(spark.createDataFrame([tuple(FLOW.values())], FLOW_SCHEMA)))
    assert '"fwd_bwd_ratio":1.5' in made.first().raw_features

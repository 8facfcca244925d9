import random

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import signatures as sg
from tests import models

SCHEMA = (
    "flow_id bigint, start_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, fwd_bytes bigint, "
    "bwd_bytes bigint, has_syn boolean, flags string"
)
T0 = 1_700_000_000_000_000


def flow(i, t=0, src="10.0.0.99", dst="192.168.1.1", sport=60000, dport=80, proto=6, fwd=60, bwd=0, syn=False, flags=""):
    return (i, T0 + t, src, dst, sport, dport, proto, fwd, bwd, syn, flags)


def matches(spark, flows, **kw):
    rows = sg.signature_matches(spark.createDataFrame(flows, SCHEMA), **kw).orderBy("flow_id").collect()
    return {r.flow_id: r for r in rows}


def test_port_scan_at_one_instant(spark):
    found = matches(spark, [flow(i, dport=i) for i in range(1, 25)])
    assert found[24].rule_name == "PORT_SCAN" and found[24].severity == "HIGH"
    assert found[24].description == "10.0.0.99 scanned 24 unique ports in 10s"
    assert min(i for i, r in found.items() if r.rule_name == "PORT_SCAN") == 20


@pytest.mark.parametrize("gap,hit", [(10_000_000, True), (10_000_001, False)])
def test_port_scan_window_is_inclusive(spark, gap, hit):
    flows = [flow(i, dport=100 + i) for i in range(19)] + [flow(50, t=gap, dport=500)]
    assert (50 in matches(spark, flows)) is hit


def test_syn_flood(spark):
    flows = [flow(i, t=i * 5000, syn=True) for i in range(110)]
    found = matches(spark, flows)
    assert (found[109].rule_name, found[109].severity) == ("SYN_FLOOD", "CRITICAL")
    assert min(found) == 99


@pytest.mark.parametrize("gap,hit", [(1_000_000, True), (1_000_001, False)])
def test_syn_window_is_inclusive(spark, gap, hit):
    flows = [flow(i, syn=True) for i in range(99)] + [flow(200, t=gap, syn=True)]
    assert (200 in matches(spark, flows)) is hit


def test_ack_exclusion_is_optional(spark):
    flows = [flow(i, syn=True, flags="AS") for i in range(100)]
    assert 99 in matches(spark, flows)
    assert 99 not in matches(spark, flows, exclude_ack=True)


def test_icmp_flood_zeroes_ports(spark):
    found = matches(spark, [flow(i, proto=1, dport=7) for i in range(200)])
    assert (found[199].rule_name, found[199].src_port, found[199].dst_port) == ("ICMP_FLOOD", 0, 0)
    assert len(found) == 1


@pytest.mark.parametrize(
    "change,rule",
    [({"dport": 4444}, "KNOWN_MALICIOUS_PORT"), ({"dport": 3389}, "SENSITIVE_PORT_ACCESS"), ({"dport": 22}, "SENSITIVE_PORT_ACCESS"),
     ({"dport": 443}, None), ({"proto": 17, "sport": 53, "dport": 0, "fwd": 50, "bwd": 5000}, "DNS_AMPLIFICATION"),
     ({"proto": 17, "sport": 53, "fwd": 400, "bwd": 4001}, "DNS_AMPLIFICATION"), ({"proto": 17, "sport": 53, "fwd": 50, "bwd": 4000}, None),
     ({"proto": 17, "sport": 53, "fwd": 0, "bwd": 4001}, "DNS_AMPLIFICATION")],
)
def test_stateless_rules(spark, change, rule):
    found = matches(spark, [flow(1, **change)])
    assert (found[1].rule_name if 1 in found else None) == rule


def test_more_rules_come_last(spark):
    extra = (("TELNET", "MEDIUM", "Initial Access", "T1021"), F.col("dst_port") == 23, F.lit("telnet"))
    other = (("ODD", "LOW", "x", "y"), F.col("dst_port") == 7, F.lit("odd"))
    found = matches(spark, [flow(1, dport=23), flow(2, dport=7)], more_rules=[extra, other])
    assert found[1].rule_name == "SENSITIVE_PORT_ACCESS" and found[2].rule_name == "ODD"


@pytest.mark.parametrize("chunks", [1, 3, 8])
def test_rates_equal_sequential_model(spark, chunks):
    rng, t, flows = random.Random(chunks), 0, []
    for i in range(700):
        t += rng.choice([0, 0, 10_000, 200_000, 3_000_000, 10_000_000 if rng.random() < 0.1 else 5])
        src = "hot" if rng.random() < 0.4 else f"s{rng.randint(1, 3)}"
        flows.append(flow(i, t, src=src, dport=rng.randint(1, 12), proto=rng.choice([1, 6]), syn=rng.random() < 0.6))
    rated = {r.flow_id: r for r in sg.flow_rates(spark.createDataFrame(flows, SCHEMA), chunks=chunks).collect()}
    assert len(rated) == len(flows)
    ports = models.distinct_ports([(f[2], f[1], f[0], f[5]) for f in flows], 10_000_000)
    syns = models.sliding([(f[2], f[1], f[0]) for f in flows if f[9]], 1_000_000)
    icmp = models.sliding([(f[2], f[1], f[0]) for f in flows if f[6] == 1], 1_000_000)
    assert {i: r.n_ports for i, r in rated.items()} == ports
    assert {i: r.n_syn for i, r in rated.items() if r.counts_syn} == syns
    assert {i: r.n_icmp for i, r in rated.items() if r.protocol == 1} == icmp

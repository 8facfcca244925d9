"""Flow signatures: stateless rules, sliding-window detectors, and the choice among them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowsentry import dims
from flowsentry.functions.alerting import severity_rank
from flowsentry.functions.net import once
from flowsentry.operators.flows import sensor_of
from flowsentry.plans.ordered import sliding_counts
from flowsentry.plans.storage import materialize

SECOND = 1_000_000
MATCH_COLUMNS = [
    "flow_id", "start_us", "rule_name", "severity", "description", "mitre_tactic", "mitre_technique",
    "src_ip", "dst_ip", "src_port", "dst_port",
]
_FLOW_COLUMNS = [
    "flow_id", "start_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "fwd_bytes", "bwd_bytes",
    "has_syn", "flags",
]


# ---- rule predicates: the extension point is a list of (name, condition, description) ----

def malicious_port() -> tuple[str, Column, Column]:
    port = F.col("dst_port")
    return (
        "KNOWN_MALICIOUS_PORT",
        port.isin(*dims.FLOW_BAD_PORTS),
        F.concat(F.lit("Connection to known malicious/C2 port "), port.cast("string")),
    )


def sensitive_port() -> tuple[str, Column, Column]:
    port = F.col("dst_port")
    return (
        "SENSITIVE_PORT_ACCESS",
        port.isin(*dims.FLOW_SENSITIVE_PORTS),
        F.concat(F.lit("Access to sensitive service port "), port.cast("string")),
    )


def dns_amplification(min_bytes: int = 4000, min_ratio: int = 10) -> tuple[str, Column, Column]:
    sent, got = F.col("fwd_bytes"), F.col("bwd_bytes")
    return (
        "DNS_AMPLIFICATION",
        (F.col("protocol") == 17)
        & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
        & (got > min_bytes)
        & (got / F.greatest(sent, F.lit(1)) > min_ratio),
        F.format_string("Possible DNS amplification: %dB req → %dB resp", sent.cast("long"), got.cast("long")),
    )


def port_scan(ports: int = 20, seconds: int = 10) -> tuple[str, Column, Column]:
    return (
        "PORT_SCAN",
        F.col("n_ports") >= ports,
        F.format_string(f"%s scanned %d unique ports in {seconds}s", F.col("src_ip"), F.col("n_ports")),
    )


def syn_flood(syns: int = 100) -> tuple[str, Column, Column]:
    return (
        "SYN_FLOOD",
        F.col("counts_syn") & (F.col("n_syn") >= syns),
        F.format_string("SYN flood from %s: %d SYNs/sec", F.col("src_ip"), F.col("n_syn")),
    )


def icmp_flood(flows: int = 200) -> tuple[str, Column, Column]:
    return (
        "ICMP_FLOOD",
        (F.col("protocol") == 1) & (F.col("n_icmp") >= flows),
        F.format_string("ICMP flood from %s: %d packets/sec", F.col("src_ip"), F.col("n_icmp")),
    )


def _matches(flows: DataFrame, rule: tuple[str, Column, Column]) -> DataFrame:
    name, condition, description = rule
    severity, tactic, technique = next(s[1:] for s in dims.SIGNATURES if s[0] == name)
    zero_ports = name == "ICMP_FLOOD"
    return flows.where(condition).select(
        *sensor_of(flows),
        "flow_id",
        "start_us",
        F.lit(name).alias("rule_name"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
        F.lit(tactic).alias("mitre_tactic"),
        F.lit(technique).alias("mitre_technique"),
        "src_ip",
        "dst_ip",
        (F.lit(0) if zero_ports else F.col("src_port")).alias("src_port"),
        (F.lit(0) if zero_ports else F.col("dst_port")).alias("dst_port"),
    )


# ---- window state -------------------------------------------------------------------------

def source_of(flows: DataFrame) -> list[str]:
    """Windows are kept per source, and per sensor if there are several."""
    return [*sensor_of(flows), "src_ip"]


def _port_changes(flows: DataFrame, seconds: int) -> DataFrame:
    """When a source's port enters (+1) and leaves (-1) its sliding window.

    Contacts with one port are first combined per window-long slice (inside a slice the
    port never leaves the window), so a port that one source hits all day costs one row
    per slice, whatever the traffic.
    """
    width, keys = seconds * SECOND, source_of(flows)
    # First flow of a slice by (time, id), as one number so that the aggregate stays hashed.
    span = F.lit(Decimal(10**19))  # above any 64-bit id
    place, first = F.col("start_us").cast("decimal(19,0)") * span + F.col("flow_id"), F.col("first")
    slices = (
        flows.groupBy(*keys, "dst_port", F.floor(F.col("start_us") / width).alias("slice"))
        .agg(F.min(place.cast("decimal(38,0)")).alias("first"), F.max("start_us").alias("last_us"))
        .withColumns(
            {
                "first_us": ((first - first % span) / span).cast("long"),
                "first_id": (first % span).cast("long"),
            }
        )
    )
    near = W.partitionBy(*keys, "dst_port").orderBy("slice")
    gaps = slices.select(
        "*",
        (F.col("first_us") - F.lag("last_us").over(near)).alias("since"),
        (F.lead("first_us").over(near) - F.col("last_us")).alias("until"),
    )

    def change(gap: str, at: Column, phase: int, amount: int) -> Column:
        made = F.struct(at.alias("start_us"), F.lit(phase).alias("_phase"), F.lit(amount).cast("long").alias("n_ports"))
        return F.when((F.col(gap) > width) | F.col(gap).isNull(), made)

    enters, leaves = change("since", F.col("first_us"), 0, 1), change("until", F.col("last_us") + width, 2, -1)
    changes = gaps.select(*keys, F.col("first_id").alias("flow_id"), F.inline(F.array(enters, leaves)))
    return changes.where("n_ports is not null")


def flow_rates(
    flows: DataFrame,
    scan_seconds: int = 10,
    exclude_ack: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Per flow: distinct ports, SYN flows and ICMP flows of its source in the sliding windows.

    Flows count in (start_us, flow_id) order; a flow sees itself and earlier ones.
    One sort by source serves all three detectors.
    """
    syn = F.col("has_syn") & (~F.col("flags").contains("A") if exclude_ack else F.lit(True))
    rows = materialize(flows.select(*sensor_of(flows), *_FLOW_COLUMNS).withColumn("counts_syn", F.coalesce(syn, F.lit(False))))
    return sliding_counts(
        rows,
        source_of(rows),
        "start_us",
        "flow_id",
        {"n_syn": (F.col("counts_syn"), SECOND), "n_icmp": (F.col("protocol") == 1, SECOND)},
        extra=_port_changes(rows, scan_seconds),
        extra_counts=["n_ports"],
        chunks=chunks,
    )


# ---- operators ------------------------------------------------------------------------------

def sig_malicious_port(flows: DataFrame) -> DataFrame:
    return _matches(flows, malicious_port())


def sig_sensitive_port(flows: DataFrame) -> DataFrame:
    return _matches(flows, sensitive_port())


def sig_dns_amplification(flows: DataFrame, min_bytes: int = 4000, min_ratio: int = 10) -> DataFrame:
    return _matches(flows, dns_amplification(min_bytes, min_ratio))


def _one_rate(flows: DataFrame, condition: Column, name: str, chunks: int | None) -> DataFrame:
    """Sliding one-second count over only the flows that count."""
    rows = flows.select(*sensor_of(flows), *_FLOW_COLUMNS).withColumn("counts_syn", F.lit(True)).where(condition)
    return sliding_counts(rows, source_of(rows), "start_us", "flow_id", {name: (F.lit(True), SECOND)}, chunks=chunks)


def sig_port_scan(flows: DataFrame, ports: int = 20, seconds: int = 10, chunks: int | None = None) -> DataFrame:
    rows = materialize(flows.select(*sensor_of(flows), *_FLOW_COLUMNS))
    seen = sliding_counts(
        rows, source_of(rows), "start_us", "flow_id", {}, _port_changes(rows, seconds), ["n_ports"], chunks
    )
    return _matches(seen, port_scan(ports, seconds))


def sig_syn_flood(flows: DataFrame, syns: int = 100, exclude_ack: bool = False, chunks: int | None = None) -> DataFrame:
    counted = F.col("has_syn") & (~F.col("flags").contains("A") if exclude_ack else F.lit(True))
    return _matches(_one_rate(flows, counted, "n_syn", chunks), syn_flood(syns))


def sig_icmp_flood(flows: DataFrame, threshold: int = 200, chunks: int | None = None) -> DataFrame:
    return _matches(_one_rate(flows, F.col("protocol") == 1, "n_icmp", chunks), icmp_flood(threshold))


def signature_matches(
    flows: DataFrame, scan_seconds: int = 10, exclude_ack: bool = False, chunks: int | None = None, **thresholds
) -> DataFrame:
    """The strongest matching rule per flow; equal severities go to the earlier rule."""
    return best_matches(flow_rates(flows, scan_seconds, exclude_ack, chunks), scan_seconds=scan_seconds, **thresholds)


def best_matches(
    rated: DataFrame,
    ports: int = 20,
    scan_seconds: int = 10,
    syns: int = 100,
    icmp: int = 200,
    more_rules: list[tuple[tuple[str, str, str, str], Column, Column]] = (),
) -> DataFrame:
    """Rules over flows that carry their window counts (see ``flow_rates``).

    ``more_rules``: further ((name, severity, tactic, technique), condition, description),
    tried after the built-in ones.
    """
    made = {
        r[0]: r[1:]
        for r in (
            malicious_port(), port_scan(ports, scan_seconds), syn_flood(syns), icmp_flood(icmp),
            dns_amplification(), sensitive_port(),
        )
    }
    rules = [(s, *made[s[0]]) for s in dims.SIGNATURES] + list(more_rules)
    candidates = [
        F.when(
            condition,
            F.struct(
                severity_rank(F.lit(severity)).alias("rank"),
                F.lit(-order).alias("order"),
                F.lit(name).alias("rule_name"),
                F.lit(severity).alias("severity"),
                description.alias("description"),
                F.lit(tactic).alias("mitre_tactic"),
                F.lit(technique).alias("mitre_technique"),
            ),
        )
        for order, ((name, severity, tactic, technique), condition, description) in enumerate(rules)
    ]
    best = rated.select(
        *sensor_of(rated), "flow_id", "start_us", "src_ip", "dst_ip", "src_port", "dst_port", once(F.array_max(F.array(*candidates)))
    ).where("rule_name is not null")
    zero = F.col("rule_name") == "ICMP_FLOOD"
    return best.select(
        *sensor_of(rated),
        "flow_id",
        "start_us",
        "rule_name", "severity", "description", "mitre_tactic", "mitre_technique",
        "src_ip",
        "dst_ip",
        F.when(zero, 0).otherwise(F.col("src_port")).alias("src_port"),
        F.when(zero, 0).otherwise(F.col("dst_port")).alias("dst_port"),
    )


def signature_to_alert(matches: DataFrame) -> DataFrame:
    """Signature match -> alert row; the protocol text is always "TCP"."""
    return matches.select(
        *sensor_of(matches),
        F.col("flow_id").alias("source_id"),
        F.col("start_us").alias("ts_us"),
        F.lit("NETWORK").alias("alert_type"),
        "severity",
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        F.lit("TCP").alias("protocol"),
        "description",
        "mitre_tactic",
        "mitre_technique",
        F.lit(1.0).alias("confidence"),
        F.lit(0).alias("model_votes"),
        F.lit("{}").alias("raw_features"),
    )

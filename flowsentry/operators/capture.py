"""Capture profile: packet rules, scans and floods over a whole capture, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowsentry import dims
from flowsentry.functions.alerting import severity_of_rank, severity_rank
from flowsentry.functions.net import lookup, port_label, protocol_name
from flowsentry.operators.flows import sensor_of
from flowsentry.plans.storage import materialize


def classify_packets(packets: DataFrame, dns_bytes: int = 2000) -> DataFrame:
    """Per-packet hits: watched bad port, watched sensitive port, oversized DNS; first one wins."""
    port, proto = F.col("dst_port"), F.col("protocol")
    bad, soft = port.isin(*dims.CAPTURE_BAD_PORTS), port.isin(*dims.CAPTURE_SENSITIVE_PORTS)
    dns = (proto == 17) & ((port == 53) | (F.col("src_port") == 53)) & (F.col("length") > dns_bytes)
    number = port.cast("string")
    bad_name, soft_name = lookup(port, dims.CAPTURE_BAD_PORTS), lookup(port, dims.CAPTURE_SENSITIVE_PORTS)

    def by_rule(on_bad, on_soft, on_dns) -> Column:
        return F.when(bad, on_bad).when(soft, on_soft).otherwise(on_dns)

    return packets.where(bad | soft | dns).select(
        *sensor_of(packets),
        "ts_us",
        "seq",
        "src_ip",
        "dst_ip",
        "dst_port",
        by_rule("MALICIOUS_PORT", "SENSITIVE_ACCESS", "DNS_AMPLIFICATION").alias("rule"),
        by_rule("CRITICAL", "HIGH", "HIGH").alias("severity"),
        by_rule("T1071", "T1190", "T1498.002").alias("technique"),
        by_rule(
            F.concat(F.lit("C2 port "), number, F.lit(" — "), bad_name),
            F.concat(soft_name, F.lit(" access attempt (port "), number, F.lit(")")),
            F.concat(F.lit("DNS amplification — "), F.col("length").cast("string"), F.lit("B response")),
        ).alias("description"),
        protocol_name(proto).alias("protocol"),
    )


# ---- Fixed values: hits of a source as a whole (rule, severity, technique, port, text) ----
SCAN = ("PORT_SCAN", "HIGH", "T1046", 0, "Port scan — %d unique ports probed")
FLOOD = ("SYN_FLOOD", "CRITICAL", "T1499", 80, "SYN flood — %d SYN packets")


def source_hits(packets: DataFrame, ports: int | None = 20, syns: int | None = 80) -> DataFrame:
    """Port scans (more than ``ports`` distinct ports) and SYN floods (more than ``syns`` SYN packets).

    One pass: packets are combined per source and port, then per source.  None leaves a rule out.
    """
    syn = (F.col("protocol") == 6) & F.col("flags").contains("S")
    sensor = sensor_of(packets)
    by_port = packets.groupBy(*sensor, "src_ip", "dst_port").agg(F.count_if(syn).alias("syns"))
    counts = by_port.groupBy(*sensor, "src_ip").agg(F.count("dst_port").alias("ports"), F.sum("syns").alias("syns"))

    def hit(kind: tuple, n: Column, more_than: int) -> Column:
        rule, severity, technique, port, text = kind
        made = F.struct(
            F.lit(port).alias("dst_port"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
            F.lit(technique).alias("technique"), F.format_string(text, n).alias("description"),
        )
        return F.when(n > more_than, made)

    wanted = [(SCAN, F.col("ports"), ports), (FLOOD, F.col("syns"), syns)]
    rows = counts.select(*sensor, "src_ip", F.inline(F.array(*[hit(*w) for w in wanted if w[2] is not None])))
    return rows.where("rule is not null").select(
        *sensor, F.lit(None).cast("bigint").alias("ts_us"), F.lit(None).cast("bigint").alias("seq"), "src_ip",
        F.lit(None).cast("string").alias("dst_ip"), "dst_port", "rule", "severity", "technique", "description",
        F.lit("TCP").alias("protocol"),
    )


def capture_port_scan(packets: DataFrame, more_than: int = 20) -> DataFrame:
    """Sources that touched more than ``more_than`` ports in the whole capture."""
    return source_hits(packets, more_than, None)


def capture_syn_flood(packets: DataFrame, more_than: int = 80) -> DataFrame:
    """Sources with more than ``more_than`` packets that carry SYN (SYN-ACK included)."""
    return source_hits(packets, None, more_than)


def all_hits(packets: DataFrame) -> DataFrame:
    return classify_packets(packets).unionByName(source_hits(packets))


def attacker_profiles(hits: DataFrame, shown_targets: int = 4) -> DataFrame:
    """Per source: hits, top severity, rules, ports, techniques, targets, first description.

    Rules, techniques and ports come from fixed or 16-bit domains, so their sets are
    bounded.  Targets are not: they are counted, and the first ``shown_targets`` listed;
    ``attacker_targets`` has them all as rows.
    """
    source = [*sensor_of(hits), "src_ip"]
    stage = lookup(F.col("rule"), {"PORT_SCAN": 1, "SYN_FLOOD": 2}, 0)
    order = F.struct(stage.alias("stage"), F.col("ts_us"), F.col("seq"), F.col("description"))
    main = hits.groupBy(*source).agg(
        F.count("*").alias("hits"),
        severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.array_join(F.sort_array(F.collect_set("rule")), " · ").alias("rules"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_set(F.when(F.col("dst_port") > 0, F.col("dst_port")))), lambda p: p.cast("string")
            ),
            ", ",
        ).alias("ports"),
        F.array_join(F.sort_array(F.collect_set("technique")), " · ").alias("techniques"),
        F.min(order)["description"].alias("description"),
    )
    by_target = W.partitionBy(*source).orderBy("dst_ip")
    targets = attacker_targets(hits)
    counted = targets.groupBy(*source).agg(F.count("*").alias("n_targets"))
    listed = (
        targets.withColumn("nth", F.row_number().over(by_target))
        .where(F.col("nth") <= shown_targets)
        .groupBy(*source)
        .agg(F.array_join(F.sort_array(F.collect_list("dst_ip")), ", ").alias("targets"))
    )
    return (
        main.join(counted, source, "left")
        .join(listed, source, "left")
        .withColumns({"n_targets": F.coalesce("n_targets", F.lit(0)), "targets": F.coalesce("targets", F.lit(""))})
    )


def attacker_targets(hits: DataFrame) -> DataFrame:
    """All (source, target) pairs with their hit count."""
    return hits.where("dst_ip is not null").groupBy(*sensor_of(hits), "src_ip", "dst_ip").agg(F.count("*").alias("hits"))


def rank_attackers(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(severity_rank(F.col("severity")).desc(), F.col("hits").desc(), "src_ip")


def protocol_counts(packets: DataFrame) -> DataFrame:
    other = F.concat(F.lit("Proto "), F.col("protocol").cast("string"))
    return packets.groupBy("protocol").agg(F.count("*").alias("packets")).select(
        "protocol", protocol_name(F.col("protocol"), other).alias("name"), "packets"
    )


def packet_timeline(packets: DataFrame, pattern: str = "yyyy-MM-dd HH:mm") -> DataFrame:
    """Packets per minute; the pattern "HH:mm" merges days."""
    minute = F.floor(F.col("ts_us") / 60_000_000).cast("bigint")
    counts = packets.groupBy(minute.alias("m")).agg(F.count("*").alias("n"))
    label = F.date_format(F.timestamp_seconds(F.col("m") * 60), pattern).alias("minute")
    return counts.groupBy(label).agg(F.sum("n").alias("packets"))


def capture_kpis(packets: DataFrame, dns_bytes: int = 2000, ports: int = 20, syns: int = 80) -> DataFrame:
    """One row (per sensor): packets, flows, hits, attackers, distinct endpoints, duration.

    The packets are read once, into one row per directed 5-tuple: every rule but the size of DNS
    packets depends on the tuple alone, and scans and floods are counts over a source's tuples.
    """
    syn = (F.col("protocol") == 6) & F.col("flags").contains("S")
    large, sensor = F.col("length") > dns_bytes, sensor_of(packets)
    by_flow = materialize(
        packets.groupBy(*sensor, "src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(
            F.count("*").alias("pkts"), F.count_if(syn).alias("syns"), F.count_if(large).alias("large"),
            F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        )
    )
    traffic = by_flow.groupBy(*sensor).agg(
        F.sum("pkts").alias("packets"),
        F.count("*").alias("flows"),
        F.countDistinct("src_ip").alias("sources"),
        F.countDistinct("dst_ip").alias("destinations"),
        ((F.max("end_us") - F.min("start_us")) / 1_000_000).alias("duration_s"),
    )
    port = F.col("dst_port")
    watched = port.isin(*dims.CAPTURE_BAD_PORTS) | port.isin(*dims.CAPTURE_SENSITIVE_PORTS)
    dns = (F.col("protocol") == 17) & ((port == 53) | (F.col("src_port") == 53))
    direct = F.sum(F.when(watched, F.col("pkts")).when(dns, F.col("large")).otherwise(0))
    by_port = by_flow.groupBy(*sensor, "src_ip", "dst_port").agg(direct.alias("direct"), F.sum("syns").alias("syns"))
    found = by_port.groupBy(*sensor, "src_ip").agg(
        (F.sum("direct") + (F.count("*") > ports).cast("int") + (F.sum("syns") > syns).cast("int")).alias("n")
    )
    threats = found.groupBy(*sensor).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count_if(F.col("n") > 0).alias("attackers"))
    both = traffic.unionByName(threats, allowMissingColumns=True)
    return both.groupBy(*sensor).agg(*[F.max(c).alias(c) for c in both.columns if c not in sensor])


def hit_breakdown(hits: DataFrame) -> DataFrame:
    """Hits per severity and per rule, in one pass."""
    sets = hits.groupingSets([["severity"], ["rule"]], "severity", "rule").agg(F.count("*").alias("hits"))
    return sets.select(
        F.when(F.col("severity").isNotNull(), "severity").otherwise("rule").alias("kind"),
        F.translate(F.coalesce("severity", "rule"), "_", " ").alias("name"),
        "hits",
    )


def top_ports(packets: DataFrame, k: int = 10) -> DataFrame:
    """Most used destination ports with their service label."""
    counts = packets.where("dst_port > 0").groupBy("dst_port").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "dst_port").limit(k).withColumn("label", port_label(F.col("dst_port")))


def packet_preview(packets: DataFrame, rows: int = 200) -> DataFrame:
    shown = packets.orderBy("seq").limit(rows)
    return shown.withColumn("proto_name", protocol_name(F.col("protocol"), F.lit("Other")))

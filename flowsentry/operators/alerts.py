"""Alerts: building, enriching, joining, shaping for feeds and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsentry import dims
from flowsentry.functions.alerting import severity_at_least, severity_rank
from flowsentry.functions.net import lookup
from flowsentry.operators.throttle import dedup_alerts, rate_limit_alerts
from flowsentry.plans.ordered import ordered

ALERT_COLUMNS = [
    "source_id", "ts_us", "alert_type", "severity", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "description", "mitre_tactic", "mitre_technique", "confidence", "model_votes", "raw_features",
]


def mitre_enrich(
    events: DataFrame,
    event_type: str = "event_type",
    tactics: dict[str, str] = dims.HOST_TACTICS,
    techniques: dict[str, str] = dims.HOST_TECHNIQUES,
) -> DataFrame:
    """Tactic and technique of event types; "Unknown" where there is none.

    ``dims.MITRE_TACTICS`` and ``dims.MITRE_TECHNIQUES`` hold the wider reference table.
    """
    kind = F.col(event_type)
    return events.withColumns(
        {"mitre_tactic": lookup(kind, tactics, "Unknown"), "mitre_technique": lookup(kind, techniques, "Unknown")}
    )


def host_event_to_alert(events: DataFrame) -> DataFrame:
    """Host event (source_id, ts_us, event_type, source_ip, severity, description) -> alert."""
    return mitre_enrich(events).select(
        "source_id",
        "ts_us",
        F.lit("HOST").alias("alert_type"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("source_ip", F.lit("localhost")).alias("src_ip"),
        F.lit("localhost").alias("dst_ip"),
        F.lit(0).alias("src_port"),
        F.lit(0).alias("dst_port"),
        F.lit("").alias("protocol"),
        "description",
        "mitre_tactic",
        "mitre_technique",
        F.lit(0.9).alias("confidence"),
        F.lit(0).alias("model_votes"),
        F.lit("{}").alias("raw_features"),
    )


def all_alerts(*parts: DataFrame) -> DataFrame:
    """Network and host alerts as one table."""
    out = parts[0].select(*ALERT_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*ALERT_COLUMNS))
    return out


def alert_defaults(alerts: DataFrame, now: Column | None = None) -> DataFrame:
    """Fills time, severity, type and the notified flag."""
    have = alerts.columns
    notified = F.coalesce("notified", F.lit(0)) if "notified" in have else F.lit(0)
    filled = {
        "severity": F.coalesce("severity", F.lit("LOW")),
        "alert_type": F.coalesce("alert_type", F.lit("UNKNOWN")),
        "notified": notified,
    }
    if now is not None and "ts_us" in have:
        filled["ts_us"] = F.coalesce("ts_us", now)
    return alerts.withColumns(filled)


def admit_alerts(
    alerts: DataFrame, limit: int = 100, window: int = 60, tenant: Column | None = None, time: str = "ts_s", tie: str = "id"
) -> DataFrame:
    """Rate limit, then duplicate suppression, then defaults.

    The limit runs first, so duplicates use up slots; after it at most ``limit`` rows
    per tenant and window are left for the second step.
    """
    kept = rate_limit_alerts(alerts, limit, window, tenant, time, tie)
    return alert_defaults(dedup_alerts(kept, time, tie, window))


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """``acks`` is an append-only table of alert ids; ids may repeat."""
    marked = acks.select("id").distinct().withColumn("_ack", F.lit(1))
    return (
        alerts.join(marked, "id", "left").withColumn("acknowledged", F.coalesce("_ack", F.lit(0))).drop("_ack")
    )


def correlate_net_host(
    network: DataFrame, host: DataFrame, seconds: int = 300, time: str = "ts_s", chunks: int | None = None
) -> DataFrame:
    """Per network alert: host events of the same address within +- ``seconds``.

    Two probes per alert read the running event count at both ends of its window, so
    no (alert, event) pairs are formed, however busy an address is.
    """
    named = F.col("src_ip").isNotNull() & (F.col("src_ip") != "")
    events = host.where(named).select(
        "src_ip", F.col(time).alias("t"), F.lit(1).alias("phase"), F.col("id"), F.lit(1).alias("n")
    )
    probes = network.where(named).select(
        "src_ip",
        F.inline(
            F.array(
                F.struct((F.col(time) - seconds).alias("t"), F.lit(0).alias("phase")),
                F.struct((F.col(time) + seconds).alias("t"), F.lit(2).alias("phase")),
            )
        ),
        F.col("id"),
        F.lit(0).alias("n"),
    )
    cut = ordered(events.unionByName(probes.select(*events.columns)), ["src_ip"], ["t", "phase", "id"], chunks)
    seen = cut.running({"upto": "n"}).where("phase <> 1")
    signed = F.when(F.col("phase") == 2, F.col("upto")).otherwise(-F.col("upto"))
    return seen.groupBy("id", "src_ip").agg(F.sum(signed).alias("host_events")).where("host_events > 0")


def suppress_allowlisted(alerts: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Drops alerts whose source is in ``allowlist`` (src_ip)."""
    return alerts.join(allowlist.select("src_ip").distinct(), "src_ip", "left_anti")


def _dash(column: str, mark: str = dims.NO_VALUE) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(mark))


def alert_feed(
    alerts: DataFrame,
    severities: list[str] | None = None,
    alert_type: str | None = None,
    ip_contains: str | None = None,
    sort: str = "time",
    limit: int | None = None,
    description_chars: int = 70,
) -> DataFrame:
    """Feed rows: filtered by severity set, type and address text, newest or worst first."""
    rows = alerts
    if severities is not None:
        rows = rows.where(F.col("severity").isin(*severities))
    if alert_type is not None:
        rows = rows.where(F.col("alert_type") == alert_type)
    if ip_contains:
        hit = F.col("src_ip").contains(ip_contains) | F.col("dst_ip").contains(ip_contains)
        rows = rows.where(F.coalesce(hit, F.lit(False)))
    newest = [F.col("ts_us").desc(), F.col("id").desc()]
    rows = rows.orderBy(*([severity_rank(F.col("severity")).desc()] if sort == "severity" else []), *newest)
    if limit is not None:
        rows = rows.limit(limit)
    confidence = F.col("confidence")
    return rows.select(
        "id",
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        "severity",
        F.col("alert_type").alias("type"),
        _dash("src_ip").alias("src"),
        F.concat(_dash("dst_ip"), F.lit(":"), _dash("dst_port")).alias("dst"),
        F.substring("description", 1, description_chars).alias("description"),
        _dash("mitre_tactic").alias("mitre"),
        F.when(confidence > 0, F.concat(F.round(confidence * 100).cast("bigint").cast("string"), F.lit("%")))
        .otherwise(dims.NO_VALUE)
        .alias("confidence"),
    )


def notification_outbox(alerts: DataFrame, channel: str, min_severity: str | None = None) -> DataFrame:
    """Messages for one channel ("console", "email", "slack"), ready to be delivered elsewhere.

    Default thresholds: email HIGH, slack MEDIUM, console all.
    """
    if min_severity is None:
        min_severity = {"email": "HIGH", "slack": "MEDIUM"}.get(channel)
    rows = alerts if min_severity is None else alerts.where(severity_at_least(F.col("severity"), min_severity))
    time = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss")
    color = lookup(F.col("severity"), dims.SEVERITY_COLORS, "#333333")
    text = F.coalesce("description", F.lit(""))
    if channel == "email":
        title = F.concat(F.lit("[IDS "), F.col("severity"), F.lit("] "), F.substring(text, 1, 60))
        body = F.concat_ws(
            "\n",
            F.concat(F.lit("Timestamp: "), time),
            F.concat(F.lit("Type: "), F.col("alert_type")),
            F.concat(F.lit("Source IP: "), _dash("src_ip", "")),
            F.concat(F.lit("Destination IP: "), _dash("dst_ip", "")),
            F.concat(F.lit("Port: "), _dash("dst_port", "")),
            F.concat(F.lit("Description: "), text),
            F.concat(F.lit("MITRE Tactic: "), _dash("mitre_tactic", "")),
            F.concat(F.lit("Confidence: "), _dash("confidence", "")),
        )
    elif channel == "slack":
        title = F.concat(F.lit("IDS Alert — "), F.col("severity"))
        body = F.to_json(
            F.struct(
                F.col("alert_type").alias("Type"),
                _dash("src_ip", "-").alias("Source IP"),
                _dash("dst_ip", "-").alias("Dest IP"),
                _dash("dst_port", "").alias("Port"),
                F.substring(text, 1, 200).alias("Description"),
                _dash("mitre_tactic", "").alias("MITRE"),
                _dash("confidence", "").alias("Confidence"),
            )
        )
    else:
        title = F.concat(F.lit("[ALERT]["), F.col("severity"), F.lit("]"))
        body = F.concat(
            title, F.lit(" "), time, F.lit(" | "), _dash("src_ip", "-"), F.lit(" → "), _dash("dst_ip", "-"),
            F.lit(" | "), F.substring(text, 1, 120),
        )
    return rows.select("id", F.lit(channel).alias("channel"), title.alias("title"), color.alias("color"), body.alias("body"))

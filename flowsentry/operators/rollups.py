"""Questions over the stored alert table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsentry import dims

HOUR_US = 3_600_000_000


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("cnt"))


def alert_timeline(alerts: DataFrame, as_of_us: int, hours: int = 24) -> DataFrame:
    """Alerts per hour over the last ``hours`` before ``as_of_us``, oldest first."""
    recent = alerts.where((F.col("ts_us") >= as_of_us - hours * HOUR_US) & (F.col("ts_us") <= as_of_us))
    hour = F.date_format(F.date_trunc("hour", F.timestamp_micros("ts_us")), "yyyy-MM-dd'T'HH:00:00")
    return recent.groupBy(hour.alias("hour")).agg(F.count("*").alias("count")).orderBy("hour")


def recent_alerts(alerts: DataFrame, limit: int = 100, severity: str | None = None) -> DataFrame:
    rows = alerts if severity is None else alerts.where(F.col("severity") == severity)
    return rows.orderBy(F.col("ts_us").desc(), F.col("id").desc()).limit(limit)


def top_source_ips(alerts: DataFrame, k: int = 10) -> DataFrame:
    named = alerts.where("src_ip is not null and src_ip <> ''")
    return named.groupBy("src_ip").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "src_ip").limit(k)


def mitre_coverage(alerts: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Alerts per technique of the reference table; techniques without alerts show 0."""
    spark = alerts.sparkSession
    table = spark.createDataFrame(dims.MITRE, "event_type string, tactic string, technique string, name string")
    # Counted first: one row per event type meets the fixed table.
    counts = alerts.groupBy(F.col(event_type).alias("event_type")).agg(F.count("*").alias("n"))
    return (
        F.broadcast(table).join(counts, "event_type", "left")
        .groupBy("tactic", "technique", "name")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"))
    )


def report_summary(alerts: DataFrame, as_of_us: int, hours: int | None = 24, shown: int = 5) -> DataFrame:
    """Severity totals of the period and its newest critical alerts, as (section, key, text) rows."""
    rows = alerts.where(F.col("ts_us") <= as_of_us)
    if hours is not None:
        rows = rows.where(F.col("ts_us") >= as_of_us - hours * HOUR_US)
    counts = rows.groupBy("severity").agg(F.count("*").alias("n"))
    by_name = {"Total Alerts": F.lit(True), **{s.title(): F.col("severity") == s for s in reversed(dims.SEVERITY_RANK)}}
    totals = counts.agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in by_name.items()]
    ).unpivot([], list(by_name), "key", "n").select(F.lit("summary").alias("section"), "key", F.col("n").cast("string").alias("text"))

    def text(column: str) -> Column:
        return F.coalesce(column, F.lit(""))

    critical = recent_alerts(rows, shown, "CRITICAL").select(
        F.lit("critical").alias("section"),
        F.col("id").cast("string").alias("key"),
        F.concat(
            text("description"), F.lit(" — "), text("src_ip"), F.lit(" → "), text("dst_ip"), F.lit(" "),
            F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm"),
        ).alias("text"),
    )
    return totals.unionByName(critical)

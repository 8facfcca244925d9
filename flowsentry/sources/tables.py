"""Result tables: alerts, network and host events, model quality, CSV exports, message outbox."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from flowsentry.functions.alerting import alert_fingerprint
from flowsentry.operators.alerts import notification_outbox
from flowsentry.plans.storage import materialize


def alert_rows(alerts: DataFrame, sensor: str = "") -> DataFrame:
    """Alerts with a stable text id and the date they are partitioned by.

    The id is a digest of sensor, time, source row and fingerprint, so writing the same
    batch again gives the same ids.
    """
    parts = [F.lit(sensor), F.col("ts_us").cast("string"), F.col("source_id").cast("string"), alert_fingerprint()]
    return alerts.withColumns(
        {
            "id": F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256),
            "acknowledged": F.lit(0),
            "date": F.to_date(F.timestamp_micros("ts_us")),
        }
    )


def write_alerts(alerts: DataFrame, path: str, sensor: str = "", once: bool = False) -> None:
    """Appends alerts with the time they were stored.

    ``once``: ids that the table has already are left out, so a batch that is written again after a
    failure adds nothing.  Only the dates of the batch are read for that.
    """
    rows = alert_rows(alerts, sensor).withColumn("created_at", F.current_timestamp())
    if once:
        try:
            stored = rows.sparkSession.read.parquet(path).select("date", "id")
        except AnalysisException:  # no table yet
            pass
        else:
            stored = stored.join(rows.select("date").distinct(), "date", "left_semi")
            rows = materialize(rows.dropDuplicates(["id"]).join(stored, ["date", "id"], "left_anti"))
    rows.write.mode("append").partitionBy("date").parquet(path)


def write_network_events(events: DataFrame, path: str) -> None:
    events.withColumn("date", F.to_date(F.timestamp_micros("ts_us"))).write.mode("append").partitionBy("date").parquet(path)


def host_events(events: DataFrame) -> DataFrame:
    """Host event rows as stored: description cut to 500, score 0.9."""
    return events.select(
        "ts",
        "event_type",
        "hostname",
        "user",
        F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"),
        F.lit(0.9).alias("anomaly_score"),
    )


def write_host_events(events: DataFrame, path: str) -> None:
    host_events(events).withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def write_model_performance(rows: DataFrame, path: str) -> None:
    rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def outbox_sink(path: str, channel: str, min_severity: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch sink that files the messages of one channel."""

    def write(alerts: DataFrame, batch_id: int) -> None:
        messages = notification_outbox(alerts, channel, min_severity)
        messages.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return write


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A batch sink whose table has a folder per batch: a batch that is written again replaces what the first try left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


class Manifest:
    """Which sink has taken which batch: a table (sink, batch_id), a row for each."""

    def __init__(self, path: str):
        self.path = path

    def taken(self, spark: SparkSession, batch_id: int) -> set[str]:
        try:
            rows = spark.read.schema("sink string, batch_id bigint").parquet(self.path)
        except AnalysisException:  # no batch yet
            return set()
        return {r["sink"] for r in rows.where(F.col("batch_id") == batch_id).select("sink").distinct().collect()}  # as many as there are sinks

    def add(self, spark: SparkSession, sink: str, batch_id: int) -> None:
        rows = spark.createDataFrame([(sink, batch_id)], "sink string, batch_id bigint")
        rows.coalesce(1).write.mode("append").parquet(self.path)


def fan_out(
    sinks: list[Callable[[DataFrame, int], None]] | dict[str, Callable[[DataFrame, int], None]],
    failures: list | None = None,
    manifest: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """One batch to every sink; a failing sink is recorded (and logged) and does not stop the others.

    With a ``manifest`` (a table's path) and named sinks, a batch that comes again goes only to the sinks that have not taken it, and
    a batch that some sink has not taken fails in the end, so that the stream brings it again. A sink that writes by batch
    (``batch_sink``) then has every row once, wherever the run broke.
    """
    named = sinks if isinstance(sinks, dict) else {f"{i} {getattr(s, '__name__', 'sink')}": s for i, s in enumerate(sinks)}
    book = Manifest(manifest) if manifest else None

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = book.taken(spark, batch_id) if book else set()
        missed = []
        batch.persist()
        try:
            for name, sink in named.items():
                if name in taken:
                    continue
                try:
                    sink(batch, batch_id)
                except Exception as e:
                    missed.append(name)
                    logging.getLogger(__name__).warning("sink %s did not take batch %s: %s", name, batch_id, e)
                    if failures is not None:
                        failures.append((batch_id, getattr(sink, "__name__", "sink"), str(e)))
                else:
                    if book:
                        book.add(spark, name, batch_id)
        finally:
            batch.unpersist()
        if book and missed:
            raise RuntimeError(f"batch {batch_id} was not taken by {', '.join(missed)}")

    return write

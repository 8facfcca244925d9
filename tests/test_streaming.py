"""Stream form = batch form on in-order input, replayed from sorted files."""

import os

import pytest
from pyspark.sql import functions as F

from flowsentry import queries as q
from flowsentry.fixtures import view
from flowsentry.operators import alerts as al, flows as fl, hostlog as hl, signatures as sg, snapshots as sn
from flowsentry.sources import files as fs, tables as tb
from flowsentry.streaming import alerts as sa, detectors as sd, flows as sf_, hosts as sh


def replay(spark, df, folder, by, parts=4):
    """Writes ``df`` as files of consecutive rows and returns a stream that reads one per batch."""
    rows = df.orderBy(by).toPandas()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows.iloc[i * size : (i + 1) * size], df.schema).coalesce(1)
        part.write.parquet(os.path.join(folder, f"p{i:03d}"))
        for f in os.listdir(os.path.join(folder, f"p{i:03d}")):
            if f.endswith(".parquet"):
                os.utime(os.path.join(folder, f"p{i:03d}", f), (1_700_000_000 + i, 1_700_000_000 + i))
    return (
        spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    )


def run(stream, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def same(a, b, columns=None):
    columns = sorted(columns or b.columns)
    key = lambda r: tuple(str(r[c]) for c in columns)
    assert sorted(map(key, a.select(*columns).collect())) == sorted(map(key, b.select(*columns).collect()))


@pytest.fixture(scope="module")
def packets(spark, sf):
    return q.packets(spark, sf)


def test_stream_flows(spark, packets, tmp_path):
    last = packets.agg(F.max("ts_us")).first()[0]
    batch = fl.build_flows(packets, as_of_us=last - 30_000_000).where("close_reason <> 'open'")
    got = run(sf_.stream_flows(replay(spark, packets, str(tmp_path / "in"), "seq")), tmp_path)
    assert got.count() > 100 and {"idle", "fin_rst"} == {r[0] for r in got.select("close_reason").distinct().collect()}
    same(got, batch)


def test_stream_signatures(spark, packets, tmp_path):
    flows = fl.build_flows(packets)
    batch = sg.signature_matches(flows, ports=10, syns=5)
    source = replay(spark, flows.select(*sg._FLOW_COLUMNS), str(tmp_path / "in"), ["start_us", "flow_id"])
    got = run(sd.stream_signatures(source, ports=10, syns=5, delay="300 seconds"), tmp_path)
    assert got.count() > 20
    same(got, batch)


def test_stream_brute_force(spark, sf, tmp_path):
    events = hl.parse_auth_events(view(spark, sf, "fx_log_lines"), 2024)
    got = run(sd.stream_brute_force(replay(spark, events, str(tmp_path / "in"), "line_no")), tmp_path)
    assert got.where("event_type = 'BRUTE_FORCE'").count() > 0
    same(got, hl.auth_brute_force(events))


def test_stream_admitted_alerts_reach_all_sinks(spark, sf, tmp_path):
    alerts = view(spark, sf, "fx_alerts")
    batch = al.admit_alerts(alerts, limit=20)
    source = replay(spark, alerts, str(tmp_path / "in"), "id")
    out, failures = str(tmp_path / "kept"), []

    def broken(df, batch_id):
        raise RuntimeError("sink down")

    def store(df, batch_id):
        df.write.mode("append").parquet(out)

    query = sa.start_alert_sinks(sa.stream_admitted(source, limit=20), [broken, store], str(tmp_path / "c"), failures, availableNow=True)
    query.awaitTermination(300)
    assert query.exception() is None and len(failures) >= 4
    same(spark.read.parquet(out), batch)


def test_stream_process_anomalies(spark, sf, tmp_path):
    snapshots = view(spark, sf, "fx_processes")
    got = run(sh.stream_process_anomalies(replay(spark, snapshots, str(tmp_path / "in"), ["scan_no", "host", "pid"], parts=4)), tmp_path)
    assert got.count() > 0
    same(got, sn.process_anomalies(snapshots))


def test_traffic_rate(spark, packets, tmp_path):
    got = run(sd.traffic_rate(replay(spark, packets, str(tmp_path / "in"), "seq")), tmp_path)
    minute = F.date_trunc("minute", F.timestamp_micros("ts_us"))
    batch = packets.groupBy(minute.alias("start")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    closed = got.agg(F.max("start")).first()[0]
    same(got, batch.where(F.col("start") <= closed), ["start", "packets", "bytes"])


def test_port_fanout_finds_the_scanner(spark, sf, tmp_path):
    flows = fl.build_flows(q.packets(spark, sf))
    # One flow a minute later moves the watermark past the scan.
    later = flows.orderBy(F.col("start_us").desc()).limit(1).withColumn("start_us", F.col("start_us") + 60_000_000)
    source = replay(spark, flows.unionByName(later), str(tmp_path / "in"), ["start_us", "flow_id"])
    got = run(sd.stream_port_fanout(source, ports=15, delay="10 seconds"), tmp_path)
    assert {r.src_ip for r in got.collect()} == {"10.0.0.99"}


def test_file_integrity_sink(spark, tmp_path):
    events = []
    sink = sh.file_integrity_sink(str(tmp_path / "base"), lambda df, i: events.append({r.file_path: r.event_type for r in df.collect()}))
    scan = lambda rows: spark.createDataFrame(rows, "host string, path string, sha256 string")
    sink(scan([("h", "/etc/hosts", "1"), ("h", "/opt/a", "1")]), 0)
    sink(scan([("h", "/etc/hosts", "2"), ("h", "/opt/b", "1")]), 1)
    assert events == [{}, {"/etc/hosts": "MODIFIED", "/opt/a": "DELETED", "/opt/b": "CREATED"}]
    assert fs.latest_scan(spark, str(tmp_path / "base")) == 1


def test_outbox_sink(spark, sf, tmp_path):
    alerts = q.alert_table(spark, sf)
    tb.outbox_sink(str(tmp_path / "o"), "email")(alerts, 7)
    rows = spark.read.parquet(str(tmp_path / "o"))
    assert rows.count() == alerts.where("severity in ('HIGH', 'CRITICAL')").count() and rows.first().batch_id == 7


def test_stream_scoring(spark, packets, tmp_path):
    from flowsentry.ml.isolation_forest import fit_isolation_forest
    from flowsentry.ml.training import Models, score_flows
    from flowsentry.operators.features import flow_features
    from flowsentry.plans.storage import materialize
    from flowsentry.streaming.scoring import stream_scoring

    flows = materialize(fl.build_flows(packets))
    models = Models(isolation_forest=fit_isolation_forest(materialize(flow_features(flows)), "flow_id", trees=10))
    got = run(stream_scoring(replay(spark, flows, str(tmp_path / "in"), "flow_id"), models), tmp_path)
    same(got, score_flows(flows, models), ["flow_id", "if_score", "rf_score", "votes", "confidence"])

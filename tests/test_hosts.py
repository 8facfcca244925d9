import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from flowsentry.functions.net import flag_bits, flag_letters, is_internal, port_label, protocol_name
from flowsentry.operators import alerts as al, hostlog as hl, rollups as ru, snapshots as sn
from flowsentry.sources import files as fs, logs, tables as tb
from flowsentry.sources.files import check_files, scan_file_hashes
from flowsentry.sources.logs import stream_auth_log
from flowsentry.streaming.detectors import stream_brute_force
from flowsentry.streaming.replay import run_to_table

LINES = {
    "ssh_fail": "Jun  5 14:23:01 server sshd[1234]: Failed password for invalid user admin from 192.168.1.100 port 22 ssh2",
    "ssh_success": "Jun  5 14:25:00 server sshd[1235]: Accepted password for ubuntu from 10.0.0.5 port 22 ssh2",
    "sudo": "Jun  5 14:26:00 server sudo[1236]:   ubuntu : TTY=pts/0 ; PWD=/home/ubuntu ; USER=root ; COMMAND=/bin/bash",
    "sudo_fail": "Jun  5 14:27:00 server sudo[1236]:   bob : authentication failure ; USER=root",
    "user_added": "Jun  5 14:30:00 server useradd[1237]: new user: name=hacker, UID=1001, GID=1001, home=/home/hacker, shell=/bin/bash",
    "user_deleted": "Jun  5 14:31:00 server userdel[1238]: delete user 'hacker'",
    "noise": "Jun  5 14:31:00 server kernel: eth0: renamed from veth123",
    "empty": "",
    "garbage": "random garbage 12345 !@#$",
}


def parse(spark, *lines, **kw):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    return hl.parse_auth_events(df, 2024, **kw)


@pytest.mark.parametrize(
    "name,event,severity,user,ip",
    [("ssh_fail", "AUTH_FAIL", "MEDIUM", "admin", "192.168.1.100"), ("ssh_success", "AUTH_SUCCESS", "LOW", "ubuntu", "10.0.0.5"),
     ("sudo", "SUDO", "MEDIUM", "ubuntu", None), ("sudo_fail", "SUDO_FAIL", "HIGH", "bob", None),
     ("user_added", "USER_ADDED", "HIGH", "hacker", None), ("user_deleted", "USER_DELETED", "HIGH", "hacker", None)],
)
def test_auth_rules(spark, name, event, severity, user, ip):
    (row,) = parse(spark, LINES[name]).collect()
    assert (row.event_type, row.severity, row.user, row.source_ip, row.hostname) == (event, severity, user, ip, "server")
    assert row.ts.date() == dt.date(2024, 6, 5) and row.raw_line == LINES[name]
    assert row.description.endswith(LINES[name][:120])


def test_noise_matches_nothing(spark):
    assert parse(spark, LINES["noise"], LINES["empty"], LINES["garbage"]).count() == 0


def test_sudo_command_and_missing_pid(spark):
    (row,) = parse(spark, LINES["sudo"]).collect()
    assert row.command == "/bin/bash" and row.pid == 1236
    bare = LINES["sudo"].replace("sudo[1236]", "sudo")
    assert parse(spark, bare).count() == 0
    (row,) = parse(spark, bare, sudo_without_pid=True).collect()
    assert row.event_type == "SUDO" and row.pid is None


def test_bad_time_is_null(spark):
    (row,) = parse(spark, LINES["ssh_fail"].replace("Jun  5 14:23:01", "Jun  5 99:99:99")).collect()
    assert row.ts is None and row.event_type == "AUTH_FAIL"


def test_brute_force_needs_five_in_a_minute(spark):
    events = hl.auth_brute_force(parse(spark, *[LINES["ssh_fail"]] * 7)).orderBy("line_no").collect()
    assert [e.event_type for e in events] == ["AUTH_FAIL"] * 4 + ["BRUTE_FORCE"] * 3
    assert events[-1].severity == "CRITICAL" and events[-1].description == "SSH brute force from 192.168.1.100: 7 failures in 60s"


@pytest.mark.parametrize("second,hit", [("14:24:01", True), ("14:24:02", False)])
def test_brute_force_window(spark, second, hit):
    lines = [LINES["ssh_fail"]] * 4 + [LINES["ssh_fail"].replace("14:23:01", second)]
    events = hl.auth_brute_force(parse(spark, *lines), chunks=2).where("event_type = 'BRUTE_FORCE'")
    assert (events.count() == 1) is hit


UPLOAD = [
    ("sshd: Failed password for invalid user bob from 1.2.3.4", "SSH_FAIL", "bob", "1.2.3.4"),
    ("sshd: accepted PUBLICKEY for amy from 1.2.3.5", "SSH_PUBKEY", "amy", "1.2.3.5"),
    ("sudo: carol : TTY ; COMMAND=/bin/ls", "SUDO_EXEC", "carol", "/bin/ls"),
    ("useradd new user: name=x", "USER_CREATE", "x", "—"),
    ("Invalid user zed from 9.9.9.9", "INVALID_USER", "zed", "9.9.9.9"),
    ("authentication failure; user=kim", "AUTH_FAIL", "kim", "—"),
    ("POSSIBLE BREAK-IN ATTEMPT! from 8.8.8.8", "BREAK_IN", "—", "8.8.8.8"),
    ("7.7.7.7 refused connect", "REFUSED_CONN", "—", "7.7.7.7"),
    ("app segfault at 0", "SEGFAULT", "—", "—"),
    ("kernel: invoked oom-killer", "OOM_KILL", "—", "—"),
]


def test_upload_rules(spark):
    df = spark.createDataFrame([(i, line) for i, (line, *_) in enumerate(UPLOAD)] + [(99, "nothing here")], "line_no bigint, line string")
    rows = hl.classify_log_lines(df).orderBy("line_no").collect()
    assert [(r.type, r.user, r.ip) for r in rows] == [(t, u, ip) for _, t, u, ip in UPLOAD]


def test_brute_force_profile_bands(spark):
    lines = [f"Failed password for a from 10.0.0.{ip}" for ip, n in ((1, 4), (2, 5), (3, 21), (4, 51)) for _ in range(n)]
    events = hl.classify_log_lines(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string"))
    rows = hl.brute_force_profiles(events).collect()
    assert [(r.ip, r.severity) for r in rows] == [("10.0.0.4", "CRITICAL"), ("10.0.0.3", "HIGH"), ("10.0.0.2", "MEDIUM")]


def test_read_log_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "auth.log").write_bytes(b"  ok line \n\xff\xfe bad\n")
    rows = logs.read_auth_log(spark, str(tmp_path)).orderBy("line_no").collect()
    assert rows[0].line == "ok line" and rows[1].line.endswith("bad")


def test_file_scan_baseline_and_diff(spark, tmp_path):
    root, table = tmp_path / "etc", str(tmp_path / "baseline")
    (root / "sub").mkdir(parents=True)
    (root / "a").write_text("one")
    (root / "sub" / "b").write_text("two")
    scan = lambda: fs.scan_file_hashes(spark, [str(root), str(tmp_path / "missing")], "h1")
    assert fs.load_baseline(spark, table) is None
    assert fs.check_files(scan(), table).count() == 0
    assert {r.path for r in fs.load_baseline(spark, table).collect()} == {str(root / "a"), str(root / "sub" / "b")}
    (root / "a").write_text("changed")
    (root / "c").write_text("new")
    found = {r.file_path: (r.event_type, r.severity) for r in fs.check_files(scan(), table).collect()}
    assert found == {str(root / "a"): ("MODIFIED", "MEDIUM"), str(root / "c"): ("CREATED", "MEDIUM")}
    assert fs.latest_scan(spark, table) == 1


@pytest.mark.parametrize(
    "path,severity", [("/etc/passwd", "HIGH"), ("/usr/bin/ls", "HIGH"), ("/etc/app.conf", "MEDIUM"), ("/opt/bin/x", "MEDIUM")]
)
def test_modified_severity_by_path(spark, path, severity):
    one, two = [spark.createDataFrame([("h", path, x)], "host string, path string, sha256 string") for x in "ab"]
    assert sn.diff_file_snapshots(one, two).first().severity == severity


PROC = "scan_no bigint, host string, pid bigint, ppid bigint, name string, cmdline array<string>"


def test_process_checks_in_order(spark):
    base = [(0, "h", 1, 0, "nginx", ["nginx"])]
    now = [
        (1, "h", 1, 0, "nginx", ["nginx"]),
        (1, "h", 2, 1, "NC", ["nc", "-l"]),
        (1, "h", 3, 1, "bash", ["bash"]),
        (1, "h", 4, 99, "sh", ["sh", "-c", "mkfifo /tmp/x"]),
        (1, "h", 5, 99, "sh", ["sh"]),
        (1, "h", 6, 1, None, None),
    ]
    rows = sn.process_anomalies(spark.createDataFrame(base + now, PROC)).orderBy("pid").collect()
    assert [(r.pid, r.event_type) for r in rows] == [(2, "SUSPICIOUS_PROCESS"), (3, "SUSPICIOUS_SPAWN"), (4, "SUSPICIOUS_SPAWN")]
    assert rows[0].description == "Known suspicious tool: nc (pid=2)"
    assert rows[1].description == "Shell 'bash' spawned by web process 'nginx' — possible RCE (pid=3)"
    assert rows[2].description == "Potential reverse shell: sh -c mkfifo /tmp/x" and rows[2].parent_name == ""


def test_first_scan_of_a_host_is_its_baseline(spark):
    rows = [(0, "a", 1, 0, "init", ["x"]), (1, "a", 1, 0, "init", ["x"]), (1, "b", 9, 0, "xmrig", ["x"]), (2, "b", 9, 0, "xmrig", ["x"])]
    assert sn.process_anomalies(spark.createDataFrame(rows, PROC)).count() == 0


def test_flag_letters_round_trip(spark):
    df = spark.createDataFrame([("SA",), ("",), ("FSRPAUEC",)], "f string")
    rows = df.select("f", flag_letters(flag_bits(F.col("f"))).alias("g"), flag_bits(F.col("f")).alias("b")).collect()
    assert [(r.f, r.g) for r in rows] == [("SA", "SA"), ("", ""), ("FSRPAUEC", "FSRPAUEC")] and rows[0].b == 0x12


def test_internal_addresses(spark):
    ips = {"10.1.2.3": True, "172.16.0.1": True, "172.31.9.9": True, "172.32.0.1": False, "192.168.0.1": True, "192.169.0.1": False,
           "8.8.8.8": False, "host": False, "": False}
    df = spark.createDataFrame([(k,) for k in ips], "ip string")
    assert {r.ip: r.x for r in df.select("ip", is_internal(F.col("ip")).alias("x")).collect()} == ips


def test_names_and_labels(spark):
    df = spark.createDataFrame([(6, 22), (17, 4444), (1, 80), (47, 3389)], "protocol int, port int")
    rows = df.select(protocol_name(F.col("protocol")).alias("p"), port_label(F.col("port")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("TCP", ":22 (SSH)"), ("UDP", ":4444 (Metasploit/Meterpreter C2)"), ("ICMP", ":80 ()"), ("47", ":3389 (RDP)")]


EVENT = "source_id bigint, ts_us bigint, event_type string, source_ip string, severity string, description string"


def test_host_alert_defaults(spark):
    df = spark.createDataFrame([(1, 0, "SUDO", None, None, "x"), (2, 0, "WHAT", "1.1.1.1", "LOW", "y")], EVENT)
    a, b = al.host_event_to_alert(df).orderBy("source_id").collect()
    assert (a.src_ip, a.severity, a.mitre_tactic, a.mitre_technique, a.confidence) == ("localhost", "MEDIUM", "Privilege Escalation", "T1548.003", 0.9)
    assert (b.mitre_tactic, b.mitre_technique, b.dst_ip) == ("Unknown", "Unknown", "localhost")


def test_alert_defaults(spark):
    df = spark.createDataFrame([(None, None, None)], "ts_us bigint, severity string, alert_type string")
    row = al.alert_defaults(df, F.lit(5)).first()
    assert (row.ts_us, row.severity, row.alert_type, row.notified) == (5, "LOW", "UNKNOWN", 0)


def test_alert_ids_are_stable_and_written_by_date(spark, sf, tmp_path):
    df = spark.createDataFrame(
        [(1, 1_700_000_000_000_000, "HOST", "LOW", "a", "b", 0, "x"), (2, 1_700_090_000_000_000, "HOST", "LOW", "a", "b", 0, "x")],
        "source_id bigint, ts_us bigint, alert_type string, severity string, src_ip string, dst_ip string, dst_port int, description string",
    )
    tb.write_alerts(df, str(tmp_path / "a"), "s1")
    tb.write_alerts(df, str(tmp_path / "a"), "s1")
    rows = spark.read.parquet(str(tmp_path / "a"))
    assert rows.count() == 4 and rows.select("id").distinct().count() == 2 and rows.select("date").distinct().count() == 2
    acked = al.acknowledge(rows, rows.limit(1).select("id"))
    assert acked.where("acknowledged = 1").count() == 2


def test_correlation_across_cuts(spark):
    schema = "id bigint, src_ip string, ts_s bigint"
    net = [(i, "hot" if i % 3 else "b", i * 7) for i in range(200)] + [(900, None, 5), (901, "", 5)]
    host = [(1000 + i, "hot" if i % 2 else "c", i * 11) for i in range(150)]
    want = {}
    for i, ip, t in net:
        n = sum(1 for _, hip, ht in host if ip and hip == ip and abs(ht - t) <= 60)
        if n:
            want[i] = n
    for chunks in (1, 5):
        got = al.correlate_net_host(spark.createDataFrame(net, schema), spark.createDataFrame(host, schema), 60, chunks=chunks)
        assert {r.id: r.host_events for r in got.collect()} == want


def test_feed_sorts_by_time_and_severity(spark):
    rows = [(1, 10, "LOW"), (2, 5, "CRITICAL"), (3, 7, "CRITICAL")]
    df = spark.createDataFrame(
        [(i, t * 1_000_000, "HOST", s, "a", "b", 1, "d", "m", 0.0) for i, t, s in rows],
        "id bigint, ts_us bigint, alert_type string, severity string, src_ip string, dst_ip string, dst_port int, description string, "
        "mitre_tactic string, confidence double",
    )
    assert [r.id for r in al.alert_feed(df).collect()] == [1, 3, 2]
    assert [r.id for r in al.alert_feed(df, sort="severity").collect()] == [3, 2, 1]
    assert al.alert_feed(df).first().confidence == "—"
    assert [r.id for r in ru.recent_alerts(df, 2).collect()] == [1, 3]


def test_fan_out_survives_a_failing_sink(spark):
    seen, failures = [], []

    def bad(df, i):
        raise ValueError("no")

    tb.fan_out([bad, lambda df, i: seen.append(df.count())], failures)(spark.range(3), 0)
    assert seen == [3] and failures[0][1:] == ("bad", "no")


def test_export_csv(spark, tmp_path):
    tb.export_csv(spark.range(3), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 3


def test_missing_scan_numbers_hide_nothing(spark):
    rows = [(0, "a", 1, 0, "init", ["x"]), (3, "a", 1, 0, "init", ["x"]), (3, "a", 2, 1, "xmrig", ["x"]), (9, "a", 2, 1, "xmrig", ["x"])]
    assert [(r.scan_no, r.pid) for r in sn.process_anomalies(spark.createDataFrame(rows, PROC)).collect()] == [(3, 2)]


def test_hosts_share_a_baseline_table(spark, tmp_path):
    table, schema = str(tmp_path / "b"), "host string, path string, sha256 string"
    scan = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert check_files(scan(("a", "/x", "1"), ("a", "/y", "1")), table).count() == 0
    assert check_files(scan(("b", "/x", "7")), table).count() == 0
    again = [(r.host, r.event_type, r.file_path) for _ in range(2) for r in check_files(scan(("a", "/x", "2")), table, 5).orderBy("file_path").collect()]
    assert again == [("a", "MODIFIED", "/x"), ("a", "DELETED", "/y")] * 2
    assert [(r.host, r.event_type) for r in check_files(scan(("b", "/x", "8")), table).collect()] == [("b", "MODIFIED")]


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "large").write_bytes(b"xyz" * 50_000)
    want = {r.path: r.sha256 for r in scan_file_hashes(spark, [str(tmp_path)], "h").collect()}
    assert {r.path: r.sha256 for r in scan_file_hashes(spark, [str(tmp_path)], "h", whole_file=1000).collect()} == want
    assert want[str(tmp_path / "large")] == hashlib.sha256(b"xyz" * 50_000).hexdigest()


def test_alerts_written_once(spark, tmp_path):
    schema = "source_id bigint, ts_us bigint, alert_type string, severity string, src_ip string, dst_ip string, dst_port int, description string"
    rows = [(i, 1_700_000_000_000_000 + i, "HOST", "LOW", "a", "b", 0, "x") for i in range(3)]
    for part in (rows[:2], rows[:2], rows):
        tb.write_alerts(spark.createDataFrame(part, schema), str(tmp_path / "a"), once=True)
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert stored.count() == 3 and stored.where("created_at is null").count() == 0


def test_log_stream_reaches_the_parser(spark, tmp_path):
    line = "Jun  5 14:23:{:02d} host sshd[9]: Failed password for root from 9.9.9.9 port 22 ssh2"
    (tmp_path / "auth.log").write_text("\n".join(line.format(i) for i in range(7)) + "\n")
    events = hl.parse_auth_events(stream_auth_log(spark, str(tmp_path)), 2024)
    found = run_to_table(stream_brute_force(events)).orderBy("ts").collect()
    assert [r.event_type for r in found] == ["AUTH_FAIL"] * 4 + ["BRUTE_FORCE"] * 3
    assert len({r.line_no for r in found}) == 7


def test_log_stream_reads_a_file_in_ranges(spark, tmp_path, monkeypatch):
    """No row holds a file: lines are keyed by their byte offset, whatever the ranges and where they cut."""
    from flowsentry.sources import logs

    data = b"".join(b"%d %s\n" % (i, b"x" * (i * 7 % 50)) for i in range(300)) + b"\n\n  spaced \r\nlast \xff without feed"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "auth log.1").write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n"):
        if line.strip(b" "):
            want.append((at, line.decode("utf-8", "replace").strip(" ")))
        at += len(line) + 1
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(logs, "RANGE", size)
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", size)  # a larger value would fail
        found = run_to_table(logs.stream_auth_log(spark, str(tmp_path / "in"))).collect()
        assert sorted((r.line_no & ((1 << 40) - 1), r.line) for r in found) == want
        assert all(r.line_no < 1 << 53 for r in found)
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("read", [1, 3, 1 << 20])
def test_ranges_share_out_all_lines(monkeypatch, read):
    import io

    from flowsentry.sources import logs

    monkeypatch.setattr(logs, "READ", read)
    for data in (b"", b"\n", b"\n\n\n", b"a\nbc\n\ndef", b"abcdefgh", b"abcdefgh\n", b"ab\ncd\n"):
        want = [i for i in range(len(data)) if i == 0 or data[i - 1 : i] == b"\n"]
        for size in range(1, 6):
            got = [x for s in range(0, len(data), size) for x in logs.lines_from(io.BytesIO(data), s, min(s + size, len(data)))]
            assert [a for a, _ in got] == want
            assert all(data[a : a + len(t) + 1].rstrip(b"\n") == t for a, t in got)

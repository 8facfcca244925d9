"""Every operator as a query over the given tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

import uuid
from functools import lru_cache, wraps

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from flowsentry import dims
from flowsentry.fixtures import view
from flowsentry.functions import alerting as at, net
from flowsentry.operators import (
    alerts as al,
    capture as cp,
    features,
    flows as fl,
    hostlog as hl,
    identity as idn,
    labelled as lb,
    rollups as ru,
    signatures as sg,
    snapshots as sn,
    throttle as th,
)
from flowsentry.ml import metrics
from flowsentry.ml.autoencoder import Autoencoder, fit_autoencoder, init_weights
from flowsentry.ml.ensemble import (
    calibrate,
    ensemble_vote as ensemble_vote_of,
    ml_to_alert,
    network_events as network_event_rows,
    scoring_stats as scoring_stats_of,
)
from flowsentry.ml.isolation_forest import IsolationForest, fit_isolation_forest
from flowsentry.ml.random_forest import feature_importance as importance_of, fit_random_forest, score_random_forest
from flowsentry.ml.split import stratified_split as split
from flowsentry.ml.training import evaluate, score_flows as score_flows_with, train
from flowsentry.plans.ordered import ranked
from flowsentry.plans.storage import checkpoint_dir, materialize
from flowsentry.sources import tables as tb
from flowsentry.sources.captures import parse_captures, read_pcap
from flowsentry.sources.files import check_files
from flowsentry.sources.logs import stream_auth_log
from flowsentry.sources.tail import tail_auth_log
from flowsentry.streaming import detectors as sd, hosts as sh
from flowsentry.streaming.alerts import start_alert_sinks, stream_admitted
from flowsentry.streaming.flows import stream_flows as stream_flow_rows
from flowsentry.streaming.replay import files_for, replay, run_to_table, state_store, written
from flowsentry.streaming.scoring import stream_scoring as stream_score

QUERIES = {}


def query(fn):
    """Registers a query; times are UTC throughout."""

    @wraps(fn)
    def run(spark, sf):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


def packets(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "fx_packets").drop("role")
    ints = ("src_port", "dst_port")
    return p.select(net.once(F.struct(*[F.col(c).cast("int").alias(c) if c in ints else F.col(c) for c in p.columns])))


def flow_table(spark, sf, **kw) -> DataFrame:
    return fl.build_flows(packets(spark, sf), **kw)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- packets and flows ------------------------------------------------------------------

@query
def packet_normalize(spark, sf):
    tcp = F.col("protocol") == 6
    raw = packets(spark, sf).select(
        "seq", "ts_us", "src_ip", "dst_ip", "protocol", "length", F.lit(64).alias("ttl"),
        F.when(F.col("protocol") != 1, F.col("src_port")).alias("src_port"),
        F.when(F.col("protocol") != 1, F.col("dst_port")).alias("dst_port"),
        F.when(tcp, net.flag_bits(F.col("flags"))).alias("flags_bits"),
        F.when(tcp, F.col("seq")).alias("tcp_seq"), F.when(tcp, F.col("seq") + 1).alias("tcp_ack"),
        F.lit(8).alias("icmp_type"), F.lit(0).alias("icmp_code"),
    )
    return fl.normalize_packets(raw)


@query
def flows(spark, sf):
    return rounded(flow_table(spark, sf), "duration_ms", "byte_rate", "pkt_rate", digits=3)


@query
def flows_cap5(spark, sf):
    return rounded(flow_table(spark, sf, max_packets=5), "duration_ms", "byte_rate", "pkt_rate", digits=3)


@query
def uni_flows(spark, sf):
    return fl.unidirectional_flows(packets(spark, sf))


@query
def flow_features(spark, sf):
    made = features.flow_features(flow_table(spark, sf))
    return made.select("flow_id", *[F.round(F.col(c).cast("double"), 1).alias(c) for c in dims.FEATURES])


# ---- signatures ------------------------------------------------------------------------------

@query
def sig_malicious_port(spark, sf):
    return sg.sig_malicious_port(flow_table(spark, sf))


@query
def sig_sensitive_port(spark, sf):
    return sg.sig_sensitive_port(flow_table(spark, sf))


@query
def sig_dns_amplification(spark, sf):
    return sg.sig_dns_amplification(flow_table(spark, sf))


@query
def sig_port_scan(spark, sf):
    return sg.sig_port_scan(flow_table(spark, sf))


@query
def sig_syn_flood(spark, sf):
    return sg.sig_syn_flood(flow_table(spark, sf))


@query
def sig_icmp_flood(spark, sf):
    return sg.sig_icmp_flood(flow_table(spark, sf), threshold=15)


@query
def signature_alerts(spark, sf):
    return sg.signature_to_alert(sg.signature_matches(flow_table(spark, sf)))


@query
def attacking_sources(spark, sf):
    matches = sg.signature_matches(flow_table(spark, sf))
    hits = matches.select(
        F.col("start_us").alias("ts_us"), F.col("flow_id").alias("seq"), "src_ip", "dst_ip", "dst_port",
        F.col("rule_name").alias("rule"), "severity", F.col("mitre_technique").alias("technique"), "description",
    )
    return cp.rank_attackers(cp.attacker_profiles(materialize(hits)))


# ---- capture profile ---------------------------------------------------------------------------

@query
def packet_rules(spark, sf):
    return cp.classify_packets(packets(spark, sf))


@query
def capture_port_scan(spark, sf):
    return cp.capture_port_scan(packets(spark, sf))


@query
def capture_syn_flood(spark, sf):
    return cp.capture_syn_flood(packets(spark, sf))


@query
def all_hits(spark, sf):
    return cp.all_hits(packets(spark, sf))


@query
def attacker_profiles(spark, sf):
    return cp.rank_attackers(cp.attacker_profiles(materialize(cp.all_hits(packets(spark, sf)))))


@query
def attacker_targets(spark, sf):
    return cp.attacker_targets(cp.all_hits(packets(spark, sf)))


@query
def protocol_counts(spark, sf):
    return cp.protocol_counts(packets(spark, sf))


@query
def packet_timeline(spark, sf):
    return cp.packet_timeline(packets(spark, sf))


@query
def capture_kpis(spark, sf):
    return cp.capture_kpis(packets(spark, sf))


@query
def hit_breakdown(spark, sf):
    return cp.hit_breakdown(cp.all_hits(packets(spark, sf)))


@query
def top_ports(spark, sf):
    return cp.top_ports(packets(spark, sf))


@query
def packet_preview(spark, sf):
    return cp.packet_preview(packets(spark, sf))


@query
def internal_traffic(spark, sf):
    p = packets(spark, sf)
    sides = [net.is_internal(F.col(c)).alias(n) for c, n in (("src_ip", "src_internal"), ("dst_ip", "dst_internal"))]
    return p.groupBy(*sides).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


# ---- two sensors with equal addresses ------------------------------------------------------------

def two_sensors(spark, sf):
    """The packets as two sites with the same private addresses see them, the second a little later."""
    p = packets(spark, sf)
    late = p.withColumns({"sensor": F.lit("site b"), "ts_us": F.col("ts_us") + 1})
    return p.withColumn("sensor", F.lit("site a")).unionByName(late)


@query
def sensor_flows(spark, sf):
    return rounded(fl.build_flows(two_sensors(spark, sf)), "duration_ms", "byte_rate", "pkt_rate", digits=3)


@query
def sensor_signatures(spark, sf):
    return sg.signature_matches(fl.build_flows(two_sensors(spark, sf)))


@query
def sensor_hits(spark, sf):
    return cp.all_hits(two_sensors(spark, sf))


@query
def sensor_profiles(spark, sf):
    return cp.attacker_profiles(materialize(cp.all_hits(two_sensors(spark, sf))))


@query
def sensor_kpis(spark, sf):
    return cp.capture_kpis(two_sensors(spark, sf))


# ---- host log ------------------------------------------------------------------------------------

def log_lines(spark, sf):
    return view(spark, sf, "fx_log_lines")


def auth_event_table(spark, sf):
    return hl.parse_auth_events(log_lines(spark, sf), year=2024)


def upload_events(spark, sf):
    return hl.classify_log_lines(log_lines(spark, sf))


@query
def auth_events(spark, sf):
    return auth_event_table(spark, sf).withColumn("ts", F.unix_micros("ts"))


@query
def auth_brute_force(spark, sf):
    return hl.auth_brute_force(auth_event_table(spark, sf)).withColumn("ts", F.unix_micros("ts"))


@query
def log_upload_events(spark, sf):
    return upload_events(spark, sf)


@query
def log_summary(spark, sf):
    return hl.log_summary(upload_events(spark, sf))


@query
def log_kpis(spark, sf):
    return hl.log_kpis(upload_events(spark, sf))


@query
def log_timeline(spark, sf):
    return hl.log_timeline(upload_events(spark, sf))


@query
def brute_force_profiles(spark, sf):
    return hl.brute_force_profiles(upload_events(spark, sf))


@query
def top_targeted_users(spark, sf):
    return hl.top_targeted_users(upload_events(spark, sf))


# ---- files and processes -----------------------------------------------------------------------

def file_snapshot(spark, sf, which: str):
    files = view(spark, sf, "fx_files").where(f"in_{which}")
    return sn.hash_files(files.select(F.lit("host0").alias("host"), "path", f"{which}_body"), f"{which}_body")


@query
def file_hash_snapshot(spark, sf):
    return file_snapshot(spark, sf, "old")


@query
def file_integrity_diff(spark, sf):
    return sn.diff_file_snapshots(file_snapshot(spark, sf, "old"), file_snapshot(spark, sf, "new"))


@query
def process_anomalies(spark, sf):
    return sn.process_anomalies(view(spark, sf, "fx_processes"))


@query
def process_anomalies_gaps(spark, sf):
    """The same scans under numbers with holes: the last known scan counts, not the number before."""
    scans = view(spark, sf, "fx_processes")
    return sn.process_anomalies(scans.withColumn("scan_no", F.col("scan_no") * 2 + F.floor(F.col("scan_no") / 3)))


@query
def file_integrity_multi_host(spark, sf):
    """Two hosts in one stored baseline, scanned in turn; the first scan of each finds nothing."""
    table = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    found = None
    for which in ("old", "new"):
        for host in ("host0", "host1"):
            changes = check_files(file_snapshot(spark, sf, which).withColumn("host", F.lit(host)), table)
            found = changes if found is None else found.unionByName(changes)
    return found


# ---- alerts ----------------------------------------------------------------------------------------

def alert_table(spark, sf):
    """Alerts with micro-second time and host labels."""
    return al.mitre_enrich(view(spark, sf, "fx_alerts")).withColumn("ts_us", F.col("ts_s") * 1_000_000)


AS_OF_US = 1_700_003_600_000_000


@query
def alert_fingerprint(spark, sf):
    return view(spark, sf, "fx_alerts").select("id", at.alert_fingerprint().alias("fingerprint"))


@query
def dedup_alerts(spark, sf):
    return th.dedup_alerts(view(spark, sf, "fx_alerts"))


@query
def rate_limit_alerts(spark, sf):
    return th.rate_limit_alerts(view(spark, sf, "fx_alerts"), limit=20)


@query
def admitted_alerts(spark, sf):
    return al.admit_alerts(view(spark, sf, "fx_alerts"), limit=20)


@query
def mitre_enrich(spark, sf):
    return al.mitre_enrich(view(spark, sf, "fx_alerts").select("id", "event_type"))


def host_alert_table(spark, sf):
    events = hl.auth_brute_force(auth_event_table(spark, sf))
    return al.host_event_to_alert(
        events.withColumnsRenamed({"line_no": "source_id"}).withColumn("ts_us", F.unix_micros("ts"))
    )


@query
def host_alerts(spark, sf):
    return host_alert_table(spark, sf)


@query
def all_alerts(spark, sf):
    return al.all_alerts(sg.signature_to_alert(sg.signature_matches(flow_table(spark, sf))), host_alert_table(spark, sf))


@query
def alert_feed(spark, sf):
    return al.alert_feed(alert_table(spark, sf), ["CRITICAL", "HIGH"], "NETWORK", "10.0.0.1", sort="severity")


@query
def notification_outbox(spark, sf):
    a = alert_table(spark, sf)
    return al.notification_outbox(a, "email").unionByName(al.notification_outbox(a, "slack")).unionByName(
        al.notification_outbox(a, "console")
    )


@query
def acknowledged_alerts(spark, sf):
    a = view(spark, sf, "fx_alerts")
    acks = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return al.acknowledge(a.select("id", "severity"), acks)


@query
def correlate_net_host(spark, sf):
    a = view(spark, sf, "fx_alerts")
    network, host = F.col("event_type").isin("PORT_SCAN", "SYN_FLOOD"), F.col("event_type").isin("AUTH_FAIL", "SUDO")
    return al.correlate_net_host(a.where(network), a.where(host))


@query
def suppress_allowlisted(spark, sf):
    known = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.concat(F.lit("10.0.0."), (F.col("n_nationkey") * 5).cast("string")).alias("src_ip")
    )
    return al.suppress_allowlisted(view(spark, sf, "fx_alerts").select("id", "src_ip"), known)


@query
def severity_counts(spark, sf):
    return ru.severity_counts(view(spark, sf, "fx_alerts"))


@query
def alert_timeline(spark, sf):
    return ru.alert_timeline(alert_table(spark, sf), AS_OF_US, hours=1)


@query
def recent_alerts(spark, sf):
    return ru.recent_alerts(alert_table(spark, sf), 100, "HIGH")


@query
def top_source_ips(spark, sf):
    return ru.top_source_ips(view(spark, sf, "fx_alerts"))


@query
def mitre_coverage(spark, sf):
    return ru.mitre_coverage(view(spark, sf, "fx_alerts"))


@query
def report_summary(spark, sf):
    return ru.report_summary(alert_table(spark, sf), AS_OF_US, hours=1)


# ---- captures and identities ---------------------------------------------------------------------

def capture_files(spark, sf, packets_per_file: int = 500):
    """The packet view written as captures: one (path, content) row per burst, Ethernet, little endian."""
    p = packets(spark, sf).withColumn("capture", F.floor(F.col("seq") / packets_per_file))

    def be(column, size):
        return F.lpad(F.hex(column.cast("bigint")), 2 * size, "0")

    def le(column, size):
        text = be(column, size)
        return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])

    def address(column):
        return F.concat(*[be(F.split(column, r"\.")[i].cast("int"), 1) for i in range(4)])

    proto = F.col("protocol")
    up = (
        F.when(
            proto == 6,
            F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2), be(F.col("seq"), 4), be(F.col("seq") + 1, 4),
                     F.lit("50"), be(net.flag_bits(F.col("flags")), 1), F.lit("2000" "0000" "0000")),
        )
        .when(proto == 17, F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2), F.lit("0008" "0000")))
        .otherwise(F.lit("0800" "0000" "00010001"))
    )
    ip = F.concat(
        F.lit("4500"), be(F.col("length"), 2), F.lit("00000000" "40"), be(proto, 1), F.lit("0000"),
        address(F.col("src_ip")), address(F.col("dst_ip")),
    )
    frame = F.concat(F.lit("0a0000000002" "0a0000000001" "0800"), ip, up)
    size = le(F.length(frame) / 2, 4)
    record = F.concat(le(F.floor(F.col("ts_us") / 1_000_000), 4), le(F.col("ts_us") % 1_000_000, 4), size, size, frame)
    header = "d4c3b2a1" "02000400" "00000000" "00000000" "ffff0000" "01000000"
    return p.groupBy("capture").agg(
        F.unhex(F.concat(F.lit(header), F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("seq", record.alias("r")))), lambda x: x["r"]), ""
        ))).alias("content")
    ).select(F.col("capture").cast("string").alias("path"), "content")


@query
def pcap_scan(spark, sf):
    read = parse_captures(capture_files(spark, sf)).withColumn("seq", F.col("path").cast("bigint") * 500 + F.col("record"))
    return fl.normalize_packets(read)


def stored_captures(spark, sf, packets_per_file: int) -> str:
    """A folder of capture files, written by the tasks."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"

    def write(frames):
        system, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root)
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with system.open_output_stream(f"{root}/{name}.pcap") as f:
                    f.write(content)
            yield pd.DataFrame({"written": [len(frame)]})

    capture_files(spark, sf, packets_per_file).mapInPandas(write, "written bigint").agg(F.sum("written")).first()
    return folder


@query
def pcap_files(spark, sf):
    """Captures read from files, in ranges of 4 KB; the rank of a record's place in its file gives the view's numbers."""
    read = materialize(read_pcap(spark, stored_captures(spark, sf, 500), split=4096))  # ranks read it more than once
    numbered = ranked(read, ["path"], ["seq"], "place")
    capture = F.regexp_extract("path", r"(\d+)\.pcap$", 1).cast("bigint")
    return fl.normalize_packets(numbered.withColumn("seq", capture * 500 + F.col("place") - 1))


@query
def http_identity(spark, sf):
    payloads = view(spark, sf, "fx_http").withColumn("capture", F.lit("c0"))
    found = idn.host_identity(idn.http_evidence(payloads))
    return found.select("host_ip", "username", "fullname", "os", F.array_join("sources.text", "; ").alias("sources"))


@query
def dhcp_identity(spark, sf):
    """Requests without an address and offers of it: both speak of the client, by its MAC."""
    e = view(spark, sf, "fx_dhcp")
    packets = e.select(
        F.lit("c0").alias("capture"), "seq", "src_ip", F.lit("0a:00:00:00:00:01").alias("src_mac"), F.lit(17).alias("protocol"),
        F.lit(68).alias("src_port"), F.lit(67).alias("dst_port"), F.lit(0).alias("payload_at"),
        F.unhex(F.concat(
            F.repeat(F.lit("00"), F.lit(16)), "yiaddr", F.repeat(F.lit("00"), F.lit(8)), "mac", F.repeat(F.lit("00"), F.lit(202)),
            F.lit("63825363" "0c"), F.lpad(F.hex(F.length("hostname").cast("bigint")), 2, "0"), F.hex("hostname"), F.lit("ff"),
        )).alias("frame"),
    )
    hosts = idn.host_identity(idn.with_client_addresses(idn.binary_evidence(packets)))
    return hosts.select("host_ip", "ip", "mac", "hostname")


def tlv(tag: str, content: Column) -> Column:
    """A tag-length-value element in hex digits; the length takes as many octets as it needs."""

    def whole(c: Column) -> Column:
        n = F.length(c) / 2
        octets = lambda k: F.lpad(F.hex(n.cast("bigint")), 2 * k, "0")
        size = F.when(n < 128, octets(1)).when(n < 256, F.concat(F.lit("81"), octets(1))).otherwise(F.concat(F.lit("82"), octets(2)))
        return F.concat(F.lit(tag), size, c)

    return F.transform(F.array(content), whole)[0]  # the content is named once, however deep elements nest


def name_frames(e: DataFrame) -> DataFrame:
    """One frame a row: a NetBIOS question, a Kerberos request, an NTLM message or an LDAP entry, some with long elements."""
    et = F.col("et")
    filler = F.when(F.col("long_form"), F.repeat(F.lit("ab"), F.lit(300))).otherwise(F.lit("ab"))
    letters = F.translate(F.hex(F.rpad("pc", 16, " ")), "0123456789ABCDEF", "ABCDEFGHIJKLMNOP")
    netbios = F.concat(F.repeat(F.lit("00"), F.lit(12)), F.lit("20"), F.hex(letters), F.repeat(F.lit("00"), F.lit(10)))
    # RFC 4120: request, body, client name; padata of any length goes before the body
    text = lambda c: tlv("1b", F.hex(c))
    person = tlv("a1", tlv("30", F.concat(tlv("a0", tlv("02", F.lit("01"))), tlv("a1", tlv("30", text(F.col("account")))))))
    service = tlv("a3", tlv("30", F.concat(tlv("a0", tlv("02", F.lit("02"))), tlv("a1", tlv("30", F.concat(text(F.lit("ldap")), text(F.lit("dc1"))))))))
    body = F.concat(tlv("a0", tlv("03", F.lit("0040810010"))), person, tlv("a2", text(F.lit("REALM"))), service)
    padata = tlv("a3", tlv("30", tlv("30", tlv("a2", tlv("04", filler)))))
    request = tlv("6a", tlv("30", F.concat(tlv("a1", tlv("02", F.lit("05"))), tlv("a2", tlv("02", F.lit("0a"))), padata, tlv("a4", tlv("30", body)))))
    # RFC 4511: message number, entry, attributes with sets of values
    attribute = lambda name, *values: tlv("30", F.concat(tlv("04", F.hex(F.lit(name))), tlv("31", F.concat(*[tlv("04", v) for v in values]))))
    attributes = F.concat(attribute("objectClass", F.hex(F.lit("top")), filler), attribute("cn", F.hex(F.lit("Common Name"))),
                          attribute("sAMAccountName", F.hex(F.lit("acct"))), attribute("displayName", F.hex("full_name")))
    entry = tlv("30", F.concat(tlv("02", F.lit("07")), tlv("64", F.concat(tlv("04", F.hex(F.lit("cn=Common Name,dc=x"))), tlv("30", attributes)))))
    # NTLM message 3: lengths and places of domain, user and workstation, then UTF-16 text
    wide = lambda c: F.hex(F.encode(c, "UTF-16LE"))
    le = lambda n, k: F.concat(*[F.lpad(F.hex(F.pmod(F.floor(n / 256**i), F.lit(256)).cast("bigint")), 2, "0") for i in range(k)])
    domain, login, pc = F.lit("43004F0052005000"), wide(F.col("login")), wide(F.when(F.col("long_form"), F.col("pc")).otherwise(F.lit("")))
    place, fields = F.lit(64), []
    for part in (domain, login, pc):
        size = F.length(part) / 2
        fields += [le(size, 2), le(size, 2), le(place, 4)]
        place = place + size
    ntlm = F.concat(F.hex(F.lit("NTLMSSP")), F.lit("00" "03000000" + "00" * 16), *fields, F.repeat(F.lit("00"), F.lit(12)), domain, login, pc)
    data = F.when(et == "click", netbios).when(et == "view", F.concat(F.when(F.col("long_form"), F.lit("00000100")).otherwise(F.lit("")), request)).when(et == "purchase", ntlm).otherwise(entry)
    port = F.when(et == "click", 137).when(et == "view", 88).when(et == "purchase", 445).otherwise(389)
    return e.select(
        F.lit("c0").alias("capture"), "seq", F.col("host").alias("src_ip"), F.lit("0a:00:00:00:00:01").alias("src_mac"),
        F.when(et == "click", 17).otherwise(6).alias("protocol"), F.lit(4000).alias("src_port"), port.alias("dst_port"),
        F.lit(0).alias("payload_at"), F.unhex(data).alias("frame"),
    )


@query
def binary_identity(spark, sf):
    """NetBIOS, Kerberos, NTLM and LDAP messages that carry the names of the view."""
    hosts = idn.host_identity(idn.binary_evidence(name_frames(view(spark, sf, "fx_names"))))
    return hosts.select("host_ip", "hostname", "username", "fullname", F.array_join("sources.text", "; ").alias("sources"))


# ---- labelled flows --------------------------------------------------------------------------------

def labelled(spark, sf):
    return view(spark, sf, "fx_labelled")


@query
def label_clean(spark, sf):
    return lb.clean_labelled_flows(labelled(spark, sf))


@query
def label_distribution(spark, sf):
    return rounded(lb.label_distribution(labelled(spark, sf)), "rate")


@query
def feature_spread(spark, sf):
    return rounded(lb.feature_spread(labelled(spark, sf)), "std", digits=4)


@query
def trimmed_box_stats(spark, sf):
    return rounded(lb.trimmed_box_stats(labelled(spark, sf)), "low", "q1", "median", "q3", "high")


@query
def top_attack_sources(spark, sf):
    return lb.top_attack_sources(labelled(spark, sf))


@query
def top_attack_ports(spark, sf):
    return lb.top_attack_ports(labelled(spark, sf))


@query
def top_protocols(spark, sf):
    return lb.top_protocols(labelled(spark, sf))


# ---- models ------------------------------------------------------------------------------------------

def scored_view(spark, sf):
    return view(spark, sf, "fx_scored")


def voted_flows(spark, sf):
    votes = ensemble_vote_of(scored_view(spark, sf)).select("flow_id", "votes", "predicted", "confidence")
    return flow_table(spark, sf).join(votes, "flow_id")


@query
def ensemble_vote(spark, sf):
    return rounded(ensemble_vote_of(scored_view(spark, sf)), "confidence", digits=4)


@query
def ml_alerts(spark, sf):
    return ml_to_alert(voted_flows(spark, sf).withColumn("raw_features", F.lit("{}")))


@query
def network_events(spark, sf):
    return rounded(network_event_rows(voted_flows(spark, sf)), "duration_ms", digits=3)


@query
def host_events(spark, sf):
    return tb.host_events(auth_event_table(spark, sf)).withColumn("ts", F.unix_micros("ts"))


@query
def scoring_stats(spark, sf):
    return scoring_stats_of(ensemble_vote_of(scored_view(spark, sf)))


@query
def score_calibration(spark, sf):
    return rounded(calibrate(scored_view(spark, sf), "ae_score"), "mean", "std", "threshold")


@query
def classification_report(spark, sf):
    report = metrics.classification_report(ensemble_vote_of(scored_view(spark, sf)))
    return rounded(report, "precision", "recall", "f1")


@query
def roc_auc(spark, sf):
    voted = ensemble_vote_of(scored_view(spark, sf))
    return rounded(metrics.roc_auc(voted, ["if_score", "rf_score", "ae_score", "confidence"]), "auc")


@query
def model_performance(spark, sf):
    report = metrics.classification_report(ensemble_vote_of(scored_view(spark, sf)))
    return rounded(metrics.model_performance(report, "ensemble"), "precision_val", "recall_val", "f1_score", "false_pos_rate")


def training_rows(spark, sf):
    made = lb.labelled_features(lb.clean_labelled_flows(labelled(spark, sf)))
    return materialize(made.withColumn("row_id", F.monotonically_increasing_id()))


@query
def stratified_split(spark, sf):
    train, test = split(training_rows(spark, sf), "binary_label", "row_id")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("binary_label", "part").agg(F.count("*").alias("n"))


def role_rows(spark, sf, flows=None):
    """Flows with the role their first packet has in the packet view: the label follows the features."""
    role = view(spark, sf, "fx_packets").select(
        F.col("seq").alias("flow_id"), F.col("role").isin("scan", "syn", "c2", "dns", "icmp").cast("int").alias("binary_label")
    )
    made = features.flow_features(flow_table(spark, sf) if flows is None else flows)
    return materialize(made.join(role, "flow_id").withColumnRenamed("flow_id", "row_id"))


def score_check(scored: DataFrame, name: str, area: float) -> DataFrame:
    """What must hold for scores of a trained model: rows, range, and an area under the curve above a floor."""
    kept = materialize(scored.select("binary_label", name))
    areas = metrics.roc_auc(kept, [name], "binary_label").select((F.col("auc") >= area).alias("separates"))
    counts = kept.agg(
        F.count("*").alias("rows"), F.count(name).alias("scored"), F.count_if(F.col("binary_label") == 1).alias("attacks"),
        F.min(F.col(name).between(0, 1)).alias("in_range"),
    )
    return counts.join(areas)  # one row each


@query
def isolation_forest_scores(spark, sf):
    rows = role_rows(spark, sf)
    forest = fit_isolation_forest(rows.where("binary_label = 0"), "row_id")
    kept = materialize(forest.score(rows).select("binary_label", "if_score"))
    benign = F.col("binary_label") == 0
    return kept.agg(
        F.count("*").alias("rows"), F.count("if_score").alias("scored"), F.min(F.col("if_score").between(0, 1)).alias("in_range"),
        # the contamination share of the rows it was fitted on lies above a half
        (F.count_if(benign & (F.col("if_score") > 0.5)) <= 0.05 * F.count_if(benign) + 1).alias("flags_few"),
    )


@query
def isolation_forest_fixed(spark, sf):
    """Row-exact: two trees over the packets and bytes of a flow."""
    nodes = pd.DataFrame(FIXED_TREES, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])
    forest = IsolationForest(["total_packets", "total_bytes"], [2.0, 500.0], [1.5, 800.0], nodes, 16, -0.45)
    scored = forest.score(features.flow_features(flow_table(spark, sf)))
    return scored.select("flow_id", F.round("if_score", 6).alias("if_score"))


# tree, node, feature (-1: leaf), threshold, left, right, path length
FIXED_TREES = [
    (0, 0, 0, 0.5, 1, 2, 0.0), (0, 1, -1, 0.0, 1, 1, 4.0), (0, 2, 1, 1.0, 3, 4, 0.0), (0, 3, -1, 0.0, 3, 3, 3.0), (0, 4, -1, 0.0, 4, 4, 2.0),
    (1, 0, 1, 0.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 5.0), (1, 2, -1, 0.0, 2, 2, 1.5),
]


@query
def random_forest_scores(spark, sf):
    rows = role_rows(spark, sf)
    return score_check(score_random_forest(fit_random_forest(rows), rows), "rf_score", 0.95)


@query
def feature_importance(spark, sf):
    weights = importance_of(fit_random_forest(role_rows(spark, sf)), spark)
    whole = F.abs(F.sum("importance").over(W.partitionBy()) - 1) < 1e-6  # 24 rows
    return weights.select("feature", (F.col("importance") >= 0).alias("not_negative"), whole.alias("sum_is_one"))


@query
def autoencoder_scores(spark, sf):
    rows = role_rows(spark, sf)
    model = fit_autoencoder(materialize(rows.where("binary_label = 0")))
    return score_check(model.score(rows), "ae_score", 0.6)


@query
def autoencoder_fixed(spark, sf):
    """Row-exact: a network whose weights are zero gives its last bias, here a half."""
    weights = [w * 0 for w in init_weights(len(dims.FEATURES), 0)]
    weights[-1] = weights[-1] + 0.5
    model = Autoencoder(list(dims.FEATURES), [1.0] * 24, [10.0] * 24, weights, 2000.0, 9000.0)
    scored = model.score(features.flow_features(flow_table(spark, sf)))
    return scored.select("flow_id", F.round("ae_score", 6).alias("ae_score"))


@lru_cache(maxsize=2)
def stored_flows(spark, sf):
    """All flows, built once for training and scoring."""
    return materialize(flow_table(spark, sf))


@lru_cache(maxsize=2)
def trained(spark, sf):
    """Models at full size, and the scored test rows; one training serves the queries of a session."""
    models, scored = train(role_rows(spark, sf, stored_flows(spark, sf)), "row_id")
    return models, materialize(scored)


@query
def train_report(spark, sf):
    """Lines of the report with what must hold: the support, and scores in range; good forests and votes."""
    report = evaluate(trained(spark, sf)[1])
    between = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    floor = F.when(F.col("model") == "rf", 0.9).otherwise(0.0)
    return report.select(
        "model", "name", "support", (between("precision") & between("recall") & between("f1")).alias("in_range"),
        (F.col("auc") >= floor).alias("separates"),
    )


def scored_check(scored: DataFrame, *more: Column) -> DataFrame:
    """What must hold for each scored flow."""
    ok = F.lit(True)
    for m in ("if_score", "rf_score", "ae_score", "confidence"):
        ok = ok & F.coalesce(F.col(m).between(0, 1), F.lit(False))
    fits = (F.col("predicted") == (F.col("votes") >= dims.VOTES_NEEDED).cast("int")) & F.col("votes").between(0, 3)
    return scored.select("flow_id", ok.alias("in_range"), fits.alias("vote_fits"), *more)


@query
def score_flows(spark, sf):
    models, _ = trained(spark, sf)
    scored = score_flows_with(stored_flows(spark, sf), models)
    packets_in = F.from_json("raw_features", "total_packets double")["total_packets"].cast("bigint")
    return scored_check(scored, packets_in.alias("packets"))


# ---- streams: the tables replayed in time order -----------------------------------------------------

@query
def stream_flows(spark, sf):
    """All flows of a stream that ends: those it closes by itself, and those that are open at the end."""
    closed = run_to_table(stream_flow_rows(replay(packets(spark, sf), "ts_us", end=True)))
    return rounded(closed, "duration_ms", "byte_rate", "pkt_rate", digits=3)


@query
def stream_sensor_flows(spark, sf):
    """Two sensors with equal addresses in one stream."""
    closed = run_to_table(stream_flow_rows(replay(two_sensors(spark, sf), "ts_us", end=True)))
    return rounded(closed, "duration_ms", "byte_rate", "pkt_rate", digits=3)


@query
def stream_sensor_signatures(spark, sf):
    flows = materialize(fl.build_flows(two_sensors(spark, sf)))
    return run_to_table(sd.stream_signatures(replay(flows, "start_us")))


@query
def stream_process_anomalies_gaps(spark, sf):
    """Scan numbers with holes, scans cut over batches wherever that falls, each closed by an end row."""
    rows = view(spark, sf, "fx_processes").withColumn("scan_no", F.expr("scan_no * 2 + scan_no div 3"))
    ends = rows.select("scan_no", "host").distinct().select("*", F.lit(1).alias("order"))
    rows = rows.withColumn("order", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    cut = rows.withColumn("place", F.col("scan_no") * 1000 + F.coalesce(F.col("pid") * 2, F.lit(999)))
    return run_to_table(sh.stream_process_anomalies(replay(materialize(cut), "place", slices=7), end_rows=True))


@query
def stream_signatures(spark, sf):
    flows = materialize(flow_table(spark, sf))
    return run_to_table(sd.stream_signatures(replay(flows, "start_us")))


@query
def stream_brute_force(spark, sf):
    events = materialize(auth_event_table(spark, sf))
    return run_to_table(sd.stream_brute_force(replay(events, "ts"))).withColumn("ts", F.unix_micros("ts"))


@query
def stream_admitted_alerts(spark, sf):
    return run_to_table(stream_admitted(replay(view(spark, sf, "fx_alerts"), "ts_s"), limit=20))


@query
def stream_process_anomalies(spark, sf):
    return run_to_table(sh.stream_process_anomalies(replay(view(spark, sf, "fx_processes"), "scan_no")))


@query
def stream_traffic_rate(spark, sf):
    return run_to_table(sd.traffic_rate(replay(packets(spark, sf), "ts_us"))).withColumn("start", F.unix_micros("start"))


@query
def stream_scoring(spark, sf):
    models, _ = trained(spark, sf)
    flows, slices, cores = stored_flows(spark, sf), 4, spark.sparkContext.defaultParallelism
    files = -(-files_for(-(-flows.count() // slices)) // cores) * cores  # all cores read a batch
    return scored_check(run_to_table(stream_score(replay(flows, "start_us", slices, files), models)))


@query
def stream_log_brute_force(spark, sf):
    """Log files of three hosts, from text to BRUTE_FORCE rows in one stream."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    lines = log_lines(spark, sf).withColumn("host", F.split("line", r"\s+")[3])
    lines.repartition("host").sortWithinPartitions("host", "line_no").select("host", F.col("line").alias("value")).write.partitionBy(
        "host"
    ).text(folder)
    events = hl.parse_auth_events(stream_auth_log(spark, f"{folder}/*"), year=2024)
    return run_to_table(sd.stream_brute_force(events)).withColumn("ts", F.unix_micros("ts")).drop("line_no")


@query
def stream_log_tail(spark, sf):
    """Three growing logs: the first lines and a piece of one, then the rest of it and all others; each line arrives once."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    folder, out = f"{base}/logs", f"{base}/rows"
    lines = materialize(log_lines(spark, sf).withColumn("host", F.split("line", r"\s+")[3]))
    middle = lines.agg(F.max("line_no")).first()[0] // 2

    def write(first: bool):
        def run(frames):
            system, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            system.create_dir(root)
            opened = {}
            for frame in frames:
                for host, line in zip(frame["host"], frame["line"]):
                    if host not in opened:
                        opened[host] = (system.open_output_stream if first else system.open_append_stream)(f"{root}/{host}.log")
                        opened[host].write(b"" if first else b" left\n")
                    opened[host].write(f"{line}\n".encode())
            for f in opened.values():
                f.write(b"unfinished" if first else b"")
                f.close()
            yield pd.DataFrame({"files": [len(opened)]})

        part = lines.where(F.col("line_no") <= middle) if first else lines.where(F.col("line_no") > middle)
        part.repartition("host").sortWithinPartitions("host", "line_no").mapInPandas(run, "files bigint").agg(F.sum("files")).first()

    write(True)
    writer = tail_auth_log(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/state")
    following = writer.start()
    try:
        following.processAllAvailable()
        write(False)
        following.processAllAvailable()
    finally:
        following.stop()
    return spark.read.parquet(out).select(F.regexp_extract("file", "([^/]+)[.]log$", 1).alias("host"), "line")


@query
def stream_file_integrity(spark, sf):
    """Two scans as micro-batches; each batch is handed over twice, as after a failure, and adds its changes once."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    files = files_for(view(spark, sf, "fx_files").count())
    for which in ("old", "new"):
        written(file_snapshot(spark, sf, which), files, f"{base}/scans")
    scans = spark.readStream.schema(file_snapshot(spark, sf, "old").schema).option("maxFilesPerTrigger", files).parquet(f"{base}/scans")
    sink = sh.file_integrity_sink(f"{base}/baseline", lambda found, batch: found.write.mode("overwrite").parquet(f"{base}/events/batch={batch}"))

    def twice(scan, batch):
        sink(scan, batch)
        sink(scan, batch)

    scans.writeStream.foreachBatch(twice).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/events").drop("batch")


@query
def model_figures(spark, sf):
    """The report of the trained models on held-out rows: precision, recall, F1, support and area under the curve."""
    return evaluate(trained(spark, sf)[1])


@query
def importance_figures(spark, sf):
    """How much each feature counts in the trained forest."""
    return importance_of(trained(spark, sf)[0].random_forest, spark)


@query
def flow_scores(spark, sf):
    """Every flow with its three scores, votes, label and confidence."""
    scored = score_flows_with(stored_flows(spark, sf), trained(spark, sf)[0])
    return scored.select("flow_id", "if_score", "rf_score", "ae_score", "votes", "predicted", "confidence")


@query
def stream_alert_sinks(spark, sf):
    """Alerts to two sinks. One fails half way through every batch it sees for the first time, and the stream is started again; each has all rows once."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    alerts = stream_admitted(replay(view(spark, sf, "fx_alerts"), "ts_s", slices=3), limit=20)
    broke = set()

    def fragile(batch, batch_id):
        first = batch_id not in broke
        broke.add(batch_id)
        tb.batch_sink(f"{base}/second")(batch.where(F.col("id") % 2 == 0) if first else batch, batch_id)
        if first:
            raise RuntimeError("broke off")

    sinks = {"first": tb.batch_sink(f"{base}/first"), "second": fragile}
    with state_store(spark):
        for _ in range(10):
            run = start_alert_sinks(alerts, sinks, f"{base}/state", manifest=f"{base}/manifest", availableNow=True)
            try:
                run.awaitTermination()
                break
            except StreamingQueryException:  # the batch comes again
                pass
    rows = [spark.read.parquet(f"{base}/{name}").drop("batch_id").withColumn("sink", F.lit(name)) for name in sinks]
    return rows[0].unionByName(rows[1])

import struct

import pytest

from flowsentry.operators import capture as cp, identity as idn
from flowsentry.sources import captures as ca

IP4 = lambda s: bytes(int(x) for x in s.split("."))
MACS = bytes.fromhex("0a0000000002") + bytes.fromhex("0a00000000ff")


def ip(src, dst, proto, payload, ttl=64):
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, 0, ttl, proto, 0, IP4(src), IP4(dst)) + payload


def tcp(sport, dport, flags=0x02, body=b"", seq=7, ack=8):
    return struct.pack("!HHIIBBHHH", sport, dport, seq, ack, 0x50, flags, 0, 0, 0) + body


def udp(sport, dport, body=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(body), 0) + body


def eth(packet, kind=0x0800):
    return MACS + struct.pack("!H", kind) + packet


def pcap(frames, order="<", magic=0xA1B2C3D4, link=1, unit=1):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1_700_000_000 + i, (250_000 + i) * unit, len(f), len(f)) + f
    return out


def read(spark, content, name="c1"):
    return ca.parse_captures(spark.createDataFrame([(name, bytearray(content))], "path string, content binary"), batch=2)


FRAMES = [
    eth(ip("10.0.0.1", "8.8.8.8", 6, tcp(1234, 443, 0x12))),
    eth(ip("10.0.0.1", "8.8.8.8", 17, udp(53, 5353, b"x" * 10))),
    eth(ip("10.0.0.1", "8.8.8.8", 1, bytes([8, 3, 0, 0]))),
    eth(b"\x60" + b"\0" * 50, 0x86DD),
    eth(b"\x45" + b"\0" * 50, 0x8100),
    eth(ip("10.0.0.2", "8.8.8.8", 47, b"zz")),
]


@pytest.mark.parametrize("order,magic,unit", [("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000)])
def test_both_byte_orders_and_nanoseconds(spark, order, magic, unit):
    rows = read(spark, pcap(FRAMES, order, magic, unit=unit)).orderBy("record").collect()
    assert [(r.record, r.protocol) for r in rows] == [(0, 6), (1, 17), (2, 1), (5, 47)]
    t = rows[0]
    assert (t.src_ip, t.dst_ip, t.src_port, t.dst_port, t.flags_bits, t.tcp_seq, t.tcp_ack, t.ttl) == ("10.0.0.1", "8.8.8.8", 1234, 443, 0x12, 7, 8, 64)
    assert t.ts_us == 1_700_000_000_250_000 and t.length == 40 and t.src_mac == "0a:00:00:00:00:ff"
    assert (rows[1].src_port, rows[1].dst_port, rows[1].tcp_seq) == (53, 5353, None)
    assert (rows[2].icmp_type, rows[2].icmp_code, rows[2].src_port) == (8, 3, 0)
    assert rows[3].src_port == 0 and bytes(rows[0].frame) == FRAMES[0]


def test_truncated_tail_is_dropped(spark):
    content = pcap(FRAMES[:3])
    assert read(spark, content[:-5]).count() == 2
    assert read(spark, content[:24]).count() == 0 and read(spark, b"").count() == 0


def test_raw_ip_link(spark):
    (row,) = read(spark, pcap([ip("1.1.1.1", "2.2.2.2", 6, tcp(1, 2))], link=101)).collect()
    assert (row.src_ip, row.src_mac, row.ip_at, row.payload_at) == ("1.1.1.1", "", 0, 40)


@pytest.mark.parametrize("content,text", [(b"\x0a\x0d\x0d\x0a" + b"\0" * 40, "pcapng"), (b"nope" * 10, "not a pcap")])
def test_other_formats_are_refused(spark, content, text):
    with pytest.raises(Exception, match=text):
        read(spark, content).collect()


def test_read_folder_and_stream(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.pcap").write_bytes(pcap(FRAMES))
    flat = ca.read_packets(spark, str(tmp_path))
    rows = flat.collect()
    assert len(rows) == 8 and len({r.seq for r in rows}) == 8
    assert {r.flags for r in rows if r.protocol == 6} == {"SA"}
    q = ca.stream_pcap_dir(spark, str(tmp_path)).writeStream.format("memory").queryName("pk").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("pk").count() == 8


PACKET = "seq bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length bigint, flags string"


def packet(i, dport=80, proto=6, flags="S", src="a", sport=1, length=60):
    return (i, i * 1000, src, f"d{i % 6}", sport, dport, proto, length, flags)


def test_packet_rules(spark):
    rows = [packet(1, 4444), packet(2, 21), packet(3, 80), packet(4, 9, 17, "", sport=53, length=2001), packet(5, 53, 17, "", length=2000)]
    found = {r.seq: (r.rule, r.severity) for r in cp.classify_packets(spark.createDataFrame(rows, PACKET)).collect()}
    assert found == {1: ("MALICIOUS_PORT", "CRITICAL"), 2: ("SENSITIVE_ACCESS", "HIGH"), 4: ("DNS_AMPLIFICATION", "HIGH")}


@pytest.mark.parametrize("ports,hit", [(20, False), (21, True)])
def test_capture_scan_threshold(spark, ports, hit):
    df = spark.createDataFrame([packet(i, 1000 + i, flags="A") for i in range(ports)], PACKET)
    assert (cp.capture_port_scan(df).count() == 1) is hit


@pytest.mark.parametrize("syns,hit", [(80, False), (81, True)])
def test_capture_flood_threshold(spark, syns, hit):
    df = spark.createDataFrame([packet(i, flags="SA") for i in range(syns)], PACKET)
    assert (cp.capture_syn_flood(df).count() == 1) is hit


def test_profile_lists_first_targets_and_counts_all(spark):
    df = spark.createDataFrame([packet(i, 4444, flags="A") for i in range(12)], PACKET)
    (row,) = cp.attacker_profiles(cp.all_hits(df)).collect()
    assert (row.hits, row.n_targets, row.targets, row.severity, row.ports) == (12, 6, "d0, d1, d2, d3", "CRITICAL", "4444")
    assert row.description.startswith("C2 port 4444")


# ---- identities ----------------------------------------------------------------------------

def netbios(name):
    return b"".join(bytes([65 + (c >> 4), 65 + (c & 15)]) for c in name.ljust(16).encode())


def ntlm(user, host, domain=""):
    parts, body, at = [], b"", 64
    for text in (domain, user, host):
        raw = text.encode("utf-16-le")
        parts.append(struct.pack("<HHI", len(raw), len(raw), at + len(body)))
        body += raw
    return b"NTLMSSP\0" + struct.pack("<I", 3) + b"\0" * 16 + b"".join(parts) + b"\0" * 12 + body


def dhcp(name=b"WIN-PC", vendor=b"MSFT 5.0", mac=bytes.fromhex("aabbccddeeff"), offered="10.0.0.77"):
    head = bytearray(240)
    head[16:20], head[28:34], head[236:240] = IP4(offered), mac, b"\x63\x82\x53\x63"
    return bytes(head) + b"\0" + bytes([12, len(name)]) + name + bytes([60, len(vendor)]) + vendor + b"\xff"


def evidence(spark, *packets):
    raw = read(spark, pcap([eth(p) for p in packets]))
    return idn.identity_evidence(raw.withColumnRenamed("record", "seq"))


def identity(spark, *packets):
    return {r.host_ip: r for r in idn.host_identity(evidence(spark, *packets)).collect()}


def test_netbios_names():
    assert idn.netbios_name(netbios("WORKSTATION1")) == "WORKSTATION1"
    assert idn.netbios_name(b"short") == ""


def test_dhcp_identity(spark):
    host = identity(spark, ip("0.0.0.0", "255.255.255.255", 17, udp(68, 67, dhcp())))["10.0.0.77"]
    assert (host.ip, host.mac, host.hostname, host.os) == ("10.0.0.77", "AA:BB:CC:DD:EE:FF", "WIN-PC", "MSFT 5.0")


def test_dhcp_clients_without_address_stay_apart(spark):
    def message(mac, name, offered):
        return udp(68, 67, dhcp(name, b"x", bytes.fromhex(mac), offered))

    hosts = identity(
        spark,
        ip("0.0.0.0", "255.255.255.255", 17, message("aabbccddee01", b"ONE", "0.0.0.0")),
        ip("0.0.0.0", "255.255.255.255", 17, message("aabbccddee02", b"TWO", "0.0.0.0")),
        ip("10.0.0.1", "255.255.255.255", 17, message("aabbccddee01", b"ONE", "10.0.0.11")),
    )
    assert "0.0.0.0" not in hosts
    assert (hosts["10.0.0.11"].hostname, hosts["10.0.0.11"].mac) == ("ONE", "AA:BB:CC:DD:EE:01")
    assert (hosts["mac:AA:BB:CC:DD:EE:02"].hostname, hosts["mac:AA:BB:CC:DD:EE:02"].ip) == ("TWO", None)


def test_netbios_identity(spark):
    query = b"\0" * 12 + b"\x20" + netbios("DESKTOP7") + b"\0" * 10
    host = identity(spark, ip("10.0.0.5", "10.0.0.255", 17, udp(137, 137, query)))["10.0.0.5"]
    assert (host.hostname, host.mac) == ("DESKTOP7", "0A:00:00:00:00:FF")


def test_kerberos_skips_service_names(spark):
    body = b"\x1b\x06krbtgt" + b"\x1b\x08jane.doe"
    host = identity(spark, ip("10.0.0.5", "10.0.0.1", 6, tcp(4000, 88, 0x18, body)))["10.0.0.5"]
    assert (host.username, host.fullname) == ("jane.doe", "Jane Doe (inferred from account name)")
    assert host.sources[-1].text == idn.INFERRED


def test_ntlm_identity(spark):
    host = identity(spark, ip("10.0.0.5", "10.0.0.1", 6, tcp(4000, 445, 0x18, b"xx" + ntlm("bob", "PC9", "CORP"))))["10.0.0.5"]
    assert (host.username, host.hostname) == ("bob", "PC9")
    host = identity(spark, ip("10.0.0.5", "10.0.0.1", 6, tcp(4000, 445, 0x18, ntlm("bob", "", "CORP"))))["10.0.0.5"]
    assert host.hostname == "CORP"


def test_ldap_identity(spark):
    body = b"\x30\x20displayName" + bytes([0x31, 0x0A, 0x04, 8]) + b"Jane Doe" + b"sAMAccountName" + bytes([0x04, 5]) + b"jdoey"
    host = identity(spark, ip("10.0.0.1", "10.0.0.5", 6, tcp(389, 4000, 0x18, body)))["10.0.0.1"]
    assert (host.fullname, host.username) == ("Jane Doe", "jdoey")


def test_http_identity_first_value_wins(spark):
    ua = b"GET / HTTP/1.1\r\nUser-Agent: Mozilla (Windows NT 10.0)\r\nAuthorization: Basic dXNlcjE6cHc=\r\n\r\n"
    post = b"POST /login HTTP/1.1\r\n\r\n" + b"pad=" + b"y" * 600 + b"&email=Second@x.org&pw=1"
    late = ip("10.0.0.5", "1.1.1.1", 6, tcp(4000, 80, 0x18, post))
    host = identity(spark, ip("10.0.0.5", "1.1.1.1", 6, tcp(4000, 80, 0x18, ua)), late)["10.0.0.5"]
    assert (host.username, host.os) == ("user1", "Mozilla (Windows NT 10.0)")
    assert identity(spark, late)["10.0.0.5"].username == "second@x.org"


def test_outside_hosts_leave_no_http_evidence(spark):
    ua = b"GET / HTTP/1.1\r\nUser-Agent: Mozilla (Windows NT 10.0)\r\n\r\n"
    assert identity(spark, ip("8.8.8.8", "10.0.0.1", 6, tcp(80, 4000, 0x18, ua))) == {}

"""Captures in ranges: the same records as in one piece, wherever ranges are cut."""

import io
import random
import struct

import pandas as pd
import pytest

from flowsentry.sources import captures as ca
from tests.test_captures import FRAMES, eth, ip, pcap, udp


def big(seed, n=400, order="<", magic=0xA1B2C3D4, unit=1):
    """Frames of many sizes; some carry captures, some runs of what looks like record headers."""
    r = random.Random(seed)
    inner = pcap(FRAMES * 3, order, magic, unit=unit)
    tiny = b"".join(struct.pack(order + "IIII", 1_700_000_000 + k, k, 0, 0) for k in range(60))
    frames = []
    for k in range(n):
        body = r.choice([b"", inner[: r.randrange(len(inner))], tiny, bytes(r.randrange(256) for _ in range(r.randrange(600))), b"\0" * 200])
        frames.append(eth(ip(f"10.0.{k // 200}.{k % 200}", "8.8.8.8", 17, udp(k + 1, 53, body))))
    return pcap(frames, order, magic, unit=unit)


def places(content, order="<"):
    out, at = [], 24
    while at + 16 <= len(content):
        out.append(at)
        at += 16 + struct.unpack(order + "I", content[at + 8 : at + 12])[0]
    return out


@pytest.mark.parametrize("order,magic,unit", [("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000)])
def test_first_record_is_found_from_anywhere(order, magic, unit):
    content = big(3, 120, order, magic, unit)
    starts, units = places(content, order), 1_000_000 * unit
    for at in [*range(24, len(content), 97), *starts, *(s + 1 for s in starts)]:
        want = next((s for s in starts if s >= at), len(content))
        # the longest record is put low, so that chains end before the file does
        assert ca.first_record(io.BytesIO(content), at, len(content), order, units, 1500) == want


@pytest.mark.parametrize("cut", [0, 5])
def test_ranges_equal_one_piece(spark, tmp_path, cut):
    for k in range(2):
        content = big(k, 250 + k)
        (tmp_path / f"{k}.pcap").write_bytes(content[: len(content) - cut])
    (tmp_path / "empty.pcap").write_bytes(b"")
    names = [c for c in ca.read_packets(spark, str(tmp_path)).columns if c != "seq"]
    key = lambda r: (r.seq, *(r[c] for c in names))
    whole = sorted(map(key, ca.read_packets(spark, str(tmp_path)).collect()))
    assert len(whole) == 501 - 2 * (cut > 0) and len({r[0] for r in whole}) == len(whole)
    for split in (1000, 40_000):
        assert sorted(map(key, ca.normalize_packets(ca.read_pcap(spark, str(tmp_path), split=split)).collect())) == whole


def test_stream_ids_tell_files_and_sensors_apart(spark, tmp_path):
    for site in ("north", "south"):
        (tmp_path / site).mkdir()
        for k in range(2):
            (tmp_path / site / f"{k}.pcap").write_bytes(pcap(FRAMES))
    stream = ca.stream_pcap_dir(spark, str(tmp_path / "*"), split=200, sensor_folders=True)
    q = stream.writeStream.format("memory").queryName("by_site").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("by_site").collect()
    assert len(rows) == 16 and len({r.seq for r in rows}) == 16 and {r.sensor for r in rows} == {"north", "south"}


def test_ranges_of_a_task_are_parsed_together(tmp_path):
    head = bytes.fromhex("d4c3b2a1" "02000400" "00000000" "00000000" "ffff0000" "01000000")
    packet = bytes.fromhex("0a00000000020a0000000001" "0800" "4500003c00000000" "4006" "0000" "0a000001" "0a000002" + "00" * 20)
    records = [struct.pack("<IIII", 1_700_000_000 + i, i, len(packet), len(packet)) + packet for i in range(200)]
    path = tmp_path / "x.pcap"
    path.write_bytes(head + b"".join(records))
    size, step = path.stat().st_size, 512
    starts = range(0, size, step)
    rows = pd.DataFrame({"path": str(path), "start": starts, "end": [min(s + step, size) for s in starts], "length": size, "content": None})
    frames = list(ca._parse_ranges(20_000)(iter([rows])))
    assert len(frames) == 1 and len(starts) > 20
    assert frames[0]["at"].tolist() == [24 + i * len(records[0]) for i in range(200)]
    assert frames[0]["ts_us"].tolist() == [(1_700_000_000 + i) * 1_000_000 + i for i in range(200)] and set(frames[0]["path"]) == {str(path)}

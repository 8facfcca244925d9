"""Packet capture files (classic pcap) as a batch or streaming source.

Small captures come as rows. Of larger ones only name and size do, and tasks read them in ranges: a task takes the records
that start in its range, and finds the first of them by its shape (see ``first_record``). Packets leave a task in batches.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.operators.flows import normalize_packets
from flowsentry.plans.ordered import ranked
from flowsentry.sources.logs import open_file

PACKET_SCHEMA = (
    "path string, record bigint, ts_us bigint, src_ip string, dst_ip string, protocol int, length bigint, ttl int, "
    "src_port int, dst_port int, flags_bits int, tcp_seq bigint, tcp_ack bigint, icmp_type int, icmp_code int, "
    "src_mac string, dst_mac string, ip_at int, payload_at int, frame binary"
)
RANGE_SCHEMA = PACKET_SCHEMA + ", at bigint"
#: Captures from this size on are read in ranges of it; bytes read at once; the longest record a search believes in.
RANGE, READ, LONGEST = 64 << 20, 4 << 20, 262_144
_YEARS = 10 * 366 * 86_400

# ---- Fixed values: capture file formats -------------------------------------------
# magic bytes -> (byte order, sub-second units per second)
PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
# link type -> length of the link header before the IP header
LINK_HEADERS = {1: 14, 12: 0, 101: 0, 228: 0}
ETHERTYPE_IPV4 = 0x0800


def _records(content: bytes, order: str):
    """(offset, length, seconds, fraction) of every whole record."""
    head = np.dtype([("sec", order + "u4"), ("sub", order + "u4"), ("size", order + "u4"), ("orig", order + "u4")])
    at, end = 24, len(content)
    while at + 16 <= end:
        h = np.frombuffer(content, head, 1, at)[0]
        size = int(h["size"])
        if at + 16 + size > end:
            return
        yield at + 16, size, int(h["sec"]), int(h["sub"])
        at += 16 + size


def _text(columns, sep: str, form: str) -> list[str]:
    return [sep.join(form % b for b in row) for row in columns.tolist()]


def _parse(path: str, content: bytes, first: int, records: list, link: int, units: int) -> pd.DataFrame:
    """One batch of records -> packet rows; anything but IPv4 is left out."""
    data = np.frombuffer(content, np.uint8)
    at, size, sec, sub = (np.array(c, dtype=np.int64) for c in zip(*records))
    number = first + np.arange(len(at))

    def byte(offset) -> np.ndarray:
        return data[np.minimum(offset, len(data) - 1)].astype(np.int64)

    def word(offset) -> np.ndarray:
        return byte(offset) << 8 | byte(offset + 1)

    ip = at + link
    ok = (size > link + 20) & (byte(ip) >> 4 == 4)
    if link == 14:
        ok &= word(at + 12) == ETHERTYPE_IPV4
    at, size, sec, sub, number, ip = (a[ok] for a in (at, size, sec, sub, number, ip))
    header = (byte(ip) & 15) * 4
    proto, left, up = byte(ip + 9), size - link - header, ip + header
    tcp, udp, icmp = (proto == 6) & (left >= 14), (proto == 17) & (left >= 8), (proto == 1) & (left >= 2)
    ported = tcp | udp
    octets = np.stack([byte(ip + i) for i in range(12, 20)], axis=1) if len(ip) else np.zeros((0, 8), int)
    macs = np.stack([byte(at + i) for i in range(12)], axis=1) if len(ip) else np.zeros((0, 12), int)
    has_mac = link == 14
    payload = np.where(tcp, header + (byte(up + 12) >> 4) * 4, np.where(udp, header + 8, header))

    def only(where, values) -> pd.Series:
        return pd.Series(pd.arrays.IntegerArray(values.astype("i8"), ~where))

    long = lambda offset: word(offset) << 16 | word(offset + 2)
    return pd.DataFrame(
        {
            "path": path,
            "record": number,
            "ts_us": sec * 1_000_000 + sub * 1_000_000 // units,
            "src_ip": _text(octets[:, :4], ".", "%d"),
            "dst_ip": _text(octets[:, 4:], ".", "%d"),
            "protocol": proto,
            "length": word(ip + 2),
            "ttl": byte(ip + 8),
            "src_port": np.where(ported, word(up), 0),
            "dst_port": np.where(ported, word(up + 2), 0),
            "flags_bits": np.where(tcp, byte(up + 13), 0),
            "tcp_seq": only(tcp, long(up + 4)),
            "tcp_ack": only(tcp, long(up + 8)),
            "icmp_type": only(icmp, byte(up)),
            "icmp_code": only(icmp, byte(up + 1)),
            "src_mac": _text(macs[:, 6:], ":", "%02x") if has_mac else "",
            "dst_mac": _text(macs[:, :6], ":", "%02x") if has_mac else "",
            "ip_at": link,
            "payload_at": link + payload,
            "frame": [content[a : a + n] for a, n in zip(at.tolist(), size.tolist())],
        }
    )


def _parse_files(batch: int):
    def run(batches):
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                if content[:4] == PCAPNG_MAGIC:
                    raise ValueError(f"{path}: pcapng is not supported, convert to pcap")
                if len(content) < 24:
                    continue
                if content[:4] not in PCAP_MAGIC:
                    raise ValueError(f"{path}: not a pcap file")
                order, units = PCAP_MAGIC[content[:4]]
                link_type = int(np.frombuffer(content, order + "u4", 1, 20)[0])
                if link_type not in LINK_HEADERS:
                    raise ValueError(f"{path}: link type {link_type} is not supported")
                first, held = 0, []
                for record in _records(content, order):
                    held.append(record)
                    if len(held) == batch:
                        yield _parse(path, content, first, held, LINK_HEADERS[link_type], units)
                        first, held = first + len(held), []
                if held:
                    yield _parse(path, content, first, held, LINK_HEADERS[link_type], units)

    return run


def parse_captures(files: DataFrame, batch: int = 20_000) -> DataFrame:
    """(path, content) -> raw packets with frames."""
    return files.select("path", "content").mapInPandas(_parse_files(batch), PACKET_SCHEMA)


def _header(head: bytes, path: str) -> tuple[str, int, int, int]:
    """Byte order, sub-second units, link header length and longest record of a capture's first 24 bytes."""
    if head[:4] == PCAPNG_MAGIC:
        raise ValueError(f"{path}: pcapng is not supported, convert to pcap")
    if head[:4] not in PCAP_MAGIC:
        raise ValueError(f"{path}: not a pcap file")
    order, units = PCAP_MAGIC[head[:4]]
    snap, link = struct.unpack(order + "II", head[16:24])
    if link not in LINK_HEADERS:
        raise ValueError(f"{path}: link type {link} is not supported")
    return order, units, LINK_HEADERS[link], min(snap or LONGEST, LONGEST)


def first_record(f, start: int, size: int, order: str, units: int, longest: int) -> int:
    """Place of the first record of a capture that starts at ``start`` or behind it; ``size`` if there is none.

    A place can be a record's if what stands there reads as its header: a length up to ``longest`` and no more than the original
    one, a fraction below a second, and a time within ten years of the file's first. Headers must follow each other from there for longer than
    two records can be, or up to the file's end; if the file ends within a record, the place that the most of them follow is taken.

    What looks like records within a packet, as when a capture is sent over the network, ends with its packet or runs on in the records behind it.
    So the search begins one longest record ahead, and the walk from what it finds is back on the records when it comes to ``start``.
    """
    f.seek(24)
    begin = f.read(16)
    if len(begin) < 16:
        return size
    first_time = struct.unpack(order + "I", begin[:4])[0]
    enough = 2 * (longest + 16)
    back = max(24, start - longest - 16)
    f.seek(back)
    data = f.read(start - back + longest + 16 + enough + longest + 16)
    whole = back + len(data) >= size
    if len(data) < 16:
        return size
    b = np.frombuffer(data, "u1").astype("i8")
    word = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24 if order == "<" else b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    n = len(word) - 12
    time, part, held, original = word[:n], word[4 : n + 4], word[8 : n + 8], word[12 : n + 12]
    ok = (held <= longest) & (held <= original) & (part < units) & (np.abs(time - first_time) < _YEARS)
    nexts = np.arange(n) + 16 + held

    def walk(at: int) -> tuple[int, int]:
        """Where the headers from ``at`` on end, and how many there are."""
        steps = 0
        while at < n and ok[at]:
            at, steps = int(nexts[at]), steps + 1
        return at, steps

    found, most = None, 0
    for at in [0] if back == 24 else np.flatnonzero(ok[: longest + 17]).tolist():
        end, steps = walk(at)
        if back == 24 or end - at > enough or whole and end == len(data):
            found = at
            break
        if whole and end >= n and steps > most:
            found, most = at, steps
    while found is not None and found < n and ok[found] and back + found < start:
        found = int(nexts[found])
    return size if found is None or back + found < start else min(size, back + found)


def _parse_ranges(batch: int):
    def records(f, at: int, end: int, order: str) -> Iterator[tuple[int, bytes, list]]:
        """(place of the block, block, records in it) of the records that start in [at, end)."""
        head = struct.Struct(order + "IIII")
        f.seek(at)
        base, data = at, b""
        while base < end:
            piece = f.read(READ)
            data += piece
            found, here = [], 0
            while here + 16 <= len(data) and base + here < end:
                sec, sub, size, _ = head.unpack_from(data, here)
                if here + 16 + size > len(data):
                    break
                found.append((here + 16, size, sec, sub))
                here += 16 + size
            if found:
                yield base, data, found
            if not piece:
                return
            base, data = base + here, data[here:]

    def packets(held: list, link: int, units: int) -> pd.DataFrame:
        """Rows of the records of several ranges together."""
        found, moved = [], 0
        for _, _, data, part in held:
            found += [(here + moved, *rest) for here, *rest in part]
            moved += len(data)
        rows = _parse("", b"".join(data for _, _, data, _ in held), 0, found, link, units)
        number = rows["record"].to_numpy("i8")
        counts = [len(part) for *_, part in held]
        paths = np.repeat(np.array([path for path, *_ in held], object), counts)
        places = np.concatenate([np.array([base - 16 + r[0] for r in part], "i8") for _, base, _, part in held])
        return rows.assign(path=paths[number], at=places[number], record=pd.array([None] * len(rows), "Int64"))

    def run(frames):
        held, form = [], None  # (path, place, bytes, records in them), and how they are read
        for files in frames:
            for path, start, end, size, content in zip(*(files[c] for c in ("path", "start", "end", "length", "content"))):
                with io.BytesIO(content) if content is not None else open_file(path) as f:
                    head = f.read(24)
                    if len(head) < 24:
                        continue
                    order, units, link, longest = _header(head, path)
                    if held and form != (link, units):
                        yield packets(held, *form)
                        held = []
                    form = link, units
                    at = 24 if start == 0 else first_record(f, int(start), int(size), order, units, longest)
                    for base, data, found in records(f, at, int(end), order):
                        for i in range(0, len(found), batch):
                            part = found[i : i + batch]
                            low, high = part[0][0] - 16, part[-1][0] + part[-1][1]
                            held.append((path, base + low, data[low:high], [(r[0] - low, *r[1:]) for r in part]))
                            if sum(len(h[3]) for h in held) >= batch or sum(len(h[2]) for h in held) >= READ:
                                yield packets(held, *form)
                                held = []
        if held:
            yield packets(held, *form)

    return run


def _packets_of(files: DataFrame, split: int, batch: int) -> DataFrame:
    """Raw packets of (path, length, content) rows, in ranges where ``length`` is ``split`` or more; ``at`` is a record's place in its file."""
    whole = files.where(F.col("length") < split).select("path", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), "length", "content")
    starts = files.where(F.col("length") >= split).select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split).cast("bigint"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + split, "length").alias("end"), "length", F.lit(None).cast("binary").alias("content"))
    # a number of parts, since the ranges' rows are so few bytes that adaptive execution would put them into one task
    parts = 4 * files.sparkSession.sparkContext.defaultParallelism
    return whole.unionByName(ranges.repartition(parts, "path", "start")).mapInPandas(_parse_ranges(batch), RANGE_SCHEMA)


def read_pcap(spark: SparkSession, path: str, split: int = RANGE, batch: int = 20_000) -> DataFrame:
    """Raw packets of all captures under ``path``, of any size.

    ``seq`` is unique over all of them and rises with the place in a file: the file's number, by path, and the sixteenth of the record's
    place, which no two records share. Captures of ``split`` bytes or more are opened by the tasks, through Arrow.
    """
    files = spark.read.format("binaryFile").load(path)
    names = ranked(files.select(F.lit(0).alias("all"), "path"), ["all"], ["path"], "file_no").drop("all")
    packets = _packets_of(files, split, batch).join(names, "path")
    return packets.withColumn("seq", F.shiftleft(F.col("file_no").cast("bigint"), 36).bitwiseOR(F.shiftright("at", 4))).drop("at", "file_no")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Flat packets, ready for flows and capture analysis."""
    return normalize_packets(read_pcap(spark, path))


def stream_pcap_dir(spark: SparkSession, path: str, files_per_trigger: int = 8, split: int = RANGE, sensor_folders: bool = False) -> DataFrame:
    """Packets of captures as they are dropped into ``path``.

    ``seq`` is made of 31 bits of a hash of the file's path and the sixteenth of the record's place, so that ids of different files do not meet and
    captures may have 64 GB. ``sensor_folders``: each sensor drops into a folder of its own, whose name becomes the column ``sensor``.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    number = F.shiftleft(F.xxhash64("path").bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(F.shiftright("at", 4))
    packets = _packets_of(files, split, 20_000).withColumn("seq", number)
    return normalize_packets(packets.withColumn("sensor", F.element_at(F.split("path", "/"), -2)) if sensor_folders else packets)

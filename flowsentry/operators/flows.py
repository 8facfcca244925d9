"""Packets to flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowsentry import dims
from flowsentry.functions.net import flag_bits, flag_letters
from flowsentry.plans.ordered import ordered

FLOW_KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
SENSOR = "sensor"
CLOSING_BITS = 0x01 | 0x04  # FIN, RST


def sensor_of(df: DataFrame) -> list[str]:
    """The sensor (or capture) column, if there is one: what two sensors see never meets in one flow, window or count."""
    return [SENSOR] if SENSOR in df.columns else []


def normalize_packets(raw: DataFrame) -> DataFrame:
    """Flat packets: port 0 where there is none, flag letters, ICMP fields only for ICMP; a sensor column stays.

    ``raw`` has seq, ts_us, src_ip, dst_ip, protocol, length, ttl, src_port, dst_port,
    flags_bits, tcp_seq, tcp_ack, icmp_type, icmp_code; rows without addresses are not IP.
    """
    proto = F.col("protocol")
    ported = proto.isin(6, 17)
    return raw.where("src_ip is not null and dst_ip is not null").select(
        *sensor_of(raw),
        "seq",
        "ts_us",
        "src_ip",
        "dst_ip",
        proto,
        "length",
        "ttl",
        F.when(ported, F.coalesce("src_port", F.lit(0))).otherwise(0).alias("src_port"),
        F.when(ported, F.coalesce("dst_port", F.lit(0))).otherwise(0).alias("dst_port"),
        F.when(proto == 6, flag_letters(F.coalesce("flags_bits", F.lit(0)))).otherwise("").alias("flags"),
        F.when(proto == 6, F.coalesce("tcp_seq", F.lit(0))).otherwise(0).alias("tcp_seq"),
        F.when(proto == 6, F.coalesce("tcp_ack", F.lit(0))).otherwise(0).alias("tcp_ack"),
        F.when(proto == 1, F.col("icmp_type")).alias("icmp_type"),
        F.when(proto == 1, F.col("icmp_code")).alias("icmp_code"),
    )


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Adds the direction-free endpoint pair and whether the packet goes low -> high."""
    a, b = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(
        F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")
    )
    low_first = a <= b
    return packets.select(
        *sensor_of(packets),
        F.when(low_first, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("lo_ip"),
        F.when(low_first, F.col("src_port")).otherwise(F.col("dst_port")).cast("int").alias("lo_port"),
        F.when(low_first, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("hi_ip"),
        F.when(low_first, F.col("dst_port")).otherwise(F.col("src_port")).cast("int").alias("hi_port"),
        F.col("protocol").cast("int").alias("protocol"),
        "ts_us",
        "seq",
        low_first.alias("low_first"),
        F.col("length").cast("long").alias("length"),
        flag_bits(F.col("flags")).alias("bits"),
    )


def per_second(amount: Column, duration_ms: Column) -> Column:
    return amount / (duration_ms / 1000 + F.lit(1e-9))


def flow_columns(close_reason: Column, sensor: list[str] = ()) -> list[Column]:
    """Final flow columns from the per-flow aggregates (shared with the stream form)."""
    bits, forward = F.col("bits"), F.col("forward_low")
    duration = F.greatest((F.col("end_us") - F.col("start_us")) / 1000, F.lit(0.001))
    total_packets, total_bytes = F.col("low_packets") + F.col("high_packets"), F.col("low_bytes") + F.col("high_bytes")

    def side(low: str, high: str) -> Column:
        return F.when(forward, F.col(low)).otherwise(F.col(high))

    return [
        *map(F.col, sensor),
        F.col("first_seq").alias("flow_id"),
        side("lo_ip", "hi_ip").alias("src_ip"),
        side("hi_ip", "lo_ip").alias("dst_ip"),
        side("lo_port", "hi_port").alias("src_port"),
        side("hi_port", "lo_port").alias("dst_port"),
        F.col("protocol"),
        F.col("start_us"),
        F.col("end_us"),
        duration.alias("duration_ms"),
        side("low_packets", "high_packets").alias("fwd_packets"),
        side("high_packets", "low_packets").alias("bwd_packets"),
        total_packets.alias("total_packets"),
        side("low_bytes", "high_bytes").alias("fwd_bytes"),
        side("high_bytes", "low_bytes").alias("bwd_bytes"),
        total_bytes.alias("total_bytes"),
        flag_letters(bits, "".join(sorted(dims.TCP_FLAGS))).alias("flags"),
        (bits.bitwiseAND(F.lit(0x02)) != 0).alias("has_syn"),
        (bits.bitwiseAND(F.lit(0x01)) != 0).alias("has_fin"),
        (bits.bitwiseAND(F.lit(0x04)) != 0).alias("has_rst"),
        per_second(total_bytes, duration).alias("byte_rate"),
        per_second(total_packets, duration).alias("pkt_rate"),
        close_reason.alias("close_reason"),
    ]


def build_flows(
    packets: DataFrame,
    idle_seconds: int = 60,
    max_packets: int = 1000,
    as_of_us: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Bidirectional flows; a flow ends on FIN/RST, at ``max_packets``, or after an idle gap.

    Whether a packet opens a new flow depends only on the packet before it in the same
    conversation, so the whole job is one sort by (conversation, time) and running values
    over it.  Packets of one conversation may span many chunks.  A flow is named by its
    conversation, the row number that opened it, and the part the packet cap cuts off.
    """
    idle_us = idle_seconds * 1_000_000
    keys = [*sensor_of(packets), *FLOW_KEY]
    cut = ordered(with_flow_key(packets), keys, ["ts_us", "seq"], chunks)
    if as_of_us is None:
        as_of_us = cut.rows.agg(F.max("ts_us")).first()[0] or 0
    def ends_before(prev_us: Column, prev_bits: Column, now_us: Column) -> Column:
        return (prev_bits.bitwiseAND(F.lit(CLOSING_BITS)) != 0) | (now_us - prev_us > idle_us)

    # Inside a chunk: row number per conversation and the last row that opened a flow.
    seen = cut.inside

    def with_opens(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {"prev_us": F.lag("ts_us").over(seen), "prev_bits": F.lag("bits").over(seen), "row": F.row_number().over(seen)}
        ).withColumn(
            "opens", F.when(ends_before(F.col("prev_us"), F.col("prev_bits"), F.col("ts_us")), F.col("row"))
        )

    local = with_opens(cut.rows).withColumn("open_here", F.max("opens").over(cut.upto))
    # Across chunks: rows before, whether the chunk's first row opens, last opening row before.
    spans = cut.totals(
        with_opens(cut.crossing),
        [
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.max_by("bits", "_pos").alias("last_bits"),
            F.count("*").alias("n"),
            F.max("opens").alias("last_open"),
        ],
    )
    key_order = W.partitionBy(*keys).orderBy("_chunk")
    before, prev_us = F.coalesce(F.sum("n").over(cut.earlier), F.lit(0)), F.lag("last_us").over(key_order)
    first_opens = prev_us.isNull() | ends_before(prev_us, F.lag("last_bits").over(key_order), F.col("first_us"))
    carry = (
        spans.withColumns({"before": before, "first_opens": first_opens})
        .withColumn(
            "open_row",
            F.coalesce(F.col("before") + F.col("last_open"), F.when(F.col("first_opens"), F.col("before") + 1)),
        )
        .select("_chunk", *keys, "before", "first_opens", F.max("open_row").over(cut.earlier).alias("open_before"))
    )
    rows_before = F.coalesce("before", F.lit(0))
    placed = cut.join_carry(local, carry).withColumns(
        {
            "at": F.col("row") + rows_before,
            "opened_at": F.coalesce(
                F.col("open_here") + rows_before,
                F.when(F.coalesce("first_opens", F.lit(True)), rows_before + 1),
                F.col("open_before"),
            ),
        }
    )
    placed = placed.withColumn("part", F.floor((F.col("at") - F.col("opened_at")) / max_packets))
    low = F.col("low_first")
    flows = placed.groupBy(*keys, "opened_at", "part").agg(
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.min_by("seq", "_pos").alias("first_seq"),
        F.min_by("low_first", "_pos").alias("forward_low"),
        F.count_if(low).alias("low_packets"),
        F.count_if(~low).alias("high_packets"),
        F.coalesce(F.sum(F.when(low, F.col("length"))), F.lit(0)).alias("low_bytes"),
        F.coalesce(F.sum(F.when(~low, F.col("length"))), F.lit(0)).alias("high_bytes"),
        F.bit_or("bits").alias("bits"),
    )
    reason = (
        F.when(F.col("bits").bitwiseAND(F.lit(CLOSING_BITS)) != 0, "fin_rst")
        .when(F.col("low_packets") + F.col("high_packets") >= max_packets, "cap")
        .when(F.lit(as_of_us) - F.col("end_us") > idle_us, "idle")
        .otherwise("open")
    )
    return flows.select(*flow_columns(reason, sensor_of(packets)))


def unidirectional_flows(packets: DataFrame) -> DataFrame:
    """One row per directed 5-tuple (and sensor): packets, bytes, SYN packets, first and last time."""
    syn = (F.col("protocol") == 6) & F.col("flags").contains("S")
    return packets.groupBy(*sensor_of(packets), "src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(
        F.count("*").alias("pkts"),
        F.sum("length").alias("bytes"),
        F.count_if(syn).alias("syns"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
    )

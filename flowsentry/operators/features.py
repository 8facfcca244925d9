"""Flow -> 24 numeric features, one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsentry import dims
from flowsentry.functions.net import is_ephemeral, is_registered, is_well_known


def feature_columns() -> dict[str, Column]:
    def at_least(name: str, floor: float) -> Column:
        return F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(float(floor)))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    duration, packets, size = at_least("duration_ms", 0.001), at_least("total_packets", 1), at_least("total_bytes", 0)
    pkt_rate, byte_rate = at_least("pkt_rate", 0.001), at_least("byte_rate", 0.001)
    src, dst, proto = [F.coalesce(F.col(c), F.lit(0)) for c in ("src_port", "dst_port", "protocol")]
    return {
        "duration_ms": duration,
        "total_packets": packets,
        "total_bytes": size,
        "fwd_packets": number("fwd_packets"),
        "bwd_packets": number("bwd_packets"),
        "fwd_bytes": number("fwd_bytes"),
        "bwd_bytes": number("bwd_bytes"),
        "pkt_rate": pkt_rate,
        "byte_rate": byte_rate,
        "fwd_bwd_ratio": number("fwd_packets") / F.greatest(number("bwd_packets"), F.lit(1.0)),
        "avg_pkt_size": size / packets,
        "has_syn": flag(F.col("has_syn")),
        "has_fin": flag(F.col("has_fin")),
        "has_rst": flag(F.col("has_rst")),
        "dst_port_well_known": flag(is_well_known(dst)),
        "dst_port_registered": flag(is_registered(dst)),
        "dst_port_ephemeral": flag(is_ephemeral(dst)),
        "src_port_privileged": flag(is_well_known(src)),
        "is_tcp": flag(proto == 6),
        "is_udp": flag(proto == 17),
        "is_icmp": flag(proto == 1),
        "log_total_bytes": F.log1p(size),
        "log_pkt_rate": F.log1p(pkt_rate),
        "log_byte_rate": F.log1p(byte_rate),
    }


def flow_features(flows: DataFrame, keep: list[str] = ("flow_id",)) -> DataFrame:
    """The feature vector as 24 FLOAT columns in fixed order, next to the kept columns."""
    made = feature_columns()
    return flows.select(*keep, *[made[n].cast("float").alias(n) for n in dims.FEATURES])


def features_json(features: DataFrame, name: str = "raw_features") -> DataFrame:
    """Adds the features as one JSON text."""
    return features.withColumn(name, F.to_json(F.struct(*dims.FEATURES)))

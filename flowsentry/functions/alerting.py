"""Column functions over alerts: severity, fingerprint, texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowsentry import dims
from flowsentry.functions.net import lookup

FINGERPRINT_FIELDS = ["alert_type", "src_ip", "dst_ip", "dst_port"]


def severity_rank(severity: Column) -> Column:
    return lookup(severity, dims.SEVERITY_RANK, 0)


def severity_of_rank(rank: Column) -> Column:
    return lookup(rank, {r: s for s, r in dims.SEVERITY_RANK.items()})


def severity_at_least(severity: Column, minimum: str) -> Column:
    return severity_rank(severity) >= dims.SEVERITY_RANK.get(minimum, 0)


def severity_from_confidence(confidence: Column) -> Column:
    out = F.when(F.lit(False), "")
    for floor, severity in dims.CONFIDENCE_BANDS:
        out = out.when(confidence >= floor, severity)
    return out.otherwise("LOW")


def alert_fingerprint(description: str = "description") -> Column:
    """md5 over type, endpoints and the start of the description; NULL counts as ""."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FINGERPRINT_FIELDS]
    head = F.coalesce(F.substring(F.col(description), 1, 50), F.lit(""))
    return F.md5(F.concat_ws("|", *parts, head))


def percent(share: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)

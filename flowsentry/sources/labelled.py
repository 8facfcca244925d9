"""Labelled flow tables in CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# ---- Fixed values: names of the usual flow columns -> names used here -----------------
KNOWN_COLUMNS = {
    "Label": "label",
    "Total Fwd Packets": "fwd_packets",
    "Total Backward Packets": "bwd_packets",
    "Total Length of Fwd Packets": "fwd_bytes",
    "Total Length of Bwd Packets": "bwd_bytes",
    "Flow Duration": "flow_duration_us",
    "Flow Bytes/s": "flow_bytes_s",
    "Flow Packets/s": "flow_packets_s",
    "Destination Port": "dst_port",
}


def read_labelled_flows(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of ``folder``: headers trimmed, missing columns NULL.

    Files are read in groups of equal header, so one odd file does not shift columns.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    paths = [r["path"] for r in listing.select("path").collect()]  # file names only
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder}")
    groups: dict[str, list[str]] = {}
    for path in paths:
        header = spark.read.text(path).first()
        groups.setdefault(header["value"] if header else "", []).append(path)
    parts = []
    for files in groups.values():
        part = spark.read.option("header", True).option("inferSchema", True).csv(files)
        parts.append(part.toDF(*[c.strip() for c in part.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def discover_flow_columns(df: DataFrame) -> dict[str, str]:
    """Role -> first column whose lower-case name fits: label, src_ip, dst_ip, dst_port, protocol."""

    def first(fits) -> str | None:
        return next((c for c in df.columns if fits(c.strip().lower())), None)

    found = {
        "label": first(lambda c: c == "label"),
        "src_ip": first(lambda c: "src" in c and "ip" in c),
        "dst_ip": first(lambda c: "dst" in c and "ip" in c),
        "dst_port": first(lambda c: "dst" in c and "port" in c),
        "protocol": first(lambda c: "protocol" in c),
    }
    return {role: column for role, column in found.items() if column is not None}


def with_flow_names(df: DataFrame) -> DataFrame:
    """Renames discovered and known columns to the names the operators use."""
    roles = {c: r for r, c in discover_flow_columns(df).items()}
    named = df.withColumnsRenamed(roles)
    return named.withColumnsRenamed({a: b for a, b in KNOWN_COLUMNS.items() if a in named.columns and b not in named.columns})

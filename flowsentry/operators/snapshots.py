"""File-hash and process snapshots: differences and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowsentry import dims
from flowsentry.functions.net import once


def hash_files(files: DataFrame, content: str = "content") -> DataFrame:
    """(host, path, content) -> (host, path, sha256)."""
    return files.select("host", "path", F.sha2(F.col(content), 256).alias("sha256"))


def is_critical_path(path: Column) -> Column:
    out = F.lit(False)
    for prefix in dims.CRITICAL_PATHS:
        out = out | path.startswith(prefix)
    return out


def diff_file_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """DELETED, MODIFIED and CREATED files between two (host, path, sha256) snapshots."""
    o = old.select("host", "path", F.col("sha256").alias("old_hash"), F.lit(True).alias("was"))
    n = new.select("host", "path", F.col("sha256").alias("new_hash"), F.lit(True).alias("exists"))
    change = (
        F.when(F.col("exists").isNull(), "DELETED")
        .when(F.col("was").isNull(), "CREATED")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "MODIFIED")
    )
    high = (F.col("event_type") == "DELETED") | ((F.col("event_type") == "MODIFIED") & is_critical_path(F.col("path")))
    return (
        o.join(n, ["host", "path"], "full_outer")
        .withColumn("event_type", change)
        .where("event_type is not null")
        .select(
            "host",
            "event_type",
            F.col("path").alias("file_path"),
            "old_hash",
            "new_hash",
            F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"),
            F.concat(F.col("event_type"), F.lit(": "), F.col("path")).alias("description"),
        )
    )


def normalize_processes(raw: DataFrame) -> DataFrame:
    """Lower-case name, missing parent 0, command line joined by spaces and cut to 200."""
    args = F.col("cmdline")
    joined = F.array_join(args, " ") if dict(raw.dtypes)["cmdline"].startswith("array") else args
    return raw.withColumns(
        {
            "name": F.lower(F.coalesce("name", F.lit(""))),
            "ppid": F.coalesce("ppid", F.lit(0)),
            "cmdline": F.substring(F.coalesce(joined, F.lit("")), 1, 200),
        }
    )


def new_processes(snapshots: DataFrame) -> DataFrame:
    """Processes whose pid the host's scan before this one did not have, whatever the scans' numbers.

    ``snapshots`` is unique on (scan_no, host, pid).  A host's first scan is a baseline and
    yields nothing.  The window sees one row per scan; joins are on (scan, host[, pid]), so a
    busy host spreads over its scans.
    """
    scans = snapshots.select("host", "scan_no").distinct()
    last = F.lag("scan_no").over(W.partitionBy("host").orderBy("scan_no"))
    follows = scans.select("host", "scan_no", last.alias("last_scan")).where("last_scan is not null")
    before = snapshots.select(F.col("scan_no").alias("last_scan"), "host", "pid")
    return (
        snapshots.join(follows, ["scan_no", "host"]).join(before, ["last_scan", "host", "pid"], "left_anti").drop("last_scan")
    )


def with_parent(processes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds the parent's name from the same scan, "" if it is gone."""
    parents = snapshots.select("scan_no", "host", F.col("pid").alias("ppid"), F.col("name").alias("parent_name"))
    return processes.join(parents, ["scan_no", "host", "ppid"], "left").withColumn(
        "parent_name", F.coalesce("parent_name", F.lit(""))
    )


def process_checks(processes: DataFrame) -> DataFrame:
    """The three ordered checks; every finding is CRITICAL."""
    name, parent, cmd, pid = F.col("name"), F.col("parent_name"), F.col("cmdline"), F.col("pid").cast("string")
    shell = name.isin(*dims.SHELLS)
    marks = F.lit(False)
    for mark in dims.REVERSE_SHELL_MARKS:
        marks = marks | cmd.contains(mark)

    def found(event: str, text: Column) -> Column:
        return F.struct(F.lit(event).alias("event_type"), text.alias("description"))

    finding = (
        F.when(
            name.isin(*dims.SUSPICIOUS_NAMES),
            found("SUSPICIOUS_PROCESS", F.concat(F.lit("Known suspicious tool: "), name, F.lit(" (pid="), pid, F.lit(")"))),
        )
        .when(
            parent.isin(*dims.WEB_PARENTS) & shell,
            found(
                "SUSPICIOUS_SPAWN",
                F.concat(
                    F.lit("Shell '"), name, F.lit("' spawned by web process '"), parent,
                    F.lit("' — possible RCE (pid="), pid, F.lit(")"),
                ),
            ),
        )
        .when(shell & marks, found("SUSPICIOUS_SPAWN", F.concat(F.lit("Potential reverse shell: "), F.substring(cmd, 1, 80))))
    )
    return processes.select(
        "scan_no", "host", "pid", F.col("name").alias("process_name"), F.col("ppid").alias("parent_pid"),
        "parent_name", "cmdline", once(finding), F.lit("CRITICAL").alias("severity"),
    ).where("event_type is not null")


def process_anomalies(snapshots: DataFrame) -> DataFrame:
    """New suspicious processes of every scan after the first."""
    clean = normalize_processes(snapshots)
    return process_checks(with_parent(new_processes(clean), clean))

"""File trees and their stored baselines."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.operators.snapshots import diff_file_snapshots, hash_files


#: Files from this size on are hashed in pieces; a row holds less than 2 GB.
WHOLE_FILE = 256 << 20


def _hash_in_pieces(frames):
    """SHA-256 of files of any size, read 8 MB at a time."""
    for rows in frames:
        digests = []
        for path in rows["path"]:
            system, name = FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as f:
                while piece := f.read(8 << 20):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield rows.assign(sha256=digests)[["host", "path", "sha256"]]


def scan_file_hashes(spark: SparkSession, roots: list[str], host: str, whole_file: int = WHOLE_FILE) -> DataFrame:
    """SHA-256 of every file below ``roots``; missing roots are skipped.

    The file source packs files into tasks by size.  Files below ``whole_file`` bytes are read as rows;
    of larger ones only the path, and their bytes are streamed.
    """
    found = []
    for root in roots:
        try:
            found.append(
                spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
            )
        except AnalysisException:
            continue
    if not found:
        return spark.createDataFrame([], "host string, path string, sha256 string")
    files = reduce(DataFrame.unionByName, found).withColumn("host", F.lit(host))
    small = hash_files(files.where(F.col("length") < whole_file))
    large = files.where(F.col("length") >= whole_file).select("host", F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    hashed = small.unionByName(large.mapInPandas(_hash_in_pieces, "host string, path string, sha256 string"))
    return hashed.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def save_baseline(snapshot: DataFrame, table: str, scan_id: int) -> None:
    """Adds a scan; scans are partitions, so older ones stay readable."""
    snapshot.write.mode("overwrite").parquet(f"{table}/scan_id={scan_id:012d}")


def latest_scan(spark: SparkSession, table: str) -> int | None:
    try:
        row = spark.read.parquet(table).agg(F.max("scan_id")).first()
    except AnalysisException:
        return None
    return None if row[0] is None else int(row[0])


def load_baseline(spark: SparkSession, table: str, scan_id: int | None = None) -> DataFrame | None:
    """The given or the latest scan; None if there is none yet."""
    scan = latest_scan(spark, table) if scan_id is None else scan_id
    if scan is None:
        return None
    return spark.read.parquet(f"{table}/scan_id={scan:012d}")


def _hosts_table(table: str) -> str:
    return f"{table.rstrip('/')}_hosts"


def last_scans(spark: SparkSession, table: str, scan_id: int) -> DataFrame | None:
    """(host, scan_id) of each host's last stored scan before ``scan_id``: one version of the host index; None if there is none yet."""
    try:
        versions = spark.read.parquet(_hosts_table(table))
    except AnalysisException:
        return None
    version = versions.where(F.col("version") < scan_id).agg(F.max("version")).first()[0]
    return None if version is None else spark.read.parquet(f"{_hosts_table(table)}/version={version:012d}")


def index_hosts(spark: SparkSession, table: str, scan_id: int) -> None:
    """Writes the version of the host index that has this scan: the one before it, with the scan's hosts moved on."""
    hosts = load_baseline(spark, table, scan_id).select("host").distinct().withColumn("scan_id", F.lit(scan_id).cast("bigint"))
    before = last_scans(spark, table, scan_id)
    rows = hosts if before is None else hosts.unionByName(before.join(hosts, "host", "left_anti"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{_hosts_table(table)}/version={scan_id:012d}")


def changes_of_scan(spark: SparkSession, table: str, scan_id: int) -> DataFrame:
    """Changes in a stored scan against the last stored scan of each of its hosts.

    Hosts that the scan does not cover have no changes, nor has a host's first scan. The host index tells which scans those are, and only
    they are read: one, where all hosts are scanned together.
    """
    now = load_baseline(spark, table, scan_id)
    hosts = now.select("host").distinct()
    index = last_scans(spark, table, scan_id)
    if index is None:
        last = hosts.withColumn("scan_id", F.lit(None).cast("bigint")).limit(0)
        return diff_file_snapshots(now.limit(0), now.join(last, "host", "left_semi"))
    last = index.join(hosts, "host", "left_semi")
    scans = sorted(r[0] for r in last.select("scan_id").distinct().collect())  # scans, not hosts or files
    earlier = spark.read.option("basePath", table).parquet(*[f"{table}/scan_id={n:012d}" for n in scans]) if scans else now.limit(0).withColumn("scan_id", F.lit(scan_id))
    return diff_file_snapshots(earlier.join(last, ["host", "scan_id"], "left_semi"), now.join(last, "host", "left_semi"))


def check_files(current: DataFrame, table: str, scan_id: int | None = None) -> DataFrame:
    """Stores ``current`` as a scan and returns its changes.

    With a ``scan_id`` (say, a stream's batch id) a repeated call stores the same scan again and
    finds the same changes, so a consumer that failed can ask once more.
    """
    spark = current.sparkSession
    if scan_id is None:
        last = latest_scan(spark, table)
        scan_id = 0 if last is None else last + 1
    save_baseline(current, table, scan_id)
    index_hosts(spark, table, scan_id)
    return changes_of_scan(spark, table, scan_id)

"""Log files as lines."""

from __future__ import annotations

import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Files below so many bytes are read as rows, larger ones in ranges of them; bytes it reads at once, and bytes of lines after which it hands over a batch.
RANGE, READ, OUT_BYTES = 64 << 20, 1 << 20, 4 << 20


def read_auth_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines trimmed; line_no orders the lines of a file and is unique over all."""
    return spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("line")
    )


def lines_from(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line) of the lines of an open file that start in [start, end); the last may end behind it."""
    at = max(0, start - 1)
    f.seek(at)
    held = bytearray()
    skip = start > 0  # the rest of a line of the range before, perhaps only its line feed
    while at < end:
        piece = f.read(READ)
        held += piece
        begin = 0
        while at < end and (stop := held.find(b"\n", begin)) >= 0:
            if not skip:
                yield at, bytes(held[begin:stop])
            skip = False
            at += stop + 1 - begin
            begin = stop + 1
        del held[:begin]
        if not piece:
            if held and not skip and at < end:
                yield at, bytes(held)
            return
        if skip:
            at += len(held)
            held.clear()


def _read_lines(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start, end, content) to rows (file, at, text); without content the file is opened. Bad UTF-8 is replaced."""

    def batch(file: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at = pa.array([r[0] for r in rows], pa.int64())
        text = pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), at, text], names=["file", "at", "text"])

    for frame in frames:
        for file, start, end, content in zip(*(c.to_pylist() for c in frame.columns[:3]), frame.column(3)):
            rows, size = [], 0
            with io.BytesIO(content.as_py()) if content.is_valid else open_file(file) as f:
                for row in lines_from(f, start, end):
                    rows.append(row)
                    size += len(row[1]) + 100
                    if size > OUT_BYTES:
                        yield batch(file, rows)
                        rows, size = [], 0
            if rows:
                yield batch(file, rows)


def open_file(path: str):
    """A file of any file system that Arrow knows, as Spark names it."""
    system, name = FileSystem.from_uri(quote(path, safe="/:@[]!$&'()*+,;=~"))
    return system.open_input_file(name)


def stream_auth_log(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """(file, line_no, line) of log files as they are dropped into ``path``; ready for ``parse_auth_events``.

    The file source picks up new files, not bytes appended to old ones, so logs must be
    rolled into the folder (or come from a message queue).  Files below ``RANGE`` bytes come
    as rows; of larger ones only name and size, and tasks read them in ranges of so many bytes, line by line, from a file
    system that Arrow can open on every executor. line_no is the line's byte offset in the file behind 12 bits of the file's
    hash, the same whenever and wherever the file is read; (file, line_no) names a line, and a double holds line_no.
    """
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)
    file = F.regexp_replace("path", "^file:/+", "file:///").alias("file")
    starts = files.where(F.col("length") >= RANGE).select(file, "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(RANGE).cast("bigint"))).alias("start"))
    ranges = starts.select("file", "start", F.least(F.col("start") + RANGE, "length").alias("end"), F.lit(None).cast("binary").alias("content"))
    small = files.where(F.col("length") < RANGE).select(file, F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), "content")
    lines = small.unionByName(ranges.repartition("file", "start")).mapInArrow(_read_lines, "file string, at bigint, text string")
    number = F.shiftleft(F.xxhash64("file").bitwiseAND(F.lit((1 << 12) - 1)), 40).bitwiseOR(F.col("at"))
    return lines.select("file", number.alias("line_no"), F.trim("text").alias("line")).where("line <> ''")

"""Log files that grow, followed as a stream: an offset is how far each file has been read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from flowsentry.sources.logs import RANGE, lines_from

LINE_SCHEMA = "file string, at bigint, text string"
#: Bytes of lines after which a task hands over a batch, and bytes looked at for a line's end at once.
OUT_BYTES, STEP = 8 << 20, 64 << 10


class Piece(InputPartition):
    """The lines of a file that start in [start, end)."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range = int(options.get("range", RANGE))
        self.from_end = options.get("fromend", "false") == "true"

    def files(self) -> tuple[FileSystem, list[FileInfo]]:
        system, root = FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        found = system.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
        return system, sorted((f for f in found if f.type == FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

    def ends(self) -> dict[str, int]:
        """Where the last whole line of each file ends."""
        system, found = self.files()
        return {f.path: last_line_end(system, f.path, f.size) for f in found}

    def initialOffset(self) -> dict:
        return self.ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for file, stop in end.items():
            at = int(start.get(file, 0))
            if stop < at:  # the file was emptied and written anew
                at = 0
            out += [Piece(file, k, min(k + self.range, stop)) for k in range(at, stop, self.range)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        names = ["file", "at", "text"]

        def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            at, text = zip(*rows)
            columns = [pa.array([partition.file] * len(rows), pa.string()), pa.array(at, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        rows, size = [], 0
        with system.open_input_file(partition.file) as f:
            for row in lines_from(f, partition.start, partition.end):
                rows.append(row)
                size += len(row[1]) + 100
                if size > OUT_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def last_line_end(system: FileSystem, path: str, size: int) -> int:
    """The place behind the last line feed; what follows it is a line that is still being written."""
    with system.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - STEP)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


class TailSource(DataSource):
    """Format ``log_tail``: options ``path`` (a folder), ``fromEnd`` (only what is written from now on) and ``range`` (bytes to a task)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINE_SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_auth_log(spark: SparkSession, path: str, from_end: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """(file, line_no, line) of the lines of log files under ``path``, each once, as they are written; ready for ``parse_auth_events``.

    The offset that Spark keeps with the query holds a number for each file, so a folder should have the logs that are followed and not their archive.
    A line counts when its line feed is written. A file that has become shorter is read from its start again. line_no is as in ``stream_auth_log``.
    """
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("log_tail").options(path=path, fromEnd=str(from_end).lower(), range=range_bytes).load()
    number = F.shiftleft(F.xxhash64("file").bitwiseAND(F.lit((1 << 12) - 1)), 40).bitwiseOR(F.col("at"))
    return lines.select("file", number.alias("line_no"), F.trim("text").alias("line")).where("line <> ''")

"""Stored tables replayed as streams, and streams run to a stored table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.plans.storage import checkpoint_dir
from flowsentry.streaming.state import END_SHIFT_US, ROCKS, STATE_STORE

#: Rows of a stored file.
FILE_ROWS = 250_000


def _new_folder(df: DataFrame) -> str:
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"


def files_for(rows: int) -> int:
    """How many files ``rows`` rows are stored in: more rows have more, so no task writes or reads much of them."""
    return max(2, -(-rows // FILE_ROWS))


def replay(df: DataFrame, time: str, slices: int = 4, files: int | None = None, end: bool = False) -> DataFrame:
    """``df`` as a stream of ``slices`` micro-batches in time order.

    Slices are cut at time quantiles, which fall on rows' times, and written one after the other, each as ``files`` files of one folder (by
    default as many as its rows ask for); the file source takes files oldest first, one slice per micro-batch. Where many rows share a time
    a slice may be empty; it gets empty files, so batches stay slices. ``end``: a last batch of one row that has only a time, far ahead, which
    tells that the stream is over (``time`` in microseconds).
    """
    folder = _new_folder(df)
    at = F.col(time).cast("double")
    cuts = df.select(at.alias("t")).approxQuantile("t", [i / slices for i in range(1, slices)], 0.001) if slices > 1 else []
    files = files or files_for(-(-df.count() // slices))
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.where(at > low)
        if high is not None:
            part = part.where(at <= high)
        written(part, files, folder)
    if end:
        last = -F.floor(-F.max(time) / 1000) * 1000 + END_SHIFT_US
        only = [last.cast(t).alias(c) if c == time else F.first(F.lit(None).cast(t)).alias(c) for c, t in df.dtypes]
        written(df.agg(*only), files, folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def written(part: DataFrame, files: int, folder: str) -> None:
    """Adds exactly ``files`` files, some of them empty if there are few rows. Each row is computed once, in the tasks that read it."""
    there = _stored_files(part, folder)
    part.repartition(files).write.mode("append").parquet(folder)
    for _ in range(there + files - _stored_files(part, folder)):  # Spark leaves out files without rows
        part.sparkSession.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(folder)


def _stored_files(like: DataFrame, folder: str) -> int:
    try:
        return len(like.sparkSession.read.schema(like.schema).parquet(folder).inputFiles())
    except AnalysisException:  # nothing is stored yet
        return 0


@contextmanager
def state_store(spark: SparkSession, state_partitions: int | None = None) -> Iterator[None]:
    """Settings for streams that are started inside: the state store, and how many parts keyed state has (default: the cluster's parallelism).

    A stream keeps its own copy of the settings; the number of parts is fixed when it first starts.
    """
    wanted = {"spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism), STATE_STORE: ROCKS}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_to_table(stream: DataFrame, state_partitions: int | None = None) -> DataFrame:
    """Runs the stream over what is there and returns what it wrote."""
    spark, folder = stream.sparkSession, _new_folder(stream)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows")
    writer = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    with state_store(spark, state_partitions):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

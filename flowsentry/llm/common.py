"""Helpers shared by the corpus operators: Arrow batches in and out, bounded memos, fixed-size reductions."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsentry.plans.storage import materialize

#: Rows and bytes after which a task hands over an output batch.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = False, more: tuple[Column, ...] = ()) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, and ``more``; a null text is an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"), *more)


def keyed(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a column ``name`` more, a long that tells the rows apart and is the same in every job.

    A row's place among the partitions is not: Spark cuts files by the cores registered at that moment. Rows of Parquet
    files have the number of their file, by path, and their index in it. What is more than a choice of such rows and columns
    is stored once, with a number as a column.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = re.findall(r"^[\s:+-]*(\w+)(?:.*(parquet)$)?", plan.toString(), re.MULTILINE)
    if not plan.deterministic() or ("Relation", "parquet") not in nodes or not {n for n, _ in nodes} <= {"Project", "Filter", "Relation"} or "_metadata" in docs.columns:
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()))
    file, at, number = (f"{c}_{uuid.uuid4().hex}" for c in ("file", "at", "number"))
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), f"{file} string, {number} long")
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    key = F.shiftleft(number, 40).bitwiseOR(F.col(at)).alias(name)
    return placed.join(F.broadcast(numbers), file).select(*[f"`{c}`" for c in docs.columns], key)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, binary: bool = False) -> DataFrame:
    """doc_id, text and row: the key in ``row_col`` (see ``keyed``), or without one a key made here."""
    if row_col is None:
        docs, id_col, text_col, row_col = keyed(texts(docs, id_col, text_col)), "doc_id", "text", "row"
    return texts(docs, id_col, text_col, binary, (F.col(row_col).alias("row"),))


def resolve(name: str) -> str:
    """A vocabulary file: a path as it is, else a name among the public tokenizers of this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """A dict that computes what it lacks and forgets the older half of it beyond ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length (and of bounded size, if ``size`` tells a row's bytes)."""
    kept: list[tuple] = []
    held = 0
    for row in rows:
        kept.append(row)
        held += size(row) if size else 0
        if len(kept) >= OUT_ROWS or held >= OUT_BYTES:
            yield to_batch(kept, schema)
            kept, held = [], 0
    if kept:
        yield to_batch(kept, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at once; Spark's 10,000 texts take some 200 MB a task outside the heap, with their copies."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def reduce_vectors(parts: DataFrame, length: int, dtype: str, operation: str, slices: int) -> bytes:
    """Vectors of one fixed size, one per task, combined element by element.

    ``parts`` has rows (slice int, data binary): every task cuts its vector into the same ``slices`` of ``length``
    elements and leaves out those of zeros. Spark combines each slice; the driver receives one vector of that fixed
    size. ``operation`` is "or", or "add", which stays at the type's largest value.
    """
    import numpy as np

    schema = pa.schema([("slice", pa.int32()), ("data", pa.binary())])

    def combine(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for s, data in zip(frame.column(0).to_pylist(), frame.column(1)):
                v = np.frombuffer(data.as_py(), dtype)
                if s not in held:
                    held[s] = v.copy()
                elif operation == "or":
                    held[s] |= v
                else:
                    held[s] += np.minimum(v, np.iinfo(dtype).max - held[s])
        if held:
            yield to_batch([(s, v.tobytes()) for s, v in sorted(held.items())], schema)

    found = {r["slice"]: bytes(r["data"]) for r in parts.repartition("slice").mapInArrow(combine, "slice int, data binary").collect()}
    empty = np.zeros(length, dtype).tobytes()
    return b"".join(found.get(s, empty) for s in range(slices))

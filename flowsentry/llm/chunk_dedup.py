"""Repeated substrings by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where its top bits are zero, so an insertion shifts the cuts near it and
no others. All positions are hashed at once: adding the hash of twice the width, shifted, doubles the
window, and four doublings give the 16-byte window of a 16-bit hash. Chunks meet by digest; the first document
owns a chunk, every later copy is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsentry.llm.common import keyed_texts
from flowsentry.plans.storage import materialize


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; a cut has chance 2 ** -bits; ``least_span``: shorter runs of repeated chunks are left alone."""

    least: int = 24
    most: int = 256
    bits: int = 5
    least_span: int = 96


def gear_table() -> np.ndarray:
    """256 scattered 16-bit values, by a multiplicative rule."""
    x = np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype("u2")


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte: h = 2 * h + GEAR[byte], modulo 2 ** 16."""
    h = GEAR[data]
    width = 1
    while width < 16 and len(h) > width:
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
        width *= 2
    return h


def cuts(data: bytes, how: Chunking) -> list[int]:
    """Ends of the chunks of ``data``, the last included."""
    hashes = gear_hashes(np.frombuffer(data, "u1"))
    out, start = [], 0
    for end in (np.flatnonzero(hashes >> np.uint16(16 - how.bits) == 0) + 1).tolist():
        while end - start > how.most:
            start += how.most
            out.append(start)
        if end - start >= how.least:
            out.append(end)
            start = end
    while len(data) - start > how.most:
        start += how.most
        out.append(start)
    if start < len(data):
        out.append(len(data))
    return out


def chunk_rows(rows: DataFrame, how: Chunking) -> DataFrame:
    """Rows (row, id, text binary) to chunks: row, id, start, end, a, b (digest), again (stood earlier in the same text)."""
    schema = pa.schema([(c, pa.int64()) for c in ("row", "id")] + [(c, pa.int32()) for c in ("start", "end")] + [(c, pa.int64()) for c in ("a", "b")] + [("again", pa.bool_())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for frame in frames:
            rows_, ids, sizes, ends, starts, digests, again = [], [], [], [], [], [], []
            held = 0

            def out():
                ab = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                n = np.array(sizes)
                return pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array(rows_, "i8"), n)), pa.array(np.repeat(np.array(ids, "i8"), n)),
                    pa.array(np.array(starts, "i4")), pa.array(np.array(ends, "i4")), pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(again, pa.bool_()),
                ], schema=schema)

            for row, i, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2)):
                data = text.as_py()
                if not data:
                    continue
                end = cuts(data, how)
                start = [0, *end[:-1]]
                found = [digest(data[x:y]) for x, y in zip(start, end)]
                seen: set[bytes] = set()
                again += [d in seen or seen.add(d) is not None for d in found]
                rows_.append(row)
                ids.append(i)
                sizes.append(len(end))
                starts += start
                ends += end
                digests += found
                held += len(end)
                if held > 50_000:
                    yield out()
                    rows_, ids, sizes, ends, starts, digests, again = [], [], [], [], [], [], []
                    held = 0
            if held:
                yield out()

    return rows.mapInArrow(run, "row long, id long, start int, end int, a long, b long, again boolean")


def dedup_substrings(docs: DataFrame, how: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, doc_id, n_bytes, repeats and removed, both array<struct<start, end>>.

    ``repeats`` are the runs of chunks that stand more than once anywhere, the first copy included; ``removed`` are the
    same runs without chunks that the row owns. The owner of a chunk is its first place in the document of
    smallest id; a null id comes last; rows that repeat an id count as one document, each keeping its first copy.
    Runs shorter than ``least_span`` bytes are left alone. Null and empty texts have none; spans are byte offsets in
    UTF-8; an empty table gives an empty result. ``row`` is a key of the row, in input order.
    """
    rows = keyed_texts(docs, id_col, text_col, binary=True).select(
        "row", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text", "doc_id"
    )
    chunks = chunk_rows(rows.select("row", "id", "text"), how)
    common = materialize(
        chunks.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("owner")).filter("n > 1").select("a", "b", "owner")
    )
    found = chunks.join(common, ["a", "b"]).select("row", F.struct("start", "end", ((F.col("id") != F.col("owner")) | F.col("again")).alias("later")).alias("chunk"))
    head = rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(None).cast("struct<start:int,end:int,later:boolean>").alias("chunk"))
    both = found.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), "chunk").unionByName(head)
    per_row = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.collect_list("chunk").alias("chunks"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("repeats", span), ("removed", span)])

    def spans(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            repeats, removed = [], []
            for c in frame.column(3).to_pylist():
                runs = [r for r in runs_of(sorted((x["start"], x["end"], x["later"]) for x in c)) if r[-1][1] - r[0][0] >= how.least_span]
                repeats.append([{"start": r[0][0], "end": r[-1][1]} for r in runs])
                removed.append([{"start": p[0][0], "end": p[-1][1]} for r in runs for p in runs_of([x for x in r if x[2]])])
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array(repeats, span), pa.array(removed, span)], schema=schema)

    return per_row.mapInArrow(spans, "row long, doc_id long, n_bytes long, repeats array<struct<start:int,end:int>>, removed array<struct<start:int,end:int>>")


def runs_of(chunks: list[tuple]) -> list[list[tuple]]:
    """Sorted chunks, cut where one does not start at the end of the one before."""
    out: list[list[tuple]] = []
    for c in chunks:
        if out and out[-1][-1][1] == c[0]:
            out[-1].append(c)
        else:
            out.append([c])
    return out

"""SimHash fingerprints of texts and the groups that links between near fingerprints make; the search is in ``vantage``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsentry.llm.components import components
from flowsentry.llm.vantage import Search, near_links
from flowsentry.plans.storage import materialize

#: Blanks to spaces, A-Z to a-z.
PLAIN = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Fingerprints:
    """Fingerprints of ``words``-word shingles, repeats included, hashed by XXH64 with ``seed``; linked within ``search.radius`` bits."""

    words: int = 4
    seed: int = 42
    search: Search = field(default_factory=Search)


def fingerprint(data: bytes, how: Fingerprints) -> int:
    """The bits, as an unsigned number, that are set in over half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    text = np.frombuffer(data.translate(PLAIN), "u1")
    space = text == 32
    text = text[~(space & np.concatenate([[True], space[:-1]]))] if len(text) else text
    if len(text) and text[-1] == 32:
        text = text[:-1]
    if not len(text):
        return 0
    plain = text.tobytes()
    gap = np.flatnonzero(text == 32)
    start, end = np.append(0, gap + 1), np.append(gap, len(text))
    size = min(how.words, len(start))
    start, end = start[: len(start) - size + 1], end[size - 1 :]
    ones = np.zeros(64, "i8")
    for i in range(0, len(start), BLOCK):
        spans = zip(start[i : i + BLOCK].tolist(), end[i : i + BLOCK].tolist())
        h = np.array([xxh64_intdigest(plain[s:e], how.seed) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(start)).view("<u8")[0])


def near_copies(docs: DataFrame, how: Fingerprints = Fingerprints(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, bits (long), fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links between fingerprints; ids may be of any type that has an order. A null or
    empty text, or one of blanks only, has the fingerprint zero, which links like any other; with fewer words than a
    shingle has, the whole sequence is the only shingle. Null ids do not count: a component of null ids has null. Rows that repeat an id or a
    text stay. An empty table gives an empty result. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            bits = np.fromiter((fingerprint(t.as_py(), how) for t in frame.column(1)), "u8", frame.num_rows)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(bits.view("i8"))], names=["doc_id", "bits"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).mapInArrow(sign, f"doc_id {kind}, bits long")
    rows = materialize(rows)
    classes = materialize(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(classes.select("bits"), how.search))
    rooted = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("bits", "component_id"))
    return rows.join(named, "bits").select("doc_id", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")

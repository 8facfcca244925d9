"""A Merkle manifest of a table: one digest a row, a subtree a branch (a language, say), one root over all branches.

A parent is the hash of a run of ``fan`` consecutive children and keeps a copy of its hash state from before each child
slot. When one child is replaced, the copy before its slot takes the replacement and the siblings on its right; what is
on the left is never hashed again.

Rows are numbered within their branch over sorted cuts of the table, so a branch may hold any share of the rows. A task
takes chunks of ``fan ** levels`` neighbours and hands on one digest for each; those digests are the nodes of the next
stage, until one is left for each branch, and the same once more over the branches. On the way back a chunk gets the runs
on its way to the root in one row, and its task folds every row's proof over its own parents and those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsentry.llm.common import batches
from flowsentry.plans.storage import materialize

PATH_SQL = "array<struct<slot:int,run:array<string>>>"
PATH = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))
_ROW_BITS = 33  # of monotonically_increasing_id: the row's number within its partition


@dataclass(frozen=True)
class Shape:
    """``fan`` children to a parent; one task joins ``fan ** levels`` neighbours at once."""

    fan: int = 2
    levels: int = 10

    @property
    def width(self) -> int:
        return self.fan**self.levels

    def height(self, nodes: int) -> int:
        """Levels until one of ``nodes`` is left."""
        h, reach = 0, 1
        while reach < nodes:
            h, reach = h + 1, reach * self.fan
        return h


class Parent:
    """A run of children, the hash states before each slot, and the digest."""

    __slots__ = ("run", "states", "digest")

    def __init__(self, run: list[str]):
        state = hashlib.sha256()
        self.run, self.states = run, []
        for child in run:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        state = self.states[slot].copy()
        state.update(replacement.encode())
        for child in self.run[slot + 1 :]:
            state.update(child.encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> list[str]:
        return self.run[:slot] + self.run[slot + 1 :]


class Subtree:
    """Parents over one chunk of a branch of ``nodes`` nodes, level by level."""

    def __init__(self, digests: list[str], nodes: int, shape: Shape):
        self.fan, self.levels = shape.fan, []
        for _ in range(min(shape.levels, shape.height(nodes))):
            self.levels.append([Parent(digests[i : i + shape.fan]) for i in range(0, len(digests), shape.fan)])
            digests = [p.digest for p in self.levels[-1]]
        self.top = digests[0]

    def way(self, place: int) -> Iterator[tuple[int, Parent]]:
        """(slot, parent) from the node at ``place`` up to the top."""
        for parents in self.levels:
            yield place % self.fan, parents[place // self.fan]
            place //= self.fan


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the value's text, ``:`` and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (branch, ...) with pos, their number in the branch by ``order``, and n, the branch's size.

    The cuts between tasks fall inside large branches and among equal rows; a task's rows count on from a sum of one row for each
    task and branch before it.
    """
    by = ["branch", *order, "tie"]
    placed = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialize(placed.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", _ROW_BITS)))
    pieces = rows.groupBy("branch", "task").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    whole = Window.partitionBy("branch")
    before = F.coalesce(F.sum("size").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = materialize(pieces.select("branch", "task", (before - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n")))
    return rows.join(pieces, ["branch", "task"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def chunked(nodes: DataFrame, shape: Shape, *columns: str) -> DataFrame:
    """Chunk by chunk in one task each, in order."""
    chunk = F.floor(F.col("pos") / shape.width).cast("long").alias("chunk")
    return nodes.select("branch", chunk, "pos", *columns).repartition("branch", "chunk").sortWithinPartitions("branch", "chunk", "pos")


def rows_of(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*(c.to_pylist() for c in frame.columns))


def tops(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The next stage's nodes: one for each chunk of ``nodes`` (branch, pos, digest, n)."""
    schema = pa.schema([("branch", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])

    def climb(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (branch, chunk), got in groupby(rows_of(frames), itemgetter(0, 1)):
                got = list(got)
                yield branch, chunk, Subtree([r[3] for r in got], got[0][4], shape).top, -(-got[0][4] // shape.width)

        yield from batches(each(), schema)

    return chunked(nodes, shape, "digest", "n").mapInArrow(climb, "branch string, pos long, digest string, n long")


def ways(nodes: DataFrame, shape: Shape) -> DataFrame:
    """branch, pos, chunk and path (slot and run of each parent up to the chunk's top) of each of ``nodes``."""
    schema = pa.schema([("branch", pa.string()), ("pos", pa.int64()), ("chunk", pa.int64()), ("path", PATH)])

    def climb(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (branch, chunk), got in groupby(rows_of(frames), itemgetter(0, 1)):
                got = list(got)
                tree = Subtree([r[3] for r in got], got[0][4], shape)
                for r in got:
                    yield branch, r[2], chunk, [{"slot": s, "run": p.run} for s, p in tree.way(r[2] - chunk * shape.width)]

        yield from batches(each(), schema, lambda r: 200 * len(r[3]))

    return chunked(nodes, shape, "digest", "n").mapInArrow(climb, f"branch string, pos long, chunk long, path {PATH_SQL}")


def stages_of(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """The stored nodes of every stage above ``nodes``; the last has one for each branch."""
    stages = [materialize(tops(nodes, shape))]
    while (stages[-1].agg(F.max("n")).first()[0] or 1) > 1:
        stages.append(materialize(tops(stages[-1], shape)))
    return stages


def above(stages: list[DataFrame], last: DataFrame, shape: Shape) -> DataFrame:
    """The first stage's nodes with their whole paths; ``last`` (branch, pos, path, ...) has those of the last one's."""
    for nodes in reversed(stages[:-1]):
        up = last.select("branch", F.col("pos").alias("chunk"), F.col("path").alias("up"), *[c for c in last.columns if c not in ("branch", "pos", "path")])
        joined = ways(nodes, shape).join(up, ["branch", "chunk"])
        last = materialize(joined.withColumn("path", F.concat("path", "up")).drop("chunk", "up"))
    return last


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    branch_col: str = "lang",
    order_col: str = "doc_id",
    found: dict[str, Column] | None = None,
    shape: Shape = Shape(),
) -> DataFrame:
    """One row per input row: ``order_col``, leaf, subroot, root, proof (array of sibling digests, lowest level first), folded_root, verified.

    A leaf is the SHA-256 (lowercase hex, as all digests) of the row's ``columns`` as ``field`` writes them. ``found`` gives the
    values that a later reader found in some of the columns; folded_root is the root that follows from the leaf of those and the original
    siblings, and verified tells whether it is the root.

    Branches are ordered bytewise, the null branch first and apart from the empty one; in a branch rows ascend by ``order_col``, nulls first,
    rows that repeat it by leaf. Equal rows are leaves of their own. A null or empty text is a value like any other. An empty table
    gives an empty result. Other columns are not read.
    """
    now = {c: found[c] if found and c in found else F.col(f"`{c}`") for c in columns}
    leaf = F.sha2(F.concat(*[field(F.col(f"`{c}`")) for c in columns]), 256)
    as_found = F.sha2(F.concat(*[field(v) for v in now.values()]), 256)
    same = F.lit(True)
    for c in found or ():
        same = same & (field(now[c]) == field(F.col(f"`{c}`")))
    branch = F.coalesce(F.concat(F.lit("1"), F.col(f"`{branch_col}`").cast("string")), F.lit("0"))
    leaves = materialize(
        docs.select(branch.alias("branch"), F.col(f"`{order_col}`").alias("id"), leaf.alias("digest"), F.when(~same, as_found).alias("found"))
    )
    leaves = materialize(numbered(leaves, ["id", "digest"]))
    stages = stages_of(leaves, shape)
    subroots = numbered(stages[-1].select(F.lit("").alias("branch"), F.col("branch").alias("id"), "digest"), ["id"])
    subroots = materialize(subroots)
    upper = stages_of(subroots, shape)
    top = upper[-1].select("branch", "pos", F.lit(None).cast(PATH_SQL).alias("path"), F.col("digest").alias("root"))
    top = above([subroots, *upper], top.withColumn("path", F.array().cast(PATH_SQL)), shape)
    named = subroots.select("pos", F.col("id").alias("name"), F.col("digest").alias("subroot"))
    last = materialize(top.join(named, "pos").select(F.col("name").alias("branch"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"))
    return folded(leaves, above(stages, last, shape), shape, order_col)


def folded(leaves: DataFrame, chunks: DataFrame, shape: Shape, id_col: str) -> DataFrame:
    """The result rows; ``chunks`` has path, subroot and root of each chunk and goes before the chunk's leaves."""
    kind = leaves.schema["id"].dataType
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    chunk = F.floor(F.col("pos") / shape.width).cast("long").alias("chunk")
    rows = leaves.select("branch", chunk, "pos", "id", "digest", "found", "n", none(PATH_SQL, "path"), none("string", "subroot"), none("string", "root"))
    heads = chunks.select(
        "branch", F.col("pos").alias("chunk"), F.lit(-1).cast("long").alias("pos"), none(kind, "id"), none("string", "digest"),
        none("string", "found"), none("long", "n"), "path", "subroot", "root",
    )
    names = ("leaf", "subroot", "root", "proof", "folded_root", "verified")
    types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_())

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def each():
            nonlocal schema
            for frame in frames:
                schema = schema or pa.schema([("id", frame.schema.field("id").type), *zip(names, types)])
                yield from zip(*(c.to_pylist() for c in frame.columns))

        def results():
            for (_, chunk), got in groupby(each(), itemgetter(0, 1)):
                head, *got = got
                tree = Subtree([r[4] for r in got], got[0][6], shape)
                up = [(p["slot"], Parent(p["run"])) for p in head[7]]
                upper = [s for slot, p in up for s in p.siblings(slot)]
                for r in got:
                    digest, proof = r[5] or r[4], []
                    for slot, parent in tree.way(r[2] - chunk * shape.width):
                        proof += parent.siblings(slot)
                        digest = parent.fold(slot, digest)
                    for slot, parent in up:
                        digest = parent.fold(slot, digest)
                    yield r[3], r[4], head[8], head[9], proof + upper, digest, digest == head[9]

        kept, held = [], 0
        for row in results():
            kept.append(row)
            held += 300 + 70 * len(row[4])
            if held > 4 << 20:
                yield from batches(kept, schema)
                kept, held = [], 0
        if kept:
            yield from batches(kept, schema)

    together = rows.unionByName(heads).repartition("branch", "chunk").sortWithinPartitions("branch", "chunk", "pos")
    out = together.mapInArrow(fold, f"id {kind.simpleString()}, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)

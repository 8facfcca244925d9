"""Exact duplicates: every distinct text has one owner, kept at the end of its path in a compressed trie.

Each input task puts its texts into a trie of its own and sends one copy of each distinct one, with its best row
and its count; a text that fills a third of the table crosses the network once per task. Rows meet by (length,
content hash), where a second trie compares whole byte strings. The verdict returns to the rows by that pair; the
tries have seen all bytes of every pair and refuse two texts under one.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsentry.llm.common import batches, keyed_texts

#: Characters that do not count, and the bytes of texts a task holds before it spills a subtree.
BLANK, MEMORY = b" \t\n\x0b\x0c\r", 128 << 20


class Node:
    __slots__ = ("children", "edge", "owner")

    def __init__(self, edge: bytes, owner=None):
        self.edge, self.owner, self.children = edge, owner, {}


class OwnerTrie:
    """Byte strings to owners. ``merge(old, new)`` joins the owners of equal strings.

    Beyond ``memory`` bytes of edges the subtree of the root with most bytes goes to an unnamed file, with all that arrives
    under its first byte later; it is read back, as a trie of its own one byte deeper, when the rest is done.
    """

    #: Bytes a node takes besides its edge, about.
    NODE = 300

    def __init__(self, merge, memory: int = MEMORY):
        self.merge, self.memory = merge, memory
        self.root, self.held, self.spilled = Node(b""), {}, {}

    def insert(self, key: bytes, owner) -> None:
        if not key:
            self.root.owner = owner if self.root.owner is None else self.merge(self.root.owner, owner)
            return
        first = key[0]
        if first in self.spilled:
            pickle.dump((key, owner), self.spilled[first])
            return
        self.held[first] = self.held.get(first, 0) + self.add(self.root, key, owner)
        if sum(self.held.values()) > self.memory:
            most = max(self.held, key=self.held.get)
            top = self.root.children[most]
            if top.children:  # one string alone can't be split
                file = self.spilled[most] = tempfile.TemporaryFile()
                for item in self.walk(top, b""):
                    pickle.dump(item, file)
                del self.root.children[most], self.held[most]

    def add(self, node: Node, key: bytes, owner) -> int:
        """Bytes added."""
        at = 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                return len(key) - at + self.NODE
            if not key.startswith(child.edge, at):
                same = common(child.edge, key, at)
                middle = Node(child.edge[:same])
                child.edge = child.edge[same:]
                middle.children[child.edge[0]] = child
                node.children[key[at]] = child = middle
                node, at = middle, at + same
                if at == len(key):
                    middle.owner = owner
                    return self.NODE
                middle.children[key[at]] = Node(key[at:], owner)
                return len(key) - at + 2 * self.NODE
            node, at = child, at + len(child.edge)
        node.owner = owner if node.owner is None else self.merge(node.owner, owner)
        return 0

    def walk(self, node: Node, path: bytes) -> Iterator[tuple[bytes, object]]:
        """Depth first, with an own stack: a trie may be as deep as a text is long."""
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            path += node.edge
            if node.owner is not None:
                yield path, node.owner
            stack += [(c, path) for c in node.children.values()]

    def owners(self) -> Iterator[tuple[bytes, object]]:
        yield from self.walk(self.root, b"")
        self.root = Node(b"")
        for first, file in self.spilled.items():
            deeper = OwnerTrie(self.merge, self.memory)
            file.seek(0)
            while True:
                try:
                    key, owner = pickle.load(file)
                except EOFError:
                    break
                deeper.insert(key[1:], owner)
            file.close()
            for key, owner in deeper.owners():
                yield bytes([first]) + key, owner


def common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``edge`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(edge[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def better(a: tuple, b: tuple) -> tuple:
    """Owner: (best row, rows, hash); the best row is the least of (-code points, id is null, id, row)."""
    return min(a[0], b[0]), a[1] + b[1], a[2]


OWNER_FIELDS = [("size", pa.int64()), ("hash", pa.string()), ("points", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("rows", pa.int64())]
OWNER_SQL = "size long, hash string, points long, keep_id long, keep_row long, rows long"


def owner_row(owner: tuple, size: int) -> tuple:
    (points, empty, doc_id, row), rows, digest = owner
    return size, digest, -points, None if empty else doc_id, row, rows


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after blanks ([\\x20\\x09-\\x0D]) are deleted; a null text is an empty one, and
    all empty ones are equal. Of equal texts the row with the most code points stays, then the smallest id; a null
    id comes last; of rows that repeat an id the first stays. ``row`` tells such rows apart: the key in
    ``row_col`` (see ``common.keyed``), else one made here. An empty table gives an empty result. Other columns are not read.
    """
    rows = keyed_texts(docs, id_col, text_col, row_col).select(
        "doc_id", F.length("text").cast("long").alias("points"), "row", F.col("text").cast("binary").alias("text")
    )
    local = pa.schema([*OWNER_FIELDS, ("text", pa.binary())])
    own = pa.schema(OWNER_FIELDS)
    members = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("size", pa.int64()), ("hash", pa.string())])

    def columns(frame: pa.RecordBatch):
        return zip(*(frame.column(i).to_pylist() for i in range(3)), frame.column(3))

    def tries(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OwnerTrie(better, memory)
        for frame in frames:
            for doc_id, points, row, text in columns(frame):
                key = text.as_py().translate(None, BLANK)
                trie.insert(key, ((-points, doc_id is None, doc_id or 0, row), 1, hashlib.sha256(key).hexdigest()))
        yield from batches(((*owner_row(o, len(key)), key) for key, o in trie.owners()), local, lambda r: len(r[-1]))

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, seen = OwnerTrie(better, memory), set()
        for frame in frames:
            for *r, text in zip(*(c.to_pylist() for c in frame.columns[:-1]), frame.column(6)):
                _, digest, points, keep, row, n = r
                trie.insert(text.as_py(), ((-points, keep is None, keep or 0, row), n, digest))

        def found():
            for key, o in trie.owners():
                if (len(key), o[2]) in seen:
                    raise ValueError(f"two texts of {len(key)} bytes share the hash {o[2]}")
                seen.add((len(key), o[2]))
                yield owner_row(o, len(key))

        yield from batches(found(), own)

    def digests(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for frame in frames:
                for doc_id, _, row, text in columns(frame):
                    key = text.as_py().translate(None, BLANK)
                    yield doc_id, row, len(key), hashlib.sha256(key).hexdigest()

        yield from batches(each(), members)

    owners = rows.mapInArrow(tries, f"{OWNER_SQL}, text binary").repartition("size", "hash").mapInArrow(meet, OWNER_SQL)
    return (
        rows.mapInArrow(digests, "doc_id long, row long, size long, hash string")
        .join(owners.drop("points"), ["size", "hash"])
        .select(
            "doc_id", "row", "keep_id", F.col("rows").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
            F.col("hash").alias("text_sha256"),
        )
    )

"""N-gram Jaccard join with rare-first prefixes, and the groups its links make.

Documents are sets of word n-grams. Two sets of Jaccard similarity t share an n-gram among the first
n - ceil(t * n) + 1 of each in any common order; with rare n-grams first those prefixes meet seldom. The order comes
from a count over all documents in a table of fixed size (n-grams that share a cell are told apart by hash: order
only decides speed). Equal sets are one class from the start.

A class enters a bucket for each n-gram of its prefix. No bucket is expanded into its pairs: at first each class is only
compared with its bucket's hub, the class in which the n-gram stands earliest, and large buckets have hubs of parts and
hubs of hubs. Links found so far make components; what remains are pairs of one bucket that lie in different components
and pass the length and positional filters. Each distinct pair is verified once, after a suffix filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsentry.llm.common import Memo, batches, keyed_texts, reduce_vectors, texts  # noqa: F401
from flowsentry.llm.components import components
from flowsentry.llm.rows import among, mix, wanted_rows
from flowsentry.plans.storage import materialize


@dataclass(frozen=True)
class Similarity:
    """``words`` to an n-gram; sets link when 100 * intersection >= percent * union.

    ``cells``: size of the frequency table, fixed; ``bucket``: members of a bucket that share a hub.
    """

    words: int = 5
    percent: int = 80
    cells: int = 1 << 22
    bucket: int = 1000

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


SLICES = 64
#: Odd multipliers, by a rule; one for each word of an n-gram.
ODD = [int(x) | 1 for x in (np.arange(1, 65, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))]


class Grams:
    """Texts (UTF-8 bytes) to sorted arrays of distinct 64-bit n-gram hashes."""

    def __init__(self, words: int):
        import xxhash

        self.words = words
        self.known = Memo(xxhash.xxh3_64_intdigest, 150_000)

    def __call__(self, data: bytes) -> np.ndarray:
        words = data.lower().split()  # bytes: A-Z and ASCII blanks only
        if not words:
            return np.zeros(0, "u8")
        h = np.fromiter(map(self.known.__getitem__, words), "u8", len(words))
        self.known.trim()
        size = min(self.words, len(words))
        out = np.full(len(words) - size + 1, size, "u8")
        for k in range(size):
            out += mix(h[k : len(words) - size + 1 + k]) * np.uint64(ODD[k])
        return np.unique(mix(out))


def frequencies(rows: DataFrame, how: Similarity) -> np.ndarray:
    """In how many rows the n-grams of each cell stand, at most 65535; ``cells`` numbers whatever the input."""
    shift = np.uint64(64 - (how.cells.bit_length() - 1))
    schema = pa.schema([("slice", pa.int32()), ("data", pa.binary())])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(how.words), np.zeros(how.cells, "u4")
        for frame in frames:
            held: list[np.ndarray] = []
            for text in frame.column(0):
                held.append(grams(text.as_py()) >> shift)
                if sum(map(len, held)) > 500_000:
                    cell, n = np.unique(np.concatenate(held), return_counts=True)
                    total[cell] += n.astype("u4")
                    held = []
            if held:
                cell, n = np.unique(np.concatenate(held), return_counts=True)
                total[cell] += n.astype("u4")
        parts = np.minimum(total, 65535).astype("u2").reshape(SLICES, -1)
        yield from batches(((i, p.tobytes()) for i, p in enumerate(parts) if p.any()), schema)

    data = reduce_vectors(rows.select("text").mapInArrow(count, "slice int, data binary"), how.cells // SLICES, "u2", "add", SLICES)
    return np.frombuffer(data, "u2")


def link_documents(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, group (a row of the component, the same for all in it), component_id.

    A null or empty text, or one of blanks only, has an empty set, is linked with nothing and is its own component; with
    fewer words than an n-gram has, the whole sequence is the only member. component_id is the smallest id that can be
    reached over links (null ids do not count; a component of null ids has null). Rows that repeat an id are documents of
    their own. An empty table gives an empty result. ``row`` is the key in ``row_col`` (see
    ``common.keyed``), else one made here.
    """
    rows = keyed_texts(docs, id_col, text_col, row_col, binary=True).select("text", "doc_id", "row")
    sc = docs.sparkSession.sparkContext
    order = sc.broadcast(frequencies(rows, how))
    signed = materialize(signatures(rows, how, order))
    headed = F.when(F.col("grams").isNotNull(), F.col("row"))  # keys need not rise within a task, so the least may lack its prefix
    classes = materialize(
        signed.filter("n > 0").groupBy("a", "b").agg(F.min(headed).alias("class"), F.min("doc_id").alias("first_id"))
    )
    heads = signed.filter("grams is not null").join(classes.select(F.col("class").alias("row")), "row", "left_semi")
    entries = heads.select(F.posexplode("grams").alias("at", "gram"), F.col("row").alias("class"), "n")
    shared = materialize(entries.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1"))
    entries = materialize(entries.join(shared, "gram"))

    tried = materialize(hub_pairs(entries, how))
    links = materialize(verified(rows, tried, how, order))
    roots = components(links)
    more = materialize(open_pairs(entries, roots, how).join(tried, ["x", "y"], "left_anti"))
    if not more.isEmpty():
        links = links.union(verified(rows, more, how, order))
        roots = components(links)

    ids = roots.join(classes.select(F.col("class").alias("node"), "first_id"), "node")
    smallest = materialize(ids.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = materialize(roots.join(smallest, "root").select(F.col("node").alias("class"), "component_id", "root"))
    all_rows = signed.filter("n > 0").select("row", "doc_id", "n", "a", "b").join(classes, ["a", "b"]).drop("a", "b")
    out = all_rows.join(named, "class", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "class").alias("group"),
        F.coalesce("component_id", "first_id").alias("component_id"),
    )
    empty = signed.filter("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("row").alias("group"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def signatures(rows: DataFrame, how: Similarity, order) -> DataFrame:
    """row, doc_id, n, digest of the set (a, b), and its prefix, rare first, at its first place in a task."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("grams", pa.list_(pa.int64()))])
    shift = np.uint64(64 - (how.cells.bit_length() - 1))

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        grams, frequency, seen = Grams(how.words), order.value, set()

        def each():
            for frame in frames:
                for text, doc_id, row in zip(frame.column(0), frame.column(1).to_pylist(), frame.column(2).to_pylist()):
                    h = grams(text.as_py())
                    digest = xxhash.xxh3_128_digest(h.tobytes())
                    a, b = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
                    first = len(h) and digest not in seen
                    if first:
                        seen.add(digest)
                        h = h[np.lexsort((h, frequency[(h >> shift).astype("i8")]))]
                    yield row, doc_id, len(h), a, b, h[: how.prefix(len(h))].view("i8") if first else None

        yield from batches(each(), schema, lambda r: 40 if r[5] is None else 40 + 8 * len(r[5]))

    return rows.mapInArrow(sign, "row long, doc_id long, n long, a long, b long, grams array<long>")


def may_link(how: Similarity, at_x: Column, n_x: Column, at_y: Column, n_y: Column) -> Column:
    """Length filter, and positional filter for a first common n-gram at these places of both prefixes."""
    most = F.least(n_x - at_x, n_y - at_y)
    return (100 * F.least(n_x, n_y) >= how.percent * F.greatest(n_x, n_y)) & ((100 + how.percent) * most >= how.percent * (n_x + n_y))


def pair(x: str, y: str, at_x: str, at_y: str) -> list[Column]:
    """The pair with its smaller class first, and the places of their common n-gram."""
    turned = F.col(x) > F.col(y)
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return [pick(x, y).alias("x"), pick(y, x).alias("y"), pick(at_x, at_y).alias("at_x"), pick(at_y, at_x).alias("at_y")]


def hub_pairs(entries: DataFrame, how: Similarity) -> DataFrame:
    """Distinct pairs of each class with the hubs of its buckets; parts of large buckets have hubs, which meet again."""
    level, out = entries, None
    width = how.bucket
    while True:
        parts = F.ceil(F.col("members") / width)
        part = F.when(parts > 1, F.pmod(F.xxhash64("class"), parts)).otherwise(0)
        w = Window.partitionBy("gram", "part").orderBy("at", "n", "class")
        hub = F.first(F.struct("class", "at", "n")).over(w)
        level = materialize(level.withColumn("part", part).withColumn("hub", hub).select("gram", "class", "at", "n", "members", F.col("hub.class").alias("hub"), F.col("hub.at").alias("hub_at"), F.col("hub.n").alias("hub_n")))
        near = level.filter((F.col("hub") != F.col("class")) & may_link(how, F.col("at"), F.col("n"), F.col("hub_at"), F.col("hub_n"))).select(*pair("class", "hub", "at", "hub_at"))
        out = near if out is None else out.union(near)
        level = level.filter((F.col("hub") == F.col("class")) & (F.col("members") > width)).select("gram", "class", "at", "n", "members")
        if level.isEmpty():
            return out.groupBy("x", "y").agg(F.min("at_x").alias("at_x"), F.min("at_y").alias("at_y"))
        width *= how.bucket


def open_pairs(entries: DataFrame, roots: DataFrame, how: Similarity) -> DataFrame:
    """Distinct pairs of one bucket, in different components, that the filters let through.

    Members of a bucket's largest component are not compared with each other, and a member takes part only if it could
    link to the smallest set of its bucket, so a bucket of copies costs next to nothing.
    """
    known = roots.select(F.col("node").alias("class"), "root")
    member = materialize(entries.join(known, "class", "left").select("gram", "class", "at", "n", F.coalesce("root", "class").alias("root")))
    sizes = member.groupBy("gram", "root").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    split = sizes.groupBy("gram").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.min("least").alias("least"), F.count("*").alias("roots")).filter("roots > 1")
    split = materialize(split.select("gram", "main", "least"))
    member = materialize(member.join(split, "gram").filter((100 + how.percent) * (F.col("n") - F.col("at")) >= how.percent * (F.col("n") + F.col("least"))))
    x = member.filter("root != main").select("gram", F.col("class").alias("p"), F.col("at").alias("at_p"), F.col("n").alias("n_p"), F.col("root").alias("root_p"))
    y = member.select("gram", F.col("class").alias("q"), F.col("at").alias("at_q"), F.col("n").alias("n_q"), F.col("root").alias("root_q"), "main")
    near = (F.col("root_p") != F.col("root_q")) & ((F.col("root_q") == F.col("main")) | (F.col("p") < F.col("q")))
    near = near & may_link(how, F.col("at_p"), F.col("n_p"), F.col("at_q"), F.col("n_q"))
    met = x.join(y, (x["gram"] == y["gram"]) & near)
    return met.select(*pair("p", "q", "at_p", "at_q")).groupBy("x", "y").agg(F.min("at_x").alias("at_x"), F.min("at_y").alias("at_y"))


def verified(rows: DataFrame, pairs: DataFrame, how: Similarity, order) -> DataFrame:
    """Links (a, b) among ``pairs``. Only texts of rows that stand in a pair are hashed again and sent."""
    sc = rows.sparkSession.sparkContext
    both = pairs.select(F.col("x").alias("row")).union(pairs.select("y")).distinct()
    both = materialize(both)
    bits = sc.broadcast(wanted_rows(both))
    shift = np.uint64(64 - (how.cells.bit_length() - 1))
    schema = pa.schema([("row", pa.int64()), ("grams", pa.binary())])

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, frequency, table = Grams(how.words), order.value, bits.value

        def each():
            for frame in frames:
                ids = frame.column(2).to_numpy()
                for i in np.flatnonzero(among(table, ids)).tolist():
                    h = grams(frame.column(0)[i].as_py())
                    yield int(ids[i]), h[np.lexsort((h, frequency[(h >> shift).astype("i8")]))].tobytes()

        yield from batches(each(), schema, lambda r: len(r[1]))

    found = materialize(rows.mapInArrow(sets, "row long, grams binary").join(both, "row", "left_semi"))
    with_x = pairs.join(found.select(F.col("row").alias("x"), F.col("grams").alias("set_x")), "x")
    with_both = with_x.join(found.select(F.col("row").alias("y"), F.col("grams").alias("set_y")), "y")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = order.value

        def rank(h):
            return frequency[(h >> shift).astype("i8")]

        def each():
            for frame in frames:
                x, y, at_x, at_y = (frame.column(i).to_pylist() for i in range(4))
                for i in range(frame.num_rows):
                    p, q = (np.frombuffer(frame.column(c)[i].as_py(), "u8") for c in (4, 5))
                    if suffixes_may_link(p, q, at_x[i], at_y[i], how, rank) and similar(p, q, how):
                        yield x[i], y[i]

        yield from batches(each(), links)

    return with_both.select("x", "y", "at_x", "at_y", "set_x", "set_y").mapInArrow(verify, "a long, b long")


def similar(p: np.ndarray, q: np.ndarray, how: Similarity) -> bool:
    common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
    return 100 * common >= how.percent * (len(p) + len(q) - common)


def suffixes_may_link(p: np.ndarray, q: np.ndarray, i: int, j: int, how: Similarity, rank, depth: int = 2) -> bool:
    """Suffix filter: what stands behind the places i and j may differ in so many n-grams only.

    A pivot cuts both suffixes in two; sizes of the parts bound the difference from below.
    """
    total = len(p) + len(q)
    least = -(-how.percent * total // (100 + how.percent))
    # even if all before the places is common
    most = total - 2 * least - abs(i - j)
    return difference(p[i:], q[j:], most, rank, depth) <= most


def difference(p: np.ndarray, q: np.ndarray, most: int, rank, depth: int) -> int:
    """A lower bound of the symmetric difference of two runs in the common order."""
    apart = abs(len(p) - len(q))
    if not depth or apart > most or not len(p) or not len(q):
        return apart
    pivot = q[len(q) // 2]
    high = rank(np.array([pivot]))[0]
    r = rank(p)
    cut = int(np.count_nonzero((r < high) | ((r == high) & (p < pivot))))
    left = difference(p[:cut], q[: len(q) // 2], most, rank, depth - 1)
    if left > most:
        return left
    return left + difference(p[cut:], q[len(q) // 2 :], most - left, rank, depth - 1)

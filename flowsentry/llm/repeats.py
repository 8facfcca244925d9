"""Repeated substrings of a fixed length, by suffix sorting of what can repeat.

Every window of ``length`` bytes has an anchor, the substring of half that length in it with the least hash. Equal
windows have equal anchors at the same place, so windows meet by their anchor's hash: runs of windows that share
one anchor occurrence are a *block* of text. Blocks whose anchor stands nowhere else hold no repeat; blocks that
are equal to another repeat as a whole. What is left are different blocks around an equal anchor. A task cuts its
blocks into phrases, where a cut depends only on a few bytes before it, sorts the suffixes of the phrase
sequences, and takes the neighbours that agree for long enough; windows at the same place before such
suffixes are compared by two 64-bit hashes of all their bytes. An anchor that very many different blocks share is not
sent to one task: those blocks are taken as texts of their own and go the same way with longer anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsentry.llm.common import batches, keyed_texts
from flowsentry.llm.rows import among, mix, wanted_rows
from flowsentry.llm.suffix_groups import suffix_array
from flowsentry.plans.storage import materialize

#: Windows hashed at once, bytes of blocks that are sorted at once, and different blocks of one anchor that one task takes.
SEGMENT, TASK, CROWD = 1 << 20, 1 << 18, 2000
#: Odd multipliers of the two rolling hashes.
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Repeat:
    """``length`` of the strings, and how much of it an anchor takes; see ``finer``."""

    length: int = 400
    anchor: int | None = None

    @property
    def gram(self) -> int:
        return self.anchor or self.length // 2

    def finer(self) -> Repeat:
        """Longer anchors for the blocks of a crowded one; at last the anchor is the window, and no block is left to sort."""
        near = self.length - 8
        return Repeat(self.length, near if self.gram < near else self.length)

    @property
    def zone(self) -> int:
        """Bytes without a cut after which every place is one."""
        return max(1, (self.length - 8) // 6)

    @property
    def sure(self) -> int:
        """From here on in a window all cuts are the window's own."""
        return self.zone + 4

    @property
    def agree(self) -> int:
        """Bytes of whole phrases that equal windows have in common, at least."""
        return self.length - self.sure - 2 * (self.zone + 1)


class Roll:
    """Hashes of all substrings of one length: sums of bytes times powers, modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, "u8")

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 12)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, factor, "u8")
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, "u8")
        np.cumsum((data.astype("u8") + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]

    def windows(self, data: np.ndarray, size: int) -> np.ndarray:
        s = self.sums(data)
        return (s[size:] - s[:-size]) * self.down[: len(s) - size]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, how: Repeat, roll: Roll) -> Iterator[tuple[int, int, int]]:
    """(start of the first window, number of windows, hash of the anchor) of each block, from left to right."""
    span = how.length - how.gram + 1
    low = np.uint64((1 << 21) - 1)
    for at in range(0, len(data) - how.length + 1, SEGMENT):
        part = np.frombuffer(data, "u1", min(SEGMENT + how.length - 1, len(data) - at), at)
        h = mix(roll.windows(part, how.gram))
        least = sliding_min((h & ~low) | np.arange(len(h), dtype="u8"), span)
        new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        size = np.diff(np.append(new, len(least)))
        keys = h[(least[new] & low).astype("i8")].view("i8")
        yield from zip((new + at).tolist(), size.tolist(), keys.tolist())


def repeat_spans(blocks: list[bytes], counts: list[int], windows: list[int], how: Repeat) -> list[list[tuple[int, int]]]:
    """For each of the distinct ``blocks``: maximal [start, end) covered by windows that repeat.

    ``counts``: how often the block stands anywhere; ``windows``: how many windows start in it.
    """
    number = len(blocks)
    data = np.frombuffer(b"".join(blocks), "u1")
    begin = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    at = cuts(data, begin, how)
    # phrases lie between cuts of one block
    owner = np.searchsorted(begin, at, "right") - 1
    whole = np.flatnonzero(owner[1:] == owner[:-1])
    start, end, owner = at[:-1][whole], at[1:][whole], owner[:-1][whole]
    edge = np.searchsorted(owner, np.arange(number + 1))
    rolls = [Roll(b) for b in BASES]
    phrase = np.empty(len(start), "u8")
    for b in range(number):
        i, j = edge[b], edge[b + 1]
        sums = rolls[0].sums(data[begin[b] : begin[b + 1]])
        phrase[i:j] = rolls[0].of(sums, start[i:j] - begin[b], end[i:j] - begin[b])
    _, symbol = np.unique(mix(phrase) + (end - start).astype("u8"), return_inverse=True)
    # sequences with a mark of its own behind each block, the last one smallest
    first = np.concatenate([[0], np.cumsum(np.diff(edge) + 1)])
    sequence = np.empty(first[-1], "i8")
    sequence[first[1:] - 1] = np.arange(number)[::-1]
    slot = np.arange(len(start)) + owner
    sequence[slot] = symbol + number
    size = np.zeros(len(sequence), "i8")
    size[slot] = end - start
    order = suffix_array(sequence)
    group = np.empty(len(order), "i8")
    group[order] = np.concatenate([[0], np.cumsum(~agreeing(sequence, size, order, how.agree))])
    members = np.bincount(group)

    keys, checks, owners, starts = [], [], [], []
    for b in range(number):
        i, j = edge[b], edge[b + 1]
        s = np.arange(windows[b])
        local = start[i:j] - begin[b]
        k = np.searchsorted(local, s + how.sure)
        live = k < j - i
        k = np.minimum(k, max(j - i - 1, 0))
        g = group[slot[i:j]][k] if j > i else np.zeros(len(s), "i8")
        live &= members[g] > 1
        if live.any():
            s, k, g = s[live], k[live], g[live]
            text = data[begin[b] : begin[b + 1]]
            one, two = (r.windows(text, how.length)[s] for r in rolls)
            keys.append(mix(one) + mix(g.astype("u8")) * np.uint64(3) + (local[k] - s).astype("u8"))
            checks.append(two)
            owners.append(np.full(len(s), b, "i4"))
            starts.append(s.astype("i4"))
    found: list[np.ndarray] = [np.zeros(0, "i4")] * number
    if keys:
        a, c, o, s = (np.concatenate(x) for x in (keys, checks, owners, starts))
        by = np.lexsort((c, a))
        equal = (a[by][1:] == a[by][:-1]) & (c[by][1:] == c[by][:-1])
        twice = np.zeros(len(by), bool)
        twice[by[1:][equal]] = twice[by[:-1][equal]] = True
        o, s = o[twice], s[twice]
        ends = np.searchsorted(o, np.arange(number + 1))
        found = [s[ends[b] : ends[b + 1]] for b in range(number)]
    return [[(0, windows[b] - 1 + how.length)] if counts[b] > 1 else covered(found[b], how.length) for b in range(number)]


def cuts(data: np.ndarray, begin: np.ndarray, how: Repeat) -> np.ndarray:
    """Places where a phrase starts: after four bytes of a certain hash, and everywhere after a long stretch without."""
    x = data.astype("u4")
    four = (x[3:] | x[2:-1] << 8 | x[1:-2] << 16 | x[:-3] << 24) * np.uint32(0x9E3779B1)
    cut = np.zeros(len(data), bool)
    cut[4:] = four[:-1] >> np.uint32(27) == 0
    for k in range(4):  # the four bytes lie in one block
        cut[np.minimum(begin[:-1] + k, len(data) - 1)] = False
    inside = np.ones(len(data), bool)
    inside[begin[:-1]] = False
    place = np.arange(len(data), dtype="i4")
    last = np.maximum.accumulate(np.where(cut | ~inside, place, np.int32(0)))
    return np.flatnonzero(cut | inside & (place - last >= how.zone))


def agreeing(sequence: np.ndarray, size: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Which neighbours in ``order`` agree in whole phrases of ``least`` bytes in sum."""
    a, b = order[:-1].copy(), order[1:].copy()
    out, left = np.zeros(len(a), bool), np.full(len(a), least)
    live = np.arange(len(a))
    while len(live):
        same = sequence[a] == sequence[b]  # marks are unequal, so no pair runs past its block
        a, b, live, left = a[same], b[same], live[same], left[same]
        left = left - size[a]
        out[live[left <= 0]] = True
        more = left > 0
        a, b, live, left = a[more] + 1, b[more] + 1, live[more], left[more]
    return out


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) of sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()))


def unions(counts: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of lists of [start, end), of which list i has ``counts[i]``: how many each list has left, and all of those in order."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((start, owner))
    start, reach = start[order].astype("i8"), owner * (1 << 32) + end[order]  # owners ascend, so their ends do not mix
    reach = np.maximum.accumulate(reach) if len(reach) else reach
    new = np.ones(len(start), bool)
    new[1:] = owner[1:] * (1 << 32) + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1 if len(at) else at
    return np.bincount(owner[at], minlength=len(counts)), start[at], (reach[last] - owner[at] * (1 << 32))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of one list."""
    start, end = (np.array([s[k] for s in spans], "i8") for k in (0, 1))
    return list(zip(*(x.tolist() for x in unions(np.array([len(spans)]), start, end)[1:])))


def blocks_of(rows: DataFrame, how: Repeat) -> DataFrame:
    """row, start, windows, key and digest (a, b) of every block."""
    schema = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        roll, digest = Roll(BASES[0]), xxhash.xxh3_128_digest
        for frame in frames:
            out: list[tuple] = []
            digests: list[bytes] = []

            def batch():
                ab = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                row, start, windows, key = zip(*out)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((row, start, windows, key, ab[:, 0], ab[:, 1]), schema.types)], schema=schema)

            for text, row in zip(frame.column(0), frame.column(1).to_pylist()):
                data = text.as_py()
                if len(data) < how.length:
                    continue
                view = memoryview(data)
                for start, windows, key in anchors(data, how, roll):
                    out.append((row, start, windows, key))
                    digests.append(digest(view[start : start + windows - 1 + how.length]))
                if len(out) > 50_000:
                    yield batch()
                    out, digests = [], []
            if out:
                yield batch()

    return rows.mapInArrow(run, "row long, start int, windows int, key long, a long, b long")


def find_repeats(rows: DataFrame, how: Repeat) -> DataFrame:
    """(row, start, end) of stretches of the rows' texts (row, text binary) covered by repeated windows; they may overlap."""
    blocks = blocks_of(rows, how)
    keys = materialize(
        blocks.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
        .filter("n > 1").select("key", ((F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1"))).alias("same"))
    )
    seen = materialize(blocks.join(keys, "key"))
    same = seen.filter("same").select("row", "start", (F.col("start") + F.col("windows") - 1 + how.length).alias("end"))
    mixed = seen.filter("not same")
    distinct = materialize(
        mixed.groupBy("key", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("at"), F.max("windows").alias("windows"))
        .select("key", "a", "b", "n", "at.row", "at.start", "windows", F.monotonically_increasing_id().alias("id"))
    )
    if distinct.isEmpty():
        return same
    crowded = materialize(distinct.groupBy("key").count().filter(F.col("count") > CROWD).select("key"))
    verdict = sorted_blocks(sliced(rows, distinct.join(crowded, "key", "left_anti"), how), distinct, how)
    if not crowded.isEmpty():
        crowd = distinct.join(crowded, "key", "left_semi")
        texts_of = materialize(sliced(rows, crowd, how)).select(F.col("block").alias("text"), F.col("id").alias("row"))
        spans = find_repeats(texts_of, how.finer())
        again = crowd.filter("n > 1").select(F.col("id").alias("row"), F.lit(0).alias("start"), (F.col("windows") - 1 + how.length).alias("end"))
        verdict = verdict.unionByName(spans.union(again).groupBy(F.col("row").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    verdict = materialize(verdict.join(distinct.select("id", "key", "a", "b"), "id").drop("id"))
    part = mixed.join(verdict, ["key", "a", "b"]).select("row", "start", F.explode("spans").alias("span"))
    return same.union(part.select("row", F.col("start") + F.col("span.start"), F.col("start") + F.col("span.end")))


def sliced(rows: DataFrame, wanted: DataFrame, how: Repeat) -> DataFrame:
    """id, key, n, windows and bytes of the ``wanted`` blocks, cut from the row each was first seen in."""
    held = rows.sparkSession.sparkContext.broadcast(wanted_rows(wanted.select("row").distinct()))
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("id", "key", "n", "start", "windows")).alias("blocks"))
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("block", pa.binary())])

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for frame in frames:
                for text, blocks in zip(frame.column(0), frame.column(1)):
                    data = text.as_py()
                    for x in blocks.as_py():
                        yield x["id"], x["key"], x["n"], x["windows"], data[x["start"] : x["start"] + x["windows"] - 1 + how.length]

        yield from batches(each(), schema, lambda r: len(r[4]) + 40)

    return possible(rows, held).join(asked, "row").select("text", "blocks").mapInArrow(cut, "id long, key long, n long, windows int, block binary")


def sorted_blocks(blocks: DataFrame, distinct: DataFrame, how: Repeat) -> DataFrame:
    """id and spans, array<struct<start, end>> in the block, of each of the ``blocks``; an anchor's blocks are sorted together."""
    total = distinct.agg(F.sum(F.col("windows") + how.length)).first()[0]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("spans", span)])

    def sort(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(got: list[tuple]):
            spans = repeat_spans([r[4] for r in got], [r[2] for r in got], [r[3] for r in got], how)
            return ((r[0], [{"start": s, "end": e} for s, e in x]) for r, x in zip(got, spans))

        got: list[tuple] = []
        held = 0
        for frame in frames:
            for r in zip(*(c.to_pylist() for c in frame.columns)):
                if held > TASK and r[1] != got[-1][1]:
                    yield from batches(judged(got), schema)
                    got, held = [], 0
                got.append(r)
                held += len(r[4])
        if got:
            yield from batches(judged(got), schema)

    parts = max(1, -(-total // (16 * TASK)))
    return blocks.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sort, "id long, spans array<struct<start:int,end:int>>")


def possible(rows: DataFrame, table) -> DataFrame:
    """Rows (text, row, ...) whose bit is set in the broadcast table."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield frame.filter(pa.array(among(table.value, frame.column(1).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def remove_repeats(docs: DataFrame, how: Repeat = Repeat(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed, array<struct<start, end>>, maximal), kept (binary: what is left).

    Removed is each byte covered by a string of ``length`` bytes that also starts at another place, in any row; judged on
    the input. Null and short texts lose nothing; rows that repeat an id or a text are places of their own; spans are
    byte offsets in UTF-8, and what is left may break a character; an empty table gives an empty result.
    """
    rows = keyed_texts(docs, id_col, text_col, binary=True).select("text", "row", "doc_id")
    plain = rows.select("text", "row")
    spans = find_repeats(plain, how).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = frame.column(1)
            counts = np.diff(found.offsets.to_numpy())
            start, end = (c.to_numpy() for c in found.flatten().flatten())
            number, start, end = unions(counts, start, end)
            whole = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], fields=list(span.value_type))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)), pa.int32()), whole)], names=["row", "spans"])

    spans = materialize(spans.mapInArrow(merge, "row long, spans array<struct<start:int,end:int>>"))
    held = docs.sparkSession.sparkContext.broadcast(wanted_rows(spans.select("row")))

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for frame in frames:
                for text, doc_id, found in zip(frame.column(0), frame.column(1).to_pylist(), frame.column(2).to_pylist()):
                    data = text.as_py()
                    at, left = 0, []
                    for s in found or ():
                        left.append(data[at : s["start"]])
                        at = s["end"]
                    yield doc_id, len(data), found or [], b"".join([*left, data[at:]])

        yield from batches(each(), schema, lambda r: len(r[3]))

    def untouched(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for frame in frames:
                rest = frame.filter(pa.array(~among(held.value, frame.column(1).to_numpy())))
                for text, doc_id in zip(rest.column(0), rest.column(2).to_pylist()):
                    data = text.as_py()
                    yield doc_id, len(data), [], data

        yield from batches(each(), schema, lambda r: len(r[3]))

    sql = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    touched = possible(rows, held).join(spans, "row", "left").select("text", "doc_id", "spans")
    return touched.mapInArrow(cut, sql).unionByName(rows.mapInArrow(untouched, sql))

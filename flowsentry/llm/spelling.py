"""Spelling variants: words of a corpus that differ in one code point, found by pivotal grams.

Bigrams have one order over the whole vocabulary, rare ones first. A word's prefix is its first three bigrams in that order (with all
that tie with the third); dynamic programming picks its two pivots there, disjoint and as rare as can be. One edit spoils at
most one of two disjoint grams, so of two near words the one whose prefix ends first has a pivot that stands in the other's
prefix, as far from the start or from the end as the edit allows.

That edit also leaves one half of the word as it is. So a pivot meets a prefix gram only under a key of the gram and one
half's text, which makes the lists short; places, lengths and a set of letters settle most of what meets, and the rest is
compared code point by code point. A key with very long lists is dealt over a grid of tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsentry.llm.common import Memo, batches
from flowsentry.plans.storage import materialize

#: Bigrams are told apart by a cell number; two that share one count as the same gram.
CELLS = 1 << 16
#: Words counted in a task before it hands its counts on, and pairs compared at once.
COUNTS, PAIRS = 200_000, 1 << 19
#: Code points that are compared as columns of a table; longer words are compared one by one.
WIDE = 48
LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Words:
    """Maximal runs of ``letters`` (of a character class), A-Z in lower case; words have ``least`` code points, four or more, and occur ``often`` times.

    ``spoil``: where this number divides the checksum of ``<id>:<run>``, the run loses the code point at checksum modulo length; 0 for never.
    A word's form has ``ratio`` times its occurrences. ``side``: entries of one key that a task takes of each kind.
    """

    letters: str = "A-Za-zÀ-ÿ"
    least: int = 7
    often: int = 2
    ratio: int = 10
    spoil: int = 0
    side: int = 50_000

    def __post_init__(self):
        if self.least < 4:
            raise ValueError("words of fewer than four code points have no two disjoint bigrams among three")


def count_words(docs: DataFrame, how: Words, id_col: str, text_col: str) -> DataFrame:
    """word and n, its occurrences in all texts."""
    run = re.compile(f"[{how.letters}]{{{how.least},}}")  # shorter runs give no word
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        plain = Memo(lambda w: w.translate(LOWER))
        for frame in frames:
            for key, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                if not how.spoil:
                    total.update(map(plain.__getitem__, run.findall(text.as_py())))
                    continue
                begin = zlib.crc32(f"{key}:".encode())
                for found, n in Counter(run.findall(text.as_py())).items():
                    word = plain[found]
                    h = zlib.crc32(word.encode(), begin)
                    if h % how.spoil == 0:
                        h %= len(word)
                        word = word[:h] + word[h + 1 :]
                        if len(word) < how.least:
                            continue
                    total[word] += n
            plain.trim()
            if len(total) > COUNTS:
                yield from batches(total.items(), schema)
                total.clear()
        yield from batches(total.items(), schema)

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    counted = docs.select(key.alias("id"), text.alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= how.often)


def cells_of(word: str) -> list[int]:
    points = list(map(ord, word))
    return [(a * 256 + b) % CELLS for a, b in zip(points, points[1:])]


def gram_order(words: DataFrame) -> np.ndarray:
    """Rank of each cell, rare first; the driver gets one row for each of a fixed number of cells."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for frame in frames:
            for word in frame.column(0).to_pylist():
                total.update(cells_of(word))
        yield from batches(total.items(), schema)

    number = np.zeros(CELLS, "i8")
    for r in words.select("word").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        number[r["cell"]] = r["n"]
    rank = np.empty(CELLS, "i8")
    rank[np.lexsort((np.arange(CELLS), number))] = np.arange(CELLS)
    return rank


def prefix(ranks: list[int]) -> list[tuple[int, int]]:
    """(rank, place) of a word's three first bigrams and those that tie with the third, by rank."""
    order = sorted((r, i) for i, r in enumerate(ranks))
    end = order[2][0]
    return [x for x in order if x[0] <= end]


def pivots(grams: list[tuple[int, int]], wanted: int = 2) -> list[tuple[int, int]]:
    """``wanted`` disjoint ones of the grams (rank, place) with the least sum of ranks.

    best[k] is the cheapest choice of k grams among those seen so far, from left to right; ``apart`` what it was
    when all grams were seen that end before this one, and no other.
    """
    best: list = [(0, ())] + [None] * wanted
    history = []  # (place, best before it was seen)
    for place, rank in sorted((p, r) for r, p in grams):
        history.append((place, list(best)))
        apart = next(b for p, b in history if p >= place - 1)
        for k in range(wanted, 0, -1):
            if apart[k - 1] is not None:
                choice = apart[k - 1][0] + rank, (*apart[k - 1][1], (rank, place))
                if best[k] is None or choice < best[k]:
                    best[k] = choice
    return list(best[wanted][1])


def halves(size: int) -> tuple[int, int]:
    """Code points of the left and of the right half of a word."""
    return size // 2, size - size // 2


def entries_of(words: DataFrame, rank: np.ndarray) -> DataFrame:
    """key, pivot (else of the prefix), word, n, place of the gram and rank at the prefix's end."""
    held = words.sparkSession.sparkContext.broadcast(rank)
    fields = [("key", pa.int64()), ("pivot", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("place", pa.int32()), ("last", pa.int32())]
    schema = pa.schema(fields)

    def make(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        def key(side: int, half: str, gram: int) -> int:
            h = xxh3_64_intdigest(half.encode(), 2 * gram + side)
            return h - (1 << 64) if h >> 63 else h

        def each():
            rank = held.value
            for frame in frames:
                for word, n in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                    size = len(word)
                    grams = prefix(rank[cells_of(word)].tolist())
                    last = grams[-1][0]
                    left, right = halves(size)
                    for r, place in pivots(grams):
                        yield key(0, word[:left], r), True, word, n, place, last
                        yield key(1, word[size - right :], r), True, word, n, place, last
                    # halves of the words that may come: one shorter, as long, one longer
                    near = [halves(m) for m in (size - 1, size, size + 1)]
                    begins, ends = ({word[:a] for a, _ in near}, {word[size - b :] for _, b in near})
                    for r, place in grams:
                        for half in begins:
                            yield key(0, half, r), False, word, n, place, last
                        for half in ends:
                            yield key(1, half, r), False, word, n, place, last

        yield from batches(each(), schema)

    return words.mapInArrow(make, "key long, pivot boolean, word string, n long, place int, last int")


def dealt(entries: DataFrame, how: Words) -> DataFrame:
    """``entries`` with cell: a key with too many of a kind goes over a grid, each pivot meeting each prefix gram in one cell of it."""
    sizes = entries.groupBy("key").agg(F.count_if("pivot").alias("rows"), F.count_if(~F.col("pivot")).alias("columns"))
    grid = sizes.filter((F.col("rows") > 0) & (F.greatest("rows", "columns") > how.side))
    grid = materialize(grid.select("key", *[F.ceil(F.col(c) / how.side).cast("int").alias(c) for c in ("rows", "columns")]))
    if grid.isEmpty():
        return entries.withColumn("cell", F.lit(0))
    rows, columns = (F.coalesce(c, F.lit(1)) for c in ("rows", "columns"))
    own = lambda count: F.pmod(F.xxhash64("word", "place"), count).cast("int")
    across = F.transform(F.sequence(F.lit(0), columns - 1), lambda c: own(rows) * columns + c)
    down = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: r * columns + own(columns))
    cell = F.explode(F.when(F.col("pivot"), across).otherwise(down)).alias("cell")
    return entries.join(grid, "key", "left").select(*entries.columns, cell)


def near_pairs(entries: DataFrame) -> DataFrame:
    """Distinct pairs a < b of near words, with their occurrences."""
    schema = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])
    columns = ("key", "cell", "pivot", "word", "n", "place", "last")

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for frame in frames:
            table = pa.Table.from_batches([frame] if rest is None else [*rest.to_batches(), frame]).combine_chunks()
            key, cell = (table.column(i).to_numpy() for i in (0, 1))
            cut = table.num_rows  # rows of the last key wait for more of it
            if cut:
                cut = int(np.flatnonzero((key == key[-1]) & (cell == cell[-1]))[0])
            rest = table.slice(cut)
            yield from met(table.slice(0, cut), schema)
        if rest is not None:
            yield from met(rest, schema)

    sql = "a string, n_a long, b string, n_b long"
    met_pairs = entries.select(*columns).repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(compare, sql)
    return met_pairs.distinct()


def met(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Near pairs among entries that are sorted by key and cell."""
    if not table.num_rows:
        return
    key, cell = (table.column(i).to_numpy() for i in (0, 1))
    pivot = table.column(2).to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    group = np.cumsum(new) - 1
    rows, heads = np.flatnonzero(pivot), np.flatnonzero(~pivot)
    count = np.bincount(group[heads], minlength=group[-1] + 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    rows = rows[count[group[rows]] > 0]
    if not len(rows):
        return
    used = np.flatnonzero((np.bincount(group[rows], minlength=len(count)) > 0)[group])
    words = table.column(3).take(pa.array(used)).to_pylist()
    n, place, last = (table.column(i).to_numpy() for i in (4, 5, 6))
    size, letters, code = (np.zeros(len(group), t) for t in ("i4", "u8", "i8"))
    codes = points_of(words)
    size[used] = [len(w) for w in words]
    letters[used] = np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << (codes & 63).astype("u8"), np.uint64(0)), axis=1)
    code[used] = np.arange(len(used))
    pairs = count[group[rows]]
    at = np.cumsum(pairs)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + PAIRS, "right")))
        each = pairs[start:stop]
        x = np.repeat(rows[start:stop], each)
        y = heads[np.arange(len(x)) + np.repeat(first[group[rows[start:stop]]] - np.cumsum(each) + each, each)]
        start = stop
        longer, moved = size[y] - size[x], place[y] - place[x]
        ok = (np.abs(longer) <= 1) & ((moved == 0) | (moved == longer)) & (last[x] <= last[y])
        x, y = x[ok], y[ok]
        # a spoiled letter leaves the set and a new one joins it; letters beyond the table's width are not in it
        ok = (np.bitwise_count(letters[x] ^ letters[y]) <= 2) | (np.maximum(size[x], size[y]) > WIDE)
        x, y = code[x[ok]], code[y[ok]]
        ok = one_edit(codes, words, x, y)
        both = np.unique(np.stack([x[ok], y[ok]], 1), axis=0)
        numbers = n[used]
        out = []
        for i, j in both.tolist():
            i, j = (i, j) if words[i] < words[j] else (j, i)
            out.append((words[i], int(numbers[i]), words[j], int(numbers[j])))
        yield from batches(out, schema)


def points_of(words: list[str]) -> np.ndarray:
    """Code points, a word a row, zeros behind it; long words are cut at ``WIDE``."""
    width = min(WIDE, max(map(len, words))) + 1  # the last column is of zeros
    return np.array([w[: width - 1] for w in words], f"<U{width}").view("<u4").reshape(len(words), width)


def one_edit(codes: np.ndarray, words: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words x[i] and y[i] differ by exactly one inserted, deleted or replaced code point."""
    out = np.zeros(len(x), bool)
    size = np.array([len(w) for w in words])
    long = np.maximum(size[x], size[y]) > WIDE
    out[long] = [one_edit_apart(words[i], words[j]) for i, j in zip(x[long].tolist(), y[long].tolist())]
    swap = size[x] > size[y]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    same = np.flatnonzero(~long & (size[a] == size[b]))
    out[same] = (codes[a[same]] != codes[b[same]]).sum(axis=1) == 1
    more = np.flatnonzero(~long & (size[a] + 1 == size[b]))
    short, wide = codes[a[more]], codes[b[more]]
    begin = np.argmax(short != wide, axis=1)  # code points in common from the left
    shifted = short[:, :-1] != wide[:, 1:]
    end = np.where(shifted.any(axis=1), shifted.shape[1] - np.argmax(shifted[:, ::-1], axis=1), 0)  # behind the last that is not in common from the right
    out[more] = end <= begin
    return out


def one_edit_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) - len(a) <= 1 and a != b and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants(docs: DataFrame, how: Words = Words(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root (string), n, n_near, form_n (long).

    n_near counts the near words: those one inserted, deleted or replaced code point away. form is the near word with the most occurrences, then
    the first in code-point order, if it has ``ratio`` times the word's; else null, as form_n. root follows forms to
    the last, or is the word. Ids are read as text, and only for ``spoil``; a null id counts as an empty one there. Null, empty and wordless
    texts add nothing; repeated rows count again; an empty table gives an empty result. Other columns are not read.
    """
    words = materialize(count_words(docs, how, id_col, text_col))
    entries = materialize(entries_of(words, gram_order(words)))
    pairs = materialize(near_pairs(dealt(entries, how)))
    turned = pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(turned)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    joined = words.join(sides.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
    often = -F.col("best.less") >= how.ratio * F.col("n")
    named = materialize(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = last_forms(named.filter("form is not null").select("word", F.col("form").alias("root")))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_forms(steps: DataFrame) -> DataFrame:
    """word and root, at the end of its steps (word, root). Each round doubles the steps taken; a form occurs more often, so none comes back."""
    steps = materialize(steps)
    while True:
        on: Column = F.col("next.root")
        further = steps.alias("here").join(steps.alias("next"), F.col("here.root") == F.col("next.word"), "left")
        steps = materialize(further.select("here.word", F.coalesce(on, "here.root").alias("root"), on.isNotNull().alias("moved")))
        if steps.filter("moved").isEmpty():
            return steps.drop("moved")
        steps = steps.drop("moved")

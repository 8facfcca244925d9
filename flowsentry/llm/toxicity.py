"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning reads a bounded number of labelled rows. Spark counts, over all of them, in how many toxic and other texts
each term stands. All words of those texts are terms, those of clean texts too; beginnings of words and repeats within a text are
terms where they are tied to a label. A text is the vector of its terms' frequencies times their inverse document frequencies, each times
1 + the root of its log-likelihood ratio with the label, so that words which tell the labels apart weigh most and no word weighs nothing.

The examples' vectors are indexed by term. Short lists are read whole. A list that holds a large part of the examples is kept
as a column, and by its largest weight in each block of neighbouring examples; a query visits groups of blocks by falling upper
bound and stops when no bound reaches its k-th best cosine, so what it returns is exactly the k nearest. Their votes,
weighted by nearness, become a probability by a monotone map fitted on votes of examples about each other. The
neighbours are the evidence.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsentry.functions.net import once
from flowsentry.llm.common import Memo, batches, texts
from flowsentry.plans.storage import materialize

WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are terms too, and counts in a text from which on a term counts as a further one.
BEGINNINGS, LEVELS = range(4, 9), (2, 3, 5)


@dataclass(frozen=True)
class Settings:
    """``fit_rows``: the documented bound of labelled rows that are used, the first by a hash of their id.

    ``tie``: log-likelihood ratio with the label from which on a beginning of a word, or a repeat, is a term (words always are);
    ``alike``: Jaccard similarity of three-word sets from which on a row is a copy; ``neighbours``: k; ``near``: added to a
    neighbour's distance before it divides the vote; ``block``: examples that share a bound.
    """

    fit_rows: int = 20_000
    tie: float = 40.0
    alike: float = 0.8
    neighbours: int = 15
    near: float = 0.1
    block: int = 8


def terms_of(part: str) -> list[str]:
    """Terms of the words in a part without blanks: each word, and '^' with its beginnings."""
    out = []
    for w in WORD.findall(part.lower()):
        out.append(w)
        out += ["^" + w[:n] for n in BEGINNINGS if n < len(w)]
    return out


def levels(term: str, count: int) -> list[str]:
    """The term, and '*' with each count that it reaches."""
    return [term, *(f"{term}*{n}" for n in LEVELS if count >= n)]


def pieces(frames: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows."""
    for frame in frames:
        for at in range(0, frame.num_rows, rows):
            yield frame.slice(at, rows)


#: A list with one example in COMMON or more, or WIDE at all, is a column; blocks in a group; lists are taken whole from a length of LONG on.
COMMON, WIDE, GROUP, LONG = 8, 1200, 32, 128
#: Queries that are searched together, and rows of columns that are read in double precision at once.
TOGETHER, ROWS = 128, 512


class BlockMaxIndex:
    """Unit vectors, as (term numbers, weights), under their places in a list."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int):
        self.size, self.block = len(vectors), block
        term = np.concatenate([np.zeros(0, "i4"), *(t for t, _ in vectors)]).astype("i4")
        order = np.argsort(term, kind="stable")
        place = np.repeat(np.arange(self.size, dtype="i4"), [len(t) for t, _ in vectors])[order]
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])[order]
        groups = max(1, -(-self.size // (block * GROUP)))
        self.room = groups * GROUP * block
        lists = np.bincount(term, minlength=terms)
        common = np.flatnonzero(lists >= max(1.0, min(self.size / COMMON, WIDE)))
        self.column = np.full(terms, -1, "i4")
        self.column[common] = np.arange(len(common))
        self.columns = len(common)
        inside = self.column[term[order]]
        del term, order
        wide = inside >= 0
        # weights of the columns in single precision, what that leaves of them, and the largest in each block
        cell, given = (place[wide], inside[wide]), weight[wide]
        self.cells, self.rest = (np.zeros((self.room, self.columns), "f4") for _ in range(2))
        self.cells[cell] = given
        self.rest[cell] = given - self.cells[cell]
        self.most = self.cells.reshape(self.room // block, block, -1).max(1)
        #: A cosine from the cells alone is off by less: unit vectors' products of weights add up to 1 at most.
        self.slack = (self.columns + 8) * 2.0**-23
        self.place, self.weight = place[~wide], weight[~wide]
        lists[common] = 0
        self.start = np.concatenate([[0], np.cumsum(lists)])

    def from_short(self, who: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """What the lists that are no columns give each example, for each of ``n`` queries; ``who`` has a term's query, in order."""
        first, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        got = np.empty((n, self.room))
        ends = np.searchsorted(who, np.arange(n + 1)).tolist()
        for q, (a, b) in enumerate(zip(ends, ends[1:])):  # one at a time: its places stay in the cache
            f, m, w = first[a:b], size[a:b], weights[a:b]
            long = m >= LONG
            order = np.argsort(long, kind="stable")
            brief = order[: len(order) - np.count_nonzero(long)]
            k = m[brief]
            at = np.arange(int(k.sum())) + np.repeat(f[brief] - (np.cumsum(k) - k), k)
            whole = [slice(i, j) for i, j in zip(f[long].tolist(), (f[long] + m[long]).tolist())]
            given = np.concatenate([self.weight[at], *(self.weight[x] for x in whole)])
            given *= np.repeat(w[order], m[order])
            got[q] = np.bincount(np.concatenate([self.place[at], *(self.place[x] for x in whole)]), given, self.room)
        return got

    def nearest(self, cuts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k largest cosines above 0 of each query, by query, falling cosine, then place: numbers of queries, cosines, places.

        Query i has the terms and weights from ``cuts[i]`` to ``cuts[i + 1]``. A group of blocks is visited by all queries at once whose
        bound there reaches their k-th best cosine so far; each query's first group comes first, then the next three, then the others.
        Columns are multiplied in single precision there; examples that may be among the k best by ``slack`` are computed again in double.
        """
        n, size = len(cuts) - 1, GROUP * self.block
        who, column = np.repeat(np.arange(n), np.diff(cuts)), self.column[terms]
        wide = column >= 0
        short = self.from_short(who[~wide], terms[~wide], weights[~wide], n)
        query = np.zeros((n, self.columns))
        query[who[wide], column[wide]] = weights[wide]
        single = query.astype("f4")
        bound = np.maximum.reduceat(short, np.arange(0, self.room, self.block), axis=1)
        bound += single @ self.most.T
        bound = bound.reshape(n, -1, GROUP).max(2)
        rank = np.empty(bound.shape, "i8")
        np.put_along_axis(rank, np.argsort(-bound, axis=1, kind="stable"), np.arange(bound.shape[1])[None], 1)
        floor, best = np.full(n, 1e-300), np.full((n, k), -1.0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in ((0, 1), (1, 4), (4, bound.shape[1])):
            wanted = (rank >= low) & (rank < high) & (bound >= floor[:, None])
            for g in np.flatnonzero(wanted.any(0)).tolist():
                asked = np.flatnonzero(wanted[:, g])
                cosine = short[:, g * size : g * size + size][asked]
                cosine += single[asked] @ self.cells[g * size : g * size + size].T
                if without // size == g:
                    cosine[:, without % size] = 0.0
                some, at = np.nonzero(cosine >= floor[asked, None])
                found.append((asked[some], cosine[some, at], at + g * size))
                both = np.concatenate([best[asked], cosine], axis=1)
                best[asked] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            floor = np.maximum(1e-300, best.min(1) - 2 * self.slack)
        q, cosine, at = (np.concatenate([np.zeros(0, t), *(f[i] for f in found)]) for i, t in enumerate(("i8", "f8", "i8")))
        left = cosine >= floor[q]
        q, at = q[left], at[left]
        cosine = short[q, at]
        for i in range(0, len(q), ROWS):
            x, y = at[i : i + ROWS], q[i : i + ROWS]
            cosine[i : i + ROWS] += np.einsum("ij,ij->i", self.cells[x] + self.rest[x].astype(float), query[y])
        cosine = cosine.round(12)
        order = np.lexsort((at, -cosine, q))
        q, cosine, at = q[order], cosine[order], at[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], cosine[first], at[first]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k largest (cosine, place) above 0 of one query, by falling cosine, then place; ``without`` is left out."""
        _, cosine, place = self.nearest(np.array([0, len(terms)]), terms, weights, k, without)
        return list(zip(cosine.tolist(), place.tolist()))


class Parts(dict):
    """Numbers of the parts of texts: 0 without terms, i + 1 for term i alone, and more for others, which ``other`` numbers."""

    def __init__(self, terms: dict[str, int], heads: set[str], other: Callable[[str], int]):
        super().__init__()
        self.term, self.heads, self.other = terms.get, heads, other

    def __missing__(self, part: str) -> int:
        w = part.lower()
        if not w.isalnum():
            w = w.rstrip(".,;:!?")
        if w.isalnum() and w[: BEGINNINGS[0]] not in self.heads:
            number = self.term(w, -1) + 1
        else:
            number = self.other(part)
        self[part] = number
        return number


class Reader:
    """Turns texts into terms and their counts. A part of a text is looked up once while it is remembered."""

    LIMIT = 200_000

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.heads = {t[1 : 1 + BEGINNINGS[0]] for t in terms if t[0] == "^"}
        self.more = {n: np.full(len(terms) + 1, -1, "i4") for n in LEVELS}  # the further term of a term, or -1
        for t, i in terms.items():
            base, star, n = t.rpartition("*")
            if star and base in terms:
                self.more[int(n)][terms[base]] = i
        self.forget()

    def forget(self) -> None:
        """The parts that are known by number; number ``len(terms) + 1 + i`` has the terms from ``first[i]`` to ``first[i + 1]`` of ``flat``."""
        self.known, self.flat, self.first = Parts(self.terms, self.heads, self.learn), array("i"), array("q", [0])

    def learn(self, part: str) -> int:
        found = [i for t in terms_of(part) if (i := self.terms.get(t)) is not None]
        if len(found) < 2:
            return found[0] + 1 if found else 0
        self.flat.extend(found)
        self.first.append(len(self.flat))
        return len(self.terms) + len(self.first) - 1

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cuts between texts, and each one's terms in order, with counts."""
        if len(self.known) > self.LIMIT:
            self.forget()
        known, every = self.known, max(1, len(self.terms))
        numbers = [np.fromiter(map(known.__getitem__, parts := text.split()), "i8", len(parts)) for text in texts]
        part = np.concatenate([np.zeros(0, "i8"), *numbers])
        n = (part > 0).astype("i8")
        several = np.flatnonzero(part > len(self.terms))
        first = np.array(self.first, "i8")
        listed = part[several] - len(self.terms) - 1
        size = n[several] = first[listed + 1] - first[listed]
        term = np.repeat(part - 1, n)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        term[np.repeat((np.cumsum(n) - n)[several], size) + step] = np.array(self.flat, "i8")[np.repeat(first[listed], size) + step]
        who = np.repeat(np.repeat(np.arange(len(texts)), [len(x) for x in numbers]), n)
        cell, count = np.unique(who * every + term, return_counts=True)
        term = cell % every
        more = [(cell - term + i)[(i >= 0) & (count >= n)] for n, further in self.more.items() if len(i := further[term])]
        if extra := sum(map(len, more)):
            cell, count = np.concatenate([cell, *more]), np.concatenate([count, np.ones(extra, "i8")])
            order = np.argsort(cell)
            cell, count = cell[order], count[order]
        return np.searchsorted(cell, np.arange(len(texts) + 1) * every), (cell % every).astype("i4"), count


class Model:
    """Terms, examples and calibration; small enough to broadcast: its size is bounded by ``fit_rows`` texts.

    It travels as terms and the examples' counts, compressed; a worker builds the index again.
    """

    def __init__(self, terms: dict[str, int], factor: np.ndarray, how: Settings, empty: float):
        self.terms, self.factor, self.how, self.empty = terms, factor, how, empty
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.shared = None
        self.learn([], [], [])

    def learn(self, places: list[int], toxic: list[int], counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Takes the examples: ids, labels, and (term numbers, counts)."""
        self.places, self.toxic, self.counts = places, np.array(toxic, float), counts

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Built where it is searched: the driver has no use for it."""
        return BlockMaxIndex([self.weighed(*c) for c in self.counts], max(1, len(self.terms)), self.how.block)

    def indexed(self) -> Model:
        """For a worker's copy, which is searched and not sent on: the index takes the place of the examples' counts."""
        if self.index.size and self.counts:
            self.counts = []
        return self

    def __getstate__(self):
        flat = [np.concatenate([np.zeros(0, "i4"), *(c[i] for c in self.counts)]).astype("i4") for i in (0, 1)]
        sizes = [len(t) for t, _ in self.counts]
        state = (list(self.terms), self.factor, self.how, self.empty, self.steps, self.places, self.toxic, sizes, np.diff(flat[0], prepend=np.int32(0)), flat[1])
        return zlib.compress(pickle.dumps(state), 1)

    def __setstate__(self, state):
        terms, self.factor, self.how, self.empty, self.steps, places, toxic, sizes, steps, counts = pickle.loads(zlib.decompress(state))
        self.terms, self.shared = dict(zip(terms, range(len(terms)))), None
        cuts = np.cumsum(sizes, dtype="i8")[:-1]
        flat = np.cumsum(steps, dtype="i4"), counts
        self.learn(places, toxic, list(zip(*(np.split(f, cuts) for f in flat))) if sizes else [])

    def share(self, spark):
        """One broadcast for calibration and scoring."""
        self.shared = self.shared or spark.sparkContext.broadcast(self)
        return self.shared

    def weighed(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.factor[terms]
        return terms, w / math.sqrt(float(w @ w))

    def ballot(self, near: list[tuple[float, int]]) -> float | None:
        """Share of toxic ones among (cosine, place), by nearness."""
        if not near:
            return None
        w = [1 / (1 - min(1.0, s) + self.how.near) for s, _ in near]
        return float(sum(x * self.toxic[i] for x, (_, i) in zip(w, near)) / sum(w))

    def nearest(self, cuts: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """The k nearest examples, as (cosine, place), of each vector of counts; none of an empty one."""
        w = (1 + np.log(counts)) * self.factor[terms]
        who = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        w /= np.sqrt(np.bincount(who, w * w, len(cuts) - 1))[who]
        q, cosine, place = self.index.nearest(cuts, terms, w, k)
        ends = np.searchsorted(q, np.arange(len(cuts))).tolist()
        pairs = list(zip(cosine.tolist(), place.tolist()))
        return [pairs[i:j] for i, j in zip(ends, ends[1:])]

    def score(self, vote: float | None) -> float:
        return self.empty if vote is None else float(np.interp(vote, *self.steps))


def is_learned(id_col: str = "doc_id"):
    """Rows labels may be learned from: a third of the ids, by checksum, is held out; a null id is neither."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, how: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from rows of ``labels`` that are not held out. Without toxic rows every score is that of a text without terms."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & is_learned()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.fit_rows)
    )
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") != 0).cast("int").alias("toxic"))
    rows = materialize(one_of_copies(rows, how.alike))
    counted = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()

        def rows_of():
            for t in set(held[0]) | set(held[1]):
                yield t, held[1][t], held[0][t]
            held[0].clear()
            held[1].clear()

        known = Memo(terms_of, 100_000)
        for frame in frames:
            for text, toxic in zip(frame.column(0), frame.column(1).to_pylist()):
                counts = Counter(chain.from_iterable(map(known.__getitem__, text.as_py().split())))
                held[toxic].update(counts.keys())
                held[toxic].update(x for t, c in counts.items() if c > 1 for x in levels(t, c)[1:])
                known.trim()
                if len(held[0]) + len(held[1]) > 400_000:
                    yield from batches(rows_of(), counted)
        yield from batches(rows_of(), counted)

    total = rows.agg(F.sum("toxic"), F.count("*")).first()
    n1, n = total[0] or 0, total[1]
    n0 = n - n1
    if not n1 or not n0:
        return Model({}, np.zeros(0), how, (n1 + 0.5) / (n + 1))
    a, b = F.col("toxic"), F.col("clean")
    part = lambda seen, hoped: F.when(seen > 0, seen * F.log(seen / hoped)).otherwise(0.0)
    tie = 2 * (
        part(a, (a + b) * n1 / n) + part(b, (a + b) * n0 / n) + part(n1 - a, (n - a - b) * n1 / n) + part(n0 - b, (n - a - b) * n0 / n)
    )
    kept = (
        rows.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .select("term", (a + b).alias("df"), F.greatest(tie, F.lit(0.0)).alias("tie"))
        .filter(~F.col("term").rlike(r"[\^*]") | (F.col("tie") >= how.tie)).toArrow().sort_by("term")
    )
    df, ties = kept["df"].to_numpy(), kept["tie"].to_numpy()
    model = Model(dict(zip(kept["term"].to_pylist(), range(len(df)))), (np.log((1 + n) / (1 + df)) + 1) * (1 + np.sqrt(ties)), how, 0.0)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    shape = "doc_id long, toxic int, terms array<int>, counts array<int>"
    arrow = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def vectors(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(held.value.terms)

        def each():
            for part in pieces(frames, TOGETHER):
                cuts, terms, counts = read(part.column(1).to_pylist())
                for i, toxic, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), cuts.tolist(), cuts.tolist()[1:]):
                    if a < b:
                        yield i, toxic, terms[a:b], counts[a:b]

        yield from batches(each(), arrow, lambda row: 8 * len(row[2]))

    vectors_of = materialize(rows.mapInArrow(vectors, shape))
    held.destroy()
    got = vectors_of.toArrow()
    terms, counts = (got[c].combine_chunks() for c in ("terms", "counts"))
    cuts = np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    flat = (np.split(c.flatten().to_numpy(), cuts) for c in (terms, counts))
    examples = list(zip(*flat)) if len(got) else []
    heaviest = [int(t[model.weighed(t, c)[1].argmax()]) for t, c in examples]
    ids, toxic = got["doc_id"].to_pylist(), got["toxic"].to_pylist()
    # neighbours in the list share their most frequent term, mostly of their language, and their heaviest, which keeps block maxima apart
    order = sorted(range(len(examples)), key=lambda i: (int(examples[i][0][df[examples[i][0]].argmax()]), -toxic[i], heaviest[i], ids[i]))
    model.learn([ids[i] for i in order], [toxic[i] for i in order], [examples[i] for i in order])
    seen = int(model.toxic.sum())
    model.empty = (n1 - seen + 0.5) / (n - len(order) + 1)
    calibrate(vectors_of, model)
    return model


def one_of_copies(rows: DataFrame, alike: float) -> DataFrame:
    """Without copies: of rows of one label whose least hash of three words is the same, those like the first one.

    ``alike`` is the Jaccard similarity with the first row's set of three-word hashes. Copies would tie their own words to the label.
    """
    words = F.col("words")
    three = F.array_distinct(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    hashed = lambda df: df.select(
        *df.columns, once(F.struct(F.split("text", r"\s+").alias("words")))
    ).select(*df.columns, three.alias("three"))
    keyed = materialize(hashed(rows).select("doc_id", "text", "toxic", F.array_min("three").alias("key")))
    shared = keyed.groupBy("key", "toxic").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # at most half as many keys as rows, which ``fit_rows`` bounds
    placed = keyed.join(F.broadcast(shared), ["key", "toxic"], "left")
    members = hashed(placed.filter("doc_id <> first"))
    owners = hashed(placed.filter("doc_id = first")).groupBy("key", "toxic").agg(F.min_by("three", F.xxhash64("three")).alias("firsts"))
    both = F.size(F.array_intersect("three", "firsts"))
    other = members.join(owners, ["key", "toxic"]).filter(both < alike * (F.size("three") + F.size("firsts") - both))
    return placed.filter("first is null or doc_id = first").select("doc_id", "text", "toxic").unionByName(other.select("doc_id", "text", "toxic"))


def calibrate(vectors: DataFrame, model: Model) -> None:
    """Steps from votes to shares of toxic examples, each example voted on by those of other ids; shares may not fall."""
    if not model.places:
        return
    held = model.share(vectors.sparkSession)

    def votes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value.indexed()
        k, places = m.how.neighbours, defaultdict(set)
        for place, i in enumerate(m.places):
            places[i].add(place)
        for frame in pieces(frames, TOGETHER):
            terms, counts = frame.column(2), frame.column(3)
            cuts = np.append(0, np.cumsum(terms.value_lengths().to_numpy()))
            own = [places[i] for i in frame.column(0).to_pylist()]
            near = m.nearest(cuts, terms.flatten().to_numpy(), counts.flatten().to_numpy(), k + max(map(len, own)))
            votes = [m.ballot([x for x in found if x[1] not in mine][:k]) for found, mine in zip(near, own)]
            bins = [None if vote is None else round(vote * 50) for vote in votes]
            yield pa.RecordBatch.from_pydict({"bin": pa.array(bins, pa.int32()), "toxic": frame.column(1)})

    bins = (
        vectors.repartition(max(1, min(64, len(model.places) // 200))).mapInArrow(votes, "bin int, toxic int")
        .filter("bin is not null").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).orderBy("bin").collect()
    )
    pools: list[list[float]] = []  # adjacent bins that would fall are pooled
    for r in bins:
        pools.append([r["toxic"], r["n"], r["bin"] / 50 * r["n"]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    if pools:
        model.steps = (np.array([x / n for _, n, x in pools]), np.array([(t + 0.5) / (n + 1) for t, n, _ in pools]))
        model.steps = (model.steps[0], np.maximum.accumulate(model.steps[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence: array<struct<doc_id, similarity, toxic>> (nearest examples first); one row per input row.

    A null or empty text, or one without any learned term, gets the share of toxic ones among such examples, and no evidence. Repeated
    rows stay, a null id stays null, an empty table gives an empty result; ties go to the example that stands first.
    """
    held, empty, steps = model.share(docs.sparkSession), model.empty, model.steps
    near = pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(near))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        m = held.value.indexed()
        m.empty, m.steps = empty, steps  # calibrated after the examples were sent
        read = Reader(m.terms)
        known: dict[bytes, tuple[float, list[dict]]] = {}  # copies of a text are looked up once

        def each():
            for part in pieces(frames, TOGETHER):
                values = part.column(1).to_pylist()
                digests = [xxhash.xxh3_128_digest(text) for text in values]
                if len(known) >= 4_000:
                    known.clear()
                if new := {d: text for d, text in zip(digests, values) if d not in known}:
                    for d, near in zip(new, m.nearest(*read(list(new.values())), m.how.neighbours)):
                        known[d] = m.score(m.ballot(near)), [{"doc_id": m.places[i], "similarity": s, "toxic": int(m.toxic[i])} for s, i in near]
                for doc_id, d in zip(part.column(0).to_pylist(), digests):
                    yield doc_id, *known[d]

        yield from batches(each(), schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>")

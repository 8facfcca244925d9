"""All pairs of 64-bit fingerprints that differ in a few bits, joined into components by vantage-point trees.

A node has a vantage fingerprint and splits by Hamming distance to it, over one block of the bits. By the triangle inequality
two fingerprints differ in a block by no less than their distances to the vantage do; differences of several blocks add
up, so a branch is left out when the bounds on the way to it sum to more than the radius.

A tree over a bounded sample cuts the fingerprints into shards. Each fingerprint lives in one shard and visits those
later ones that its bound does not rule out, so a pair near a boundary meets in exactly one task. A task builds a tree over its
shard and searches it for the shard's own and the visiting fingerprints. It hands on components, not pairs: members of one
component are not compared again, so a crowd of near copies costs a link for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The bit blocks that distances are taken over: halves rule out most, where a tree is some five to ten levels deep.
WIDTH = 32
BLOCKS = [np.uint64(((1 << WIDTH) - 1) << s) for s in range(0, 64, WIDTH)]
#: Cells of one table of distances; visitors that one search takes; fingerprints that a task sends at once.
TABLE, VISITORS, SENT = 1 << 20, 1 << 16, 1 << 20


@dataclass(frozen=True)
class Search:
    """``radius``: bits in which linked fingerprints may differ. ``sample``: fingerprints that the shards' cuts are chosen by,
    ``shard``: fingerprints wanted in one, ``leaf``: those compared one by one. They decide speed only."""

    radius: int = 4
    sample: int = 1 << 16
    shard: int = 1 << 15
    leaf: int = 128


class Tree:
    """Nodes in depth-first order, so leaves are numbered from left to right."""

    def __init__(self, points: np.ndarray, leaf: float):
        self.members: list[np.ndarray] = []
        self.root = self.grow(points, np.arange(len(points)), max(1, leaf))

    def grow(self, points: np.ndarray, at: np.ndarray, leaf: float):
        cut = best_cut(points[at], points[at[0]]) if len(at) > leaf else None
        if cut is None:
            self.members.append(at)
            return len(self.members) - 1
        block, limit = cut
        vantage = points[at[0]]
        near = distance(points[at], vantage, block) < limit
        return block, vantage, limit, self.grow(points, at[near], leaf), self.grow(points, at[~near], leaf)

    def visits(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, numbers of the points that come to it, their bounds), leaf by leaf. The bound is 0 in a point's own leaf only."""
        start = np.arange(len(points)), np.zeros((len(points), len(BLOCKS)), "u1"), np.zeros(len(points), "u1")
        stack = [(self.root, *start)]
        while stack:
            node, who, bounds, total = stack.pop()
            if not len(who):
                continue
            if isinstance(node, int):
                yield node, who, total
                continue
            block, vantage, limit, near, far = node
            d = distance(points[who], vantage, block).astype("i2")
            for child, gap in ((far, limit - d), (near, d - limit + 1)):
                bound = np.maximum(bounds[:, block], np.maximum(gap, 0).astype("u1"))
                sums = total - bounds[:, block] + bound
                keep = sums <= radius
                to = bounds[keep]
                to[:, block] = bound[keep]
                stack.append((child, who[keep], to, sums[keep]))


def distance(points: np.ndarray, vantage: np.uint64, block: int) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & BLOCKS[block])


def best_cut(points: np.ndarray, vantage: np.uint64) -> tuple[int, int] | None:
    """Block and distance whose two sides the fewest comparisons are expected from; None if no block tells the points apart.

    A point that lies up to four beyond the cut is taken to visit the other side with a chance that falls with that gap.
    """
    best = None
    chance = np.append(0, 0.8 ** np.arange(1, 5))
    for block in range(len(BLOCKS)):
        count = np.bincount(distance(points, vantage, block), minlength=WIDTH + 1) / len(points)
        near = np.cumsum(count)[:-1]  # the cut lies above distance 0, 1, ...
        far = 1 - near
        to_far = np.convolve(count, chance)[1 : WIDTH + 1]
        to_near = np.convolve(count[::-1], chance)[1 : WIDTH + 1][::-1]
        cost = np.where((near > 0) & (count[::-1].cumsum()[::-1][1:] > 0), near * (near + to_near) + far * (far + to_far), np.inf)
        limit = int(np.argmin(cost))
        if cost[limit] < (best[0] if best else np.inf):
            best = cost[limit], block, limit + 1
    return best and best[1:]


class Groups:
    """Components of the shard's own points: ``of[i]`` names the component of point i."""

    def __init__(self, size: int):
        self.of = np.arange(size)
        self.parent = list(range(size))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins components x[i] and y[i]."""
        if not len(x):
            return
        pairs = np.unique(np.stack([x, y], 1), axis=0)
        for a, b in pairs.tolist():
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
        seen = np.unique(pairs)
        names = np.arange(len(self.of))
        names[seen] = [self.find(k) for k in seen.tolist()]
        self.of = names[self.of]


class Shard:
    """One shard's points with their tree and components."""

    def __init__(self, points: np.ndarray, how: Search):
        self.points, self.how = points, how
        self.tree = Tree(points, how.leaf)
        self.groups = Groups(len(points))
        home = np.empty(len(points), "i8")
        for leaf, at in enumerate(self.tree.members):
            home[at] = leaf
            self.match(at, at)
        for leaf, who, _ in self.tree.visits(points, how.radius):
            self.match(self.tree.members[leaf], who[home[who] < leaf])

    def match(self, at: np.ndarray, who: np.ndarray) -> None:
        """Joins the components of the points ``who`` and ``at`` that are near each other."""
        of = self.groups.of
        first = of[at[0]]
        if (of[at] == first).all():
            who = who[of[who] != first]
        step = max(1, TABLE // len(at))
        for i in range(0, len(who), step):
            part = who[i : i + step]
            of = self.groups.of
            hit = np.bitwise_count(self.points[part][:, None] ^ self.points[at][None, :]) <= self.how.radius
            hit &= of[part][:, None] != of[at][None, :]
            x, y = np.nonzero(hit)
            self.groups.join(of[part][x], of[at][y])

    def own_links(self) -> tuple[np.ndarray, np.ndarray]:
        member = np.flatnonzero(self.groups.of != np.arange(len(self.points)))
        return self.points[member], self.points[self.groups.of[member]]

    def links_of(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A link from each visitor to one member of each component it is near to."""
        found = [np.zeros((0, 2), "i8")]
        for leaf, who, _ in self.tree.visits(visitors, self.how.radius):
            at = self.tree.members[leaf]
            step = max(1, TABLE // len(at))
            for i in range(0, len(who), step):
                part = who[i : i + step]
                x, y = np.nonzero(np.bitwise_count(visitors[part][:, None] ^ self.points[at][None, :]) <= self.how.radius)
                found.append(np.unique(np.stack([part[x], self.groups.of[at][y]], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return visitors[pairs[:, 0]], self.points[pairs[:, 1]]


def near_links(points: DataFrame, how: Search = Search()) -> DataFrame:
    """(a, b) long: links whose components are those of all pairs of ``points`` within the radius.

    ``points`` has one column of distinct longs, the bits of the fingerprints, and should be stored: it is read three
    times. Every link stands for a path of pairs within the radius; pairs of one component are not all among them.
    """
    column = points.columns[0]
    total = points.count()
    share = min(1.0, how.sample / max(1, total))
    scattered = F.xxhash64(F.col(column), F.lit(1)) / F.lit(2.0**64) + 0.5
    chosen = points.filter(scattered < share) if share < 1 else points
    sample = np.array([r[0] for r in chosen.collect()], "i8").view("u8")
    if len(sample) < 1:
        sample = np.zeros(1, "u8")
    sample.sort()
    tree = Tree(np.random.default_rng(0).permutation(sample), max(how.shard * len(sample) / max(1, total), 16 * (share < 1)))
    held = points.sparkSession.sparkContext.broadcast(tree)
    placed = pa.schema([("shard", pa.int32()), ("visits", pa.bool_()), ("block", pa.binary())])
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, bool], list[np.ndarray]] = {}
        count = 0

        def sent() -> pa.RecordBatch:
            shard, visits = zip(*kept)
            blocks = [np.concatenate(b).tobytes() for b in kept.values()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((shard, visits, blocks), placed.types)], schema=placed)

        for frame in frames:
            p = frame.column(0).to_numpy().view("u8")
            home = np.full(len(p), np.iinfo("i8").max)
            for leaf, who, bound in held.value.visits(p, how.radius):
                own = bound == 0
                home[who[own]] = leaf
                for visits, come in ((False, who[own]), (True, who[home[who] < leaf])):
                    if len(come):
                        kept.setdefault((leaf, visits), []).append(p[come])
                        count += len(come)
            if count > SENT:
                yield sent()
                kept, count = {}, 0
        if kept:
            yield sent()

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], schema=linked)

        for shard, homes, visitors in shards_of(frames):
            here = Shard(homes, how)
            yield links(*here.own_links())
            for v in visitors:
                yield links(*here.links_of(v))

    rows = points.mapInArrow(route, "shard int, visits boolean, block binary")
    parts = min(4 * len(tree.members), 10_000)
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "visits").mapInArrow(search, "a long, b long")


def shards_of(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, Iterator[np.ndarray]]]:
    """(shard, its own points, visitors in bounded blocks) from rows sorted by shard, own points first."""
    pieces = runs(frames)
    ahead = next(pieces, None)
    while ahead is not None:
        shard, homes = ahead[0], []
        while ahead is not None and ahead[:2] == (shard, False):
            homes.append(ahead[2])
            ahead = next(pieces, None)

        def visitors() -> Iterator[np.ndarray]:
            nonlocal ahead
            kept, held = [], 0
            while ahead is not None and ahead[:2] == (shard, True):
                kept.append(ahead[2])
                held += len(ahead[2])
                if held >= VISITORS:
                    yield np.concatenate(kept)
                    kept, held = [], 0
                ahead = next(pieces, None)
            if kept:
                yield np.concatenate(kept)

        come = visitors()
        if homes:
            yield shard, np.concatenate(homes), come
        for _ in come:  # a shard of the sample that no fingerprint lives in has no one to visit
            pass


def runs(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Blocks of one shard and kind."""
    for frame in frames:
        for shard, visits, block in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2)):
            yield shard, visits, np.frombuffer(block.as_py(), "u8")

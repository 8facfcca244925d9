import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowsentry.llm import simhash, vantage
from flowsentry.llm.components import components
from flowsentry.llm.queries import QUERIES
from flowsentry.llm.vantage import Search
from tests.llm.cases import ODD, documents, rows_of, table


def bits_of(text, words=4):
    """The fingerprint from a plain count of every bit."""
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return 0
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(points, radius):
    """Root of each fingerprint, from all pairs."""
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, x in enumerate(points):
        for y in points[k + 1 :]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {p: find(p) for p in points}


def brute(rows):
    bits = [bits_of(t) for _, t in rows]
    root = roots_of(sorted(set(bits)), 4)
    least = {}
    for (i, _), b in zip(rows, bits):
        if i is not None:
            least[root[b]] = min(i, least.get(root[b], i))
    return sorted(((i, f"{b:016x}", least.get(root[b])) for (i, _), b in zip(rows, bits)), key=repr)


def crowds(seed, n, centres):
    """Fingerprints around a few centres at all distances, chains among them, and some anywhere."""
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        at = r.getrandbits(64)
        for _ in range(n // centres):
            x = at
            for b in r.sample(range(64), r.choice([0, 1, 2, 3, 5, 7, 9])):
                x ^= 1 << b
            out.add(x)
            if r.random() < 0.1:
                at = x
    out |= {r.getrandbits(64) for _ in range(n // 3)} | {0, 2**64 - 1}
    return sorted(out)


@pytest.mark.parametrize("seed,n,centres,search", [
    (1, 500, 3, Search(sample=64, shard=20, leaf=4)), (2, 700, 60, Search(sample=300, shard=30, leaf=8)), (3, 600, 9, Search()), (4, 300, 5, Search(radius=7, shard=16, leaf=2)),
])
def test_components_equal_all_pairs(spark, seed, n, centres, search):
    points = crowds(seed, n, centres)
    signed = np.array(points, "u8").view("i8").tolist()
    df = spark.createDataFrame([(p,) for p in signed], "bits long").repartition(3)
    links = vantage.near_links(df, search)
    got = {r.node % 2**64: r.root for r in components(links).collect()}
    want = roots_of(points, search.radius)
    groups = lambda root: sorted(sorted(p for p in points if root(p) == x) for x in {root(p) for p in points})
    assert groups(lambda p: got.get(p, p if p < 2**63 else p - 2**64)) == groups(want.get)
    assert links.count() <= len(points) * 12


def test_every_pair_meets_once_and_bounds_prune():
    r = np.random.default_rng(3)
    points = r.integers(0, 2**63, 4000).astype("u8") * np.uint64(2) + r.integers(0, 2, 4000).astype("u8")
    tree = vantage.Tree(points, 32)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(4000))
    home, met = np.full(4000, -1), 0
    for leaf, who, bound in tree.visits(points, 4):
        home[who[bound == 0]] = leaf
        met += len(who) * len(tree.members[leaf])
    assert all((home[at] == leaf).all() for leaf, at in enumerate(tree.members))
    assert met < 4000 * 4000 * 0.5


def test_bits_follow_the_definition(spark):
    texts = [t for _, t in ODD] + ["a b c d", "A  b\nC d e", "x", "the same words the same words the same words", "é È日 " * 40, "w " * 200_000]
    for t in texts:
        if len(t or "") < 50_000:
            assert simhash.fingerprint((t or "").encode(), simhash.Fingerprints()) == bits_of(t)
    one = simhash.fingerprint(b"one two three four", simhash.Fingerprints())
    assert spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0] % 2**64 == one
    assert simhash.fingerprint(texts[-1].encode(), simhash.Fingerprints()) == simhash.fingerprint(b"w w w w", simhash.Fingerprints())


def test_odd_rows(spark):
    got = simhash.near_copies(table(spark, ODD))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == brute(ODD)
    assert simhash.near_copies(table(spark, ODD).limit(0)).collect() == []
    names = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "z")], "doc_id string, text string")
    assert rows_of(simhash.near_copies(names), "doc_id", "component_id") == [("a", "a"), ("b", "a"), (None, None)]


def test_query_equals_all_pairs(spark, sf):
    got = QUERIES["op12_simhash_near_dedup"](spark, sf)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == brute(documents(spark, sf))

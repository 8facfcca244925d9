import random
import re
from itertools import combinations

import numpy as np
import pytest

from flowsentry.llm import ngram_join as nj
from flowsentry.llm.components import components
from flowsentry.llm.queries import QUERIES
from tests.llm.cases import ODD, documents, rows_of, table


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, how):
    """(id, size of the set, smallest id of the component) from all pairs that share an n-gram."""
    sets = [shingles(t, how.words) for _, t in rows]
    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in {p for v in where.values() for p in combinations(v, 2)}:
        both = len(sets[x] & sets[y])
        if 100 * both >= how.percent * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((find(x), find(y)))
            parent[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def families(seed, groups=12, most=14):
    """Texts and copies with a few words changed: many pairs near the threshold, chains of links, shared passages."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(40))
    passage, rows = [word() for _ in range(30)], []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([2, 5, 30, 80]))]
        if r.random() < 0.4:
            base[1:1] = passage
        for _ in range(r.randint(1, most)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                base = copy
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return [(100 + 3 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed,bucket", [(1, 1000), (2, 2), (3, 3)])
def test_components_equal_all_pairs(spark, seed, bucket):
    how = nj.Similarity(words=3, percent=70, cells=1 << 12, bucket=bucket)
    rows = families(seed) + ODD
    got = nj.link_documents(table(spark, rows), how)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(rows, how)


def test_hot_group_makes_few_pairs(spark):
    """A hub finds most links of a large group of near copies; its pairs are not expanded."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(300):
        copy = list(base)
        copy[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    how = nj.Similarity(words=3, percent=70, cells=1 << 12)
    frame = nj.texts(table(spark, rows), binary=True).selectExpr("text", "doc_id", "monotonically_increasing_id() as row")
    order = spark.sparkContext.broadcast(nj.frequencies(frame, how))
    signed = nj.signatures(frame, how, order)
    entries = signed.selectExpr("row as class", "n", "posexplode(grams) as (at, gram)")
    entries = nj.materialize(entries.join(entries.groupBy("gram").count().withColumnRenamed("count", "members"), "gram"))
    assert nj.hub_pairs(entries, how).count() < 300 * 20
    assert rows_of(nj.link_documents(table(spark, rows), how), "doc_id", "n_shingles", "component_id") == brute(rows, how)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_filter_never_drops_a_link(seed):
    r = np.random.default_rng(seed)
    how = nj.Similarity(words=3, percent=60)
    rank = lambda h: (h % np.uint64(5)).astype("i8")
    for _ in range(300):
        base = r.integers(0, 1 << 30, r.integers(1, 40)).astype("u8")
        sets = [np.unique(np.concatenate([base[r.random(len(base)) < 0.85], r.integers(0, 1 << 30, r.integers(0, 6)).astype("u8")])) for _ in range(2)]
        p, q = (s[np.lexsort((s, rank(s)))] for s in sets)
        common = [(i, int(np.flatnonzero(q == g)[0])) for i, g in enumerate(p) if g in q]
        if common and nj.similar(p, q, how):
            assert nj.suffixes_may_link(p, q, *common[0], how, rank)


def test_components_of_paths_and_stars(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(900, 960)] + [(r.randrange(2000, 2060), r.randrange(2000, 2060)) for _ in range(40)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    want = {k: k for pair in links for k in pair if pair[0] != pair[1]}
    for _ in range(70):
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf):
    got = QUERIES["op2_ngram_jaccard_join"](spark, sf)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(documents(spark, sf), nj.Similarity(4, 85))


def test_no_rows(spark):
    assert nj.link_documents(table(spark, ODD).limit(0)).count() == 0

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowsentry.llm import spelling
from flowsentry.llm.queries import QUERIES
from flowsentry.llm.spelling import Words
from tests.llm.cases import ODD, documents, rows_of, table


def one_apart(a, b):
    """From the definition: some single edit of a is b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count(rows, how):
    total = Counter()
    for i, t in rows:
        for run in re.findall(f"[{how.letters}]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if how.spoil and (h := zlib.crc32(f"{'' if i is None else i}:{run}".encode())) % how.spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= how.least and n >= how.often}


def brute(rows, how):
    total = count(rows, how)
    near, by = {w: [] for w in total}, {}
    for w in total:  # words one edit apart agree in what is left without one code point, or one is that
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(v, []).append(w)
    for a, b in {tuple(sorted(p)) for ws in by.values() for p in itertools.combinations(ws, 2)}:
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, ws in near.items():
        top = min(ws, key=lambda v: (-total[v], v), default=None)
        form[w] = top if top is not None and total[top] >= how.ratio * total[w] else None
    out = []
    for w, n in total.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), total[form[w]] if form[w] else None))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def corpus(seed, words=60):
    """Few letters, so that near words, ties and repeated bigrams abound; counts differ by powers."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(4, 12))) for _ in range(words)] + ["ab" * 4, "aaaaaaaa", "x" * 60, "x" * 30 + "y" * 31]
    out = []
    for w in base:
        out += [w] * r.choice([1, 2, 5, 60])
        for _ in range(4):
            v = list(w)
            for _ in range(r.choice([1, 1, 2])):
                k = r.randrange(len(v))
                v[k : k + 1] = r.choice([[], [r.choice("abcé")], [v[k], r.choice("abcé")]])
            out += ["".join(v)] * r.choice([1, 2, 3, 20])
    r.shuffle(out)
    return [(k, " ".join(out[i : i + 40]) + "! A1") for k, i in enumerate(range(0, len(out), 40))]


@pytest.mark.parametrize("seed,how", [(1, Words(least=4)), (2, Words(least=5, often=1, ratio=3, side=3)), (3, Words(least=4, spoil=3, side=7)), (4, Words())])
def test_equals_all_pairs(spark, seed, how):
    rows = corpus(seed) + ODD
    assert rows_of(spelling.variants(table(spark, rows), how), *COLUMNS) == brute(rows, how)


def test_root_follows_all_forms(spark):
    text = " ".join(["abcdefgh"] * 1000 + ["abcdefgx"] * 100 + ["abcdefyx"] * 10 + ["abcdezyx"])
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), Words(often=1)).collect()}
    assert got["abcdezyx"] == ("abcdefyx", "abcdefgh") and got["abcdefgh"] == (None, "abcdefgh")


def test_pivots_are_the_cheapest_disjoint_pair():
    r = random.Random(5)
    for _ in range(500):
        grams = [(r.randrange(20), p) for p in sorted(r.sample(range(9), r.randint(3, 6)))]
        cheapest = min(a[0] + b[0] for a in grams for b in grams if b[1] - a[1] >= 2)
        (a, p), (b, q) = spelling.pivots(grams)
        assert a + b == cheapest and q - p >= 2


def test_one_edit_tells_pairs_apart():
    r = random.Random(6)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(4, 7))) for _ in range(60)} | {"a" * k for k in (47, 48, 49, 50)} | {"a" * 47 + "b", "b" + "a" * 48})
    x, y = (np.array(v) for v in zip(*itertools.product(range(len(words)), repeat=2)))
    got = spelling.one_edit(spelling.points_of(words), words, x, y)
    assert got.tolist() == [one_apart(words[i], words[j]) for i, j in zip(x, y)]


def test_empty_table(spark):
    assert spelling.variants(table(spark, ODD).limit(0)).collect() == []
    with pytest.raises(ValueError):
        Words(least=3)


def test_query_equals_all_pairs(spark, sf):
    want = brute(documents(spark, sf), Words(spoil=31))
    got = rows_of(QUERIES["op11_spelling_variants"](spark, sf), *COLUMNS)
    assert got == want and any(r[1] for r in want)

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from flowsentry.llm import toxicity as tx
from flowsentry.llm.queries import QUERIES
from tests.llm.cases import ODD, rows_of, table


@pytest.mark.parametrize("seed", range(6))
def test_block_max_search_is_exact(seed):
    r = np.random.default_rng(seed)
    terms, vectors = 30, []
    for _ in range(400):
        t = np.sort(r.choice(terms, r.integers(1, 6), replace=False))
        w = r.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt(w @ w)))
    index = tx.BlockMaxIndex(vectors, terms, 16)
    dense = np.zeros((len(vectors), terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 400, 9):
        t, w = vectors[q]
        for without in (-1, q):
            got = index.top(t, w, 7, without)
            scores = [(float(s), i) for i, s in enumerate(dense[:, t] @ w) if s > 1e-12 and i != without]
            want = sorted(scores, key=lambda x: (-round(x[0], 9), x[1]))[:7]
            assert np.allclose([s for s, _ in got], [s for s, _ in want])
            least = want[-1][0] + 1e-9
            assert {i for s, i in got if s > least} == {i for s, i in want if s > least}


def test_search_over_many_groups_is_exact():
    r = np.random.default_rng(7)
    vectors = []
    for i in range(2500):
        t = np.unique(np.concatenate([r.integers(0, 12, 6) + 12 * (i // 900), r.integers(40, 3000, 8)]))
        w = r.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    index = tx.BlockMaxIndex(vectors, 3000, 4)
    assert (index.column >= 0).any() and index.room > 8 * tx.GROUP * 4
    dense = np.zeros((len(vectors), 3000))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 2500, 83):
        scores = dense @ dense[q]
        scores[q] = 0
        want = sorted(np.flatnonzero(scores > 1e-9), key=lambda i: (-scores[i].round(12), i))[:15]
        got = index.top(*vectors[q], 15, q)
        assert [i for _, i in got] == [int(i) for i in want] and np.allclose([c for c, _ in got], scores[want])


def test_query_of_long_lists_only():
    vectors = [(np.array([i % 9, 9 + i % 2000]), np.array([0.6, 0.8])) for i in range(5000)]
    index = tx.BlockMaxIndex(vectors, 2009, 8)
    assert index.column[0] < 0 and index.start[1] - index.start[0] >= tx.LONG
    assert index.top(np.array([0]), np.array([1.0]), 3) == [(0.6, 0), (0.6, 9), (0.6, 18)]


def plain_vectors(texts, labels):
    """Vectors of texts by the definition, from the texts with labels among them."""
    learned = [(Counter(x for part in texts[i].split() for x in tx.terms_of(part)), y) for i, y in labels]
    every = [({x for t, c in counts.items() for x in tx.levels(t, c)}, y) for counts, y in learned]
    n, n1 = len(every), sum(y for _, y in every)
    cells = Counter((t, y) for terms, y in every for t in terms)
    factor = {}
    for t in {t for t, _ in cells}:
        a, b = cells[t, 1], cells[t, 0]
        table = [(a, (a + b) * n1 / n), (b, (a + b) * (n - n1) / n), (n1 - a, (n - a - b) * n1 / n), (n - n1 - b, (n - a - b) * (n - n1) / n)]
        tie = max(0.0, 2 * sum(x * math.log(x / h) for x, h in table if x))
        if tie >= 40 or not set("^*") & set(t):
            factor[t] = (math.log((1 + n) / (1 + a + b)) + 1) * (1 + math.sqrt(tie))

    def vector(text):
        counts = Counter(x for part in text.split() for x in tx.terms_of(part))
        w = {x: (1 + math.log(c if x == t else 1)) * factor[x] for t, c in counts.items() for x in tx.levels(t, c) if x in factor}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / size for t, v in w.items()}

    return vector


def test_scores_and_evidence_equal_brute_force(spark):
    docs, labels = planted(spark, 400)
    text = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    vector, toxic = plain_vectors(text, known), dict(known)
    unit = {i: vector(t) for i, t in text.items()}
    model = tx.fit(docs, labels)
    assert sorted(model.places) == sorted(toxic)
    seen = 0
    for r in tx.score(docs, model).collect():
        cosine = {j: sum(w * unit[j].get(t, 0.0) for t, w in unit[r.doc_id].items()) for j in toxic}
        best = sorted(cosine.values(), reverse=True)[:15]
        assert np.allclose([e.similarity for e in r.evidence], best)
        assert all(abs(cosine[e.doc_id] - e.similarity) < 1e-9 and e.toxic == toxic[e.doc_id] for e in r.evidence)
        w = [1 / (1 - min(1, e.similarity) + 0.1) for e in r.evidence]
        assert r.score == pytest.approx(np.interp(sum(x * e.toxic for x, e in zip(w, r.evidence)) / sum(w), *model.steps))
        seen += len(r.evidence)
    assert seen == 15 * len(text)


def test_copies_go_only_if_alike(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same, 1), (2, same + " more", 1), (3, same, 0), (4, "w0 w1 w2", 1), (5, "w0 w1 w2 other", 1), (6, "", 0), (6, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    left = sorted(r.doc_id for r in tx.one_of_copies(df, 0.8).collect())
    assert left == [1, 3, 4, 5, 6, 6]  # 4 and 5 share one of three; rows that repeat an id stay


def planted(spark, n=1200):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{r.randrange(300)}" for _ in range(40)]
        toxic = i % 8 == 0
        if toxic:
            for place, w in zip(r.sample(range(40), 3), r.sample(["vile!", "Rotten", "loath" + r.choice(["some", "ing", "ed"])], 3)):
                words[place] = w
        elif i % 50 == 1:
            words[3] = "rotten"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return table(spark, rows), spark.createDataFrame([*labels, (None, 1), (n + 1, None)], "doc_id long, toxic int")


def test_learns_and_scores(spark):
    docs, labels = planted(spark)
    model = tx.fit(docs, labels)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in model.places)
    assert "vile" in model.terms and any(t.startswith("^loat") for t in model.terms)
    got = tx.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert not [r.doc_id for r in got if (r.score >= 0.7) != (r.doc_id % 8 == 0)]
    assert all(r.evidence for r in got if r.doc_id % 8 == 0)
    odd = tx.score(table(spark, ODD), model)
    assert rows_of(odd, "doc_id", "score") == sorted([(i, model.empty) for i, _ in ODD], key=repr)
    assert tx.score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = table(spark, ODD)
    for rows in ([], [(1, 0), (2, 0)], [(1, 1)]):
        model = tx.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert tx.score(docs, model).count() == len(ODD)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    right = sum(p == y for p, y in held)
    clean = [p for p, y in held if not y]
    words = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text rlike '[A-Za-z]'").collect()}
    assert sum(bool(got[i].evidence) for i in words) >= 0.99 * len(words)
    assert right >= 0.93 * len(held) and sum(clean) <= 0.02 * len(clean)


def test_queries_together_equal_single_ones():
    """Common terms, middle and long lists, and a query without terms, in one search."""
    r = np.random.default_rng(3)
    vectors = []
    for i in range(15_000):
        t = np.unique(np.concatenate([r.integers(0, 10, 2), r.integers(10, 30, 3), r.integers(30, 4000, 4)]))
        w = r.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    index = tx.BlockMaxIndex(vectors, 4000, 8)
    dense = np.zeros((len(vectors), 4000))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    asked = [vectors[i] for i in range(0, 15_000, 997)]
    asked.insert(5, (np.zeros(0, "i4"), np.zeros(0)))
    cuts = np.append(0, np.cumsum([len(t) for t, _ in asked]))
    query, cosine, place = index.nearest(cuts, *(np.concatenate([a[i] for a in asked]) for i in (0, 1)), 15)
    for q, (t, w) in enumerate(asked):
        scores = dense[:, t] @ w
        want = sorted(np.flatnonzero(scores > 1e-9).tolist(), key=lambda i: (-scores[i].round(12), i))[:15]
        assert place[query == q].tolist() == want and np.allclose(cosine[query == q], scores[want])


def test_reader_counts_every_term():
    terms = {t: i for i, t in enumerate(["^vile", "^vileness", "ab", "ab*2", "ab*3", "c_d", "straße", "vilely", "vilenesses", "x"])}
    texts = ["Ab, ab. AB! c_d c_d", "", "vilenesses (vilely) x-x 'x' Straße...", "nothing", "ab x"] * 3
    read = tx.Reader(terms)
    for _ in range(2):
        cuts, found, counts = read(texts)
        for i, text in enumerate(texts):
            plain = Counter(t for part in text.split() for t in tx.terms_of(part))
            want = Counter({x: c if x == t else 1 for t, c in plain.items() for x in tx.levels(t, c) if x in terms and t in terms})
            names = list(terms)
            assert {names[t]: c for t, c in zip(found[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]])} == dict(want)
            assert sorted(found[cuts[i] : cuts[i + 1]]) == found[cuts[i] : cuts[i + 1]].tolist()
        read.forget()


def test_columns_in_single_precision_keep_nearly_equal_cosines_apart():
    r = np.random.default_rng(5)
    base = r.random(40) + 0.1
    vectors = []
    for i in range(3000):  # all lists are columns; cosines of a query differ from one to the next by less than single precision tells
        w = base.copy()
        w[i % 40] += 1e-8 * r.random()
        vectors.append((np.arange(40), w / np.sqrt(w @ w)))
    index = tx.BlockMaxIndex(vectors, 40, 8)
    assert index.columns == 40 and index.cells.dtype == "f4"
    q = base[::-1] / np.sqrt(base @ base)
    scores = np.array([w for _, w in vectors]) @ q
    got = index.top(np.arange(40), q, 15)
    want = sorted(range(3000), key=lambda i: (-scores[i].round(12), i))[:15]
    assert len({scores[i].astype("f4") for i in want}) < 3
    assert np.allclose([s for s, _ in got], scores[want], rtol=0, atol=2e-12)
    assert {i for s, i in got if s > got[-1][0] + 2e-12} <= set(want)


def test_a_word_alone_is_its_own_number():
    read = tx.Reader({"^vile": 0, "^vileness": 1, "ab": 2, "vilenesses": 3, "x": 4})
    cuts, found, counts = read(["Ab, x x. nothing", "vilenesses x-ab"])
    assert cuts.tolist() == [0, 2, 7] and found.tolist() == [2, 4, 0, 1, 2, 3, 4] and counts.tolist() == [1, 2, 1, 1, 1, 1, 1]
    assert [read.known[p] for p in ("Ab,", "x", "nothing")] == [3, 5, 0] and len(read.flat) == 5

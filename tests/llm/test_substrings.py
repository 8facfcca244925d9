"""Content-defined chunks and suffix groups against sequential models."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import chunk_dedup as cd, repeats as rp
from flowsentry.llm.queries import QUERIES
from flowsentry.llm.suffix_groups import suffix_array
from tests.llm.cases import ODD, documents, rows_of, table


def plain_cuts(data, how):
    h, start, out = 0, 0, []
    for i, b in enumerate(data):
        h = (2 * h + int(cd.GEAR[b])) & 0xFFFF
        if i + 1 - start > how.most:
            out.append(start := start + how.most)
        if h >> (16 - how.bits) == 0 and i + 1 - start >= how.least:
            out.append(start := i + 1)
    if len(data) - start > how.most:
        out.append(start := start + how.most)
    return out + ([len(data)] if start < len(data) else [])


@pytest.mark.parametrize("seed", range(6))
def test_cuts_equal_a_rolling_hash(seed):
    r = random.Random(seed)
    how = cd.Chunking(r.choice([1, 4, 16]), r.choice([20, 60, 300]), r.choice([2, 4]))
    for n in (0, 1, 15, 16, 17, 400, 3000):
        data = bytes(r.choice(b"abcdef ") for _ in range(n)) + (b"a" * 200 if r.random() < 0.5 else b"")
        assert cd.cuts(data, how) == plain_cuts(data, how)


def test_insertion_moves_few_cuts():
    r = random.Random(1)
    data = bytes(r.randrange(97, 123) for _ in range(5000))
    how = cd.Chunking()
    chunks = lambda d: {d[a:b] for a, b in zip([0, *cd.cuts(d, how)], cd.cuts(d, how))}
    assert len(chunks(data) - chunks(data[:1000] + b"!!!" + data[1000:])) <= 4


def brute_chunks(rows, how):
    places = {}
    texts = [((2**63 - 1) if i is None else i, (t or "").encode()) for i, t in rows]
    pieces = []
    for k, (i, data) in enumerate(texts):
        ends = plain_cuts(data, how)
        pieces.append([(a, b, data[a:b]) for a, b in zip([0, *ends], ends)])
        for a, b, c in pieces[-1]:
            places.setdefault(c, []).append((i, k, a))
    out = []
    for k, (i, data) in enumerate(texts):
        common = []
        for a, b, c in pieces[k]:
            if len(places[c]) > 1:
                owner = min(p[0] for p in places[c])
                first = min(p[2] for p in places[c] if p[1] == k)
                common.append((a, b, i != owner or a != first))
        runs = [r for r in cd.runs_of(common) if r[-1][1] - r[0][0] >= how.least_span]
        removed = [p for r in runs for p in cd.runs_of([x for x in r if x[2]])]
        out.append((rows[k][0], len(data), [(r[0][0], r[-1][1]) for r in runs], [(p[0][0], p[-1][1]) for p in removed]))
    return sorted(out, key=repr)


def passages(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common = [text(r.randint(100, 700)) for _ in range(5)]
    return [(10 * k, "".join(text(r.randint(0, 300)) + r.choice(common) for _ in range(r.randint(1, 3)))) for k in range(40)]


def test_chunk_dedup(spark):
    rows = [r for r in ODD if r[0] != 4] + passages(3)
    got = cd.dedup_substrings(table(spark, rows))
    spans = lambda s: [tuple(x) for x in s]
    found = sorted(((r.doc_id, r.n_bytes, spans(r.repeats), spans(r.removed)) for r in got.collect()), key=repr)
    assert found == brute_chunks(rows, cd.Chunking())
    assert sum(bool(r[3]) for r in found) > 20
    assert cd.dedup_substrings(table(spark, rows).limit(0)).count() == 0


def test_chunk_query(spark, sf):
    want = [(i, n, sum(b - a for a, b in rep), sum(b - a for a, b in rem), len(rem)) for i, n, rep, rem in brute_chunks(documents(spark, sf), cd.Chunking())]
    got = QUERIES["op3_substring_dedup"](spark, sf)
    assert rows_of(got, "doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans") == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    r = random.Random(seed)
    for _ in range(300):
        s = [r.randint(1, r.choice([1, 2, 3, 50])) for _ in range(r.randint(0, 40))]
        s = (s[:5] * 8 if r.random() < 0.3 else s) + [0]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [rp.union([(i, i + length) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]) for t in texts]


def digests(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), t, spans in zip(rows, texts, brute_repeats(texts, length)):
        left = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)]))
        yield i, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("length", [16, 40, 400])
def test_repeats(spark, length):
    r = random.Random(length)
    rows = ODD + passages(4) + [(9000 + k, r.choice(["ab", "a", "abc"]) * r.randint(1, 700)) for k in range(6)]
    got = rp.remove_repeats(table(spark, rows), rp.Repeat(length)).selectExpr(
        "doc_id", "n_bytes", "n_bytes - octet_length(kept) removed", "size(spans) n", "sha2(kept, 256) kept"
    )
    assert rows_of(got, "doc_id", "n_bytes", "removed", "n", "kept") == sorted(digests(rows, length), key=repr)
    assert rp.remove_repeats(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowded_anchors_are_split(spark, monkeypatch, crowd):
    """Many different texts around the same passages; every level of longer anchors is used."""
    monkeypatch.setattr(rp, "CROWD", crowd)
    r = random.Random(crowd)
    base = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = passages(5)
    for k in range(40):
        i = r.randrange(300)
        rows.append((5000 + k, base[:i] + r.choice("XYZ") + base[i + 1 :]))
    got = rp.remove_repeats(table(spark, rows), rp.Repeat(60)).selectExpr(
        "doc_id", "n_bytes", "n_bytes - octet_length(kept) removed", "size(spans) n", "sha2(kept, 256) kept"
    )
    assert rows_of(got, "doc_id", "n_bytes", "removed", "n", "kept") == sorted(digests(rows, 60), key=repr)


def test_segments_of_a_long_text(monkeypatch):
    monkeypatch.setattr(rp, "SEGMENT", 100)
    r = random.Random(6)
    data = bytes(r.choice(b"abc") for _ in range(1000))
    blocks = list(rp.anchors(data, rp.Repeat(20), rp.Roll(rp.BASES[0])))
    assert [w for s, n, _ in blocks for w in range(s, s + n)] == list(range(981))


def test_repeats_query(spark, sf):
    got = QUERIES["op6_suffix_dedup"](spark, sf)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(digests(documents(spark, sf), 400), key=repr)


def test_suffix_dedup_hands_python_few_rows_at_once(spark, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    remove = rp.remove_repeats

    def counted(docs):
        def sizes(frames):
            for frame in frames:
                yield pa.RecordBatch.from_pydict({"n": [frame.num_rows]})

        most.append(docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0])
        return remove(docs)

    most = []
    monkeypatch.setattr(rp, "remove_repeats", counted)
    assert QUERIES["op6_suffix_dedup"](spark, str(tmp_path)).count() == 2500
    assert most == [1000] and spark.conf.get(name) == before

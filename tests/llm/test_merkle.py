import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flowsentry.llm.merkle import Parent, Shape, manifest
from flowsentry.llm.queries import QUERIES
from tests.llm.cases import ODD, rows_of, table


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, names):
    return sha("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in names)


def climb(digests, fan):
    """(root, siblings of each leaf on the way, as (left, right) lists)."""
    at, ways = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for k, w in enumerate(ways):
            run = digests[at[k] // fan * fan :][:fan]
            w.append((run[: at[k] % fan], run[at[k] % fan + 1 :]))
            at[k] //= fan
        digests = [sha(digests[i : i + fan]) for i in range(0, len(digests), fan)]
    return digests[0], ways


def brute(rows, names, changed, fan=2):
    """Rows as the operator gives them, from whole lists."""
    by = {}
    for r in rows:
        by.setdefault((r["lang"] is not None, (r["lang"] or "").encode()), []).append(r)
    parts = []
    for key in sorted(by):
        got = sorted(by[key], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, names)))
        parts.append((got, *climb([leaf(r, names) for r in got], fan)))
    root, over = climb([p[1] for p in parts], fan)
    out = []
    for (got, subroot, ways), up in zip(parts, over):
        for r, way in zip(got, ways):
            way, digest = way + up, leaf(changed(r), names)
            for left, right in way:
                digest = sha([*left, digest, *right])
            out.append((r["doc_id"], leaf(r, names), subroot, root, [s for a, b in way for s in a + b], digest, digest == root))
    return sorted(out, key=repr)


NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def given(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumn("leaf", F.lit("x")).withColumn("branch", F.lit("y")).withColumn("pos", F.lit("z")).repartition(3)


def some(seed, n):
    r = random.Random(seed)
    rows = [
        {"doc_id": r.choice([None, r.randrange(40), 1000 + k, 1000 + k]), "source": r.choice([None, "", "s"]), "lang": r.choice([None, "", "en", "en", "en", "é", "z"]),
         "n_chars": r.choice([None, 5, -1, 2**63 - 1]), "text": r.choice([None, "", "aé日" * k, "x" * 9])}
        for k in range(n)
    ]
    return rows + rows[: n // 5]


def add_one(row):
    hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None
    return row | {"n_chars": row["n_chars"] + 1} if hit else row


def found():
    n = F.col("n_chars").cast("decimal(38,0)")
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, n + 1).otherwise(n)}


@pytest.mark.parametrize("n,shape", [(1, Shape()), (2, Shape()), (90, Shape(2, 2)), (200, Shape(3, 1)), (150, Shape(4, 2)), (120, Shape())])
def test_equals_whole_lists(spark, n, shape):
    rows = some(n, n)
    got = manifest(given(spark, rows), found=found(), shape=shape)
    assert rows_of(got, "doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified") == brute(rows, NAMES, add_one, shape.fan)


def test_empty_table_and_odd_rows(spark):
    assert manifest(table(spark, ODD).limit(0)).collect() == []
    got = manifest(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.verified for r in got) and len({r.root for r in got}) == 1


def test_state_before_the_slot_is_resumed():
    children = [sha([str(k)]) for k in range(5)]
    parent = Parent(children)
    for k in range(5):
        assert parent.fold(k, children[k]) == parent.digest
        assert parent.fold(k, sha("x")) == sha(children[:k] + [sha("x")] + children[k + 1 :])


def test_query_equals_whole_lists(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").select(*NAMES).collect()]
    want = [(*r[:4], sha(r[4]), *r[5:]) for r in brute(rows, NAMES, add_one)]
    got = QUERIES["op13_merkle_manifest"](spark, sf)
    assert rows_of(got, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == sorted(want, key=repr)
    assert {r[-1] for r in want} == {True, False}

"""Each stage of the pipeline on its own input, against brute force."""

import pytest

import corpus_pipeline as cp
from flowsentry.llm import ngram_join as nj, secrets as se
from tests.llm.cases import ODD, rows_of, table
from tests.llm.test_ngram_join import brute as components_of
from tests.llm.test_quality import plain


@pytest.fixture(scope="module")
def stored(spark, sf):
    """What each stage returned, and what it read."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        after = nj.materialize(stage(spark, docs, sf))
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_stay(stored, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").dtypes
    for name, (_, after) in stored.items():
        if name != "packing":
            assert after.dtypes == columns


def test_quality(stored):
    before, after = stored["quality_rules"]
    texts = dict(rows_of(after, "doc_id", "text"))
    assert 0 < len(texts) < before.count()
    for i, t in rows_of(before, "doc_id", "text"):
        if i in texts:
            assert texts[i] == t and not plain(t)[-1]


def test_exact(stored):
    before, after = stored["exact_dedup"]
    best = {}
    for i, t in rows_of(before, "doc_id", "text"):
        key = "".join(t.split(" ")).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r")))
        best[key] = min(best.get(key, (0, 0)), (-len(t), i))
    assert rows_of(after, "doc_id") == sorted([(i,) for _, i in best.values()], key=repr)


def test_near(stored):
    before, after = stored["ngram_jaccard_join"]
    want = {(i,) for i, _, c in components_of(rows_of(before, "doc_id", "text"), nj.Similarity()) if i == c}
    assert set(rows_of(after, "doc_id")) == want


def test_secrets(stored):
    before, after = stored["secret_scan"]
    scan = se.Scanner()
    want = [(i, t2 := se.mask(t, scan(t), "[SECRET]"), len(t2)) for i, t in rows_of(before, "doc_id", "text")]
    assert rows_of(after, "doc_id", "text", "n_chars") == sorted(want, key=repr)


def test_packing(stored):
    before, after = stored["packing"]
    assert set(rows_of(after, "doc_id")) == set(rows_of(before, "doc_id"))
    full = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] == 4096 or r[1] & (r[1] - 1) == 0 for r in full)


def test_run_returns_the_last_stage(stored, spark, sf):
    last = stored["packing"][1]
    columns = ("doc_id", "doc_tokens")
    assert rows_of(cp.run(spark, sf).select(*columns).distinct(), *columns) == rows_of(last.select(*columns).distinct(), *columns)


def test_odd_rows_pass_every_stage(spark, sf):
    docs = table(spark, ODD + [(50, " ".join(f"w{k}" for k in range(80)))])
    for name, stage in cp.STAGES:
        after = stage(spark, docs, sf)
        if name != "quality_rules":
            assert after.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0

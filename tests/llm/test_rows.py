"""Keys of rows stay when Spark cuts the same files in another way between two jobs, as it does when executors come or go."""

import random

import pytest

import corpus_pipeline as cp
from flowsentry.llm import chunk_dedup as cd, exact_dedup as ed, ngram_join as nj, repeats as rp
from tests.llm.cases import rows_of, table
from tests.llm.test_ngram_join import brute as components_of

CUT, LEAST = "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"


@pytest.fixture
def cut(spark):
    """Sets how many files a task reads: all, or one each."""
    old = spark.conf.get(CUT)
    spark.conf.set(LEAST, 1)
    yield lambda whole: spark.conf.set(CUT, "1" if whole else "1g")
    spark.conf.set(CUT, old)
    spark.conf.unset(LEAST)


@pytest.fixture
def docs(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{r.randrange(10_000)}" for _ in range(40 + i)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-1], "other"])), (3 * i + 2, " ".join(words))]
    r.shuffle(rows)
    table(spark, rows).repartition(6).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def recut(monkeypatch, cut, module, name):
    """From the call of ``name`` on, files are cut in the other way."""
    plain = getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: (cut(False), plain(*a, **b))[1])
    cut(True)


@pytest.mark.parametrize("operator", [ed.dedup_exact, cd.dedup_substrings])
def test_key_is_stored(docs, cut, operator):
    found = operator(docs)
    cut(True)
    first = rows_of(found, "doc_id", "row")
    cut(False)
    assert rows_of(found, "doc_id", "row") == first


def test_links(docs, cut, monkeypatch):
    want = sorted(components_of(rows_of(docs, "doc_id", "text"), nj.Similarity()))
    recut(monkeypatch, cut, nj, "verified")
    assert rows_of(nj.link_documents(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_repeats(docs, cut, monkeypatch):
    how = rp.Repeat(60)
    want = rows_of(rp.remove_repeats(docs, how), "doc_id", "n_bytes", "spans", "kept")
    recut(monkeypatch, cut, rp, "sliced")
    assert rows_of(rp.remove_repeats(docs, how), "doc_id", "n_bytes", "spans", "kept") == want


@pytest.mark.parametrize("stage", [cp.exact_copies, cp.near_copies])
def test_stages_keep_one_of_each_group(spark, docs, cut, monkeypatch, stage):
    want = rows_of(stage(spark, docs, ""), "doc_id", "text")
    assert len(want) == (120 if stage is cp.exact_copies else 60)
    recut(monkeypatch, cut, cp, "keep_rows")
    assert rows_of(stage(spark, docs, ""), "doc_id", "text") == want


def test_other_inputs_are_stored_with_a_key(docs, cut):
    from flowsentry.llm.common import keyed
    from pyspark.sql import functions as F

    for frame in (docs, docs.filter("doc_id % 3 = 0"), docs.union(docs), docs.filter(F.rand(5) < 0.5), docs.limit(0)):
        found = keyed(frame.select("doc_id", "text"))
        cut(True)
        first = rows_of(found, "row", "doc_id", "text")
        cut(False)
        assert rows_of(found, "row", "doc_id", "text") == first
        assert len({r[0] for r in first}) == len(first)

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowsentry.llm import packing as pk
from flowsentry.llm.common import resolve
from flowsentry.llm.queries import QUERIES
from tests.llm.cases import ODD, documents, rows_of, table


def check(sequences, lengths, prompts, limits):
    placed = defaultdict(list)
    for sequence in sequences:
        total = sum(n for _, _, n in sequence)
        assert 0 < total <= limits.tokens and len(sequence) <= limits.segments
        assert total == limits.tokens or total & (total - 1) == 0
        loss = 0
        for e, start, n in sequence:
            placed[e.doc_id].append((start, n))
            loss += max(0, start + n - max(start, prompts[e.doc_id]))
        assert loss <= limits.loss
    for i, n in enumerate(lengths):
        at = 0
        for start, m in sorted(placed[i]):
            assert start == at and m > 0
            at += m
        assert at == n


@pytest.mark.parametrize("seed", range(12))
def test_limits_hold_and_every_id_is_placed_once(seed):
    r = random.Random(seed)
    limits = pk.Limits(64, r.choice([1, 3, 8, 64]), r.choice([5, 20, 64]), r.choice([1, 2, 16, 200]))
    lengths = [r.choice([0, 1, 2, 5, 30, 63, 64, 65, 200]) for _ in range(150)]
    prompts = [r.choice([0, 0, n // 2, n]) for n in lengths]
    examples = (pk.Example(i, np.arange(n, dtype="<u4"), p) for i, (n, p) in enumerate(zip(lengths, prompts)))
    check(list(pk.pack_examples(examples, limits)), lengths, prompts, limits)


def test_dot_product_mixes_demands():
    """With few segments a sequence, long examples go with short ones, so that neither limit is left over."""
    lengths = [60] * 20 + [4] * 20
    sequences = list(pk.pack_examples((pk.Example(i, np.zeros(n, "<u4"), 0) for i, n in enumerate(lengths)), pk.Limits(64, 2, 64)))
    assert len(sequences) == 20 and all(sum(n for *_, n in s) == 64 for s in sequences)


def test_query(spark, sf):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(resolve("word_bpe_49k.json")), {}
    for doc_id, text in documents(spark, sf):
        want[doc_id] = [*library.encode(text, add_special_tokens=False).ids, 2]
    rows = QUERIES["op10_packing"](spark, sf).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in rows:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.start, p.length))
    for parts, total in [(sorted(v), None) for v in sequences.values()] + [(sorted(v), len(want[k])) for k, v in docs.items()]:
        at = 0
        for start, n in parts:
            assert start == at
            at += n
        assert at == total if total else at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert set(docs) == set(want)


def test_odd_rows(spark):
    got = pk.pack_documents(table(spark, ODD), "word_bpe_49k.json")
    assert {r.doc_id for r in got.collect()} == {i for i, _ in ODD}
    assert sum(1 for r in got.collect() if r.doc_id == 4) == 2
    assert pk.pack_documents(table(spark, ODD).limit(0), "word_bpe_49k.json").count() == 0
    df = spark.createDataFrame([(1, None, None), (2, [], 3), (None, [5, 6], None), (3, [1, 2, 3], 2)], "doc_id long, ids array<int>, prompt int")
    assert rows_of(pk.pack_tokens(df).distinct(), "doc_id", "doc_tokens") in ([(3, 3), (None, 2)], [(3, 3), (3, 3), (None, 2)])
    assert {r.doc_id for r in pk.pack_tokens(df).collect()} == {3, None}
    assert pk.pack_tokens(df.limit(0)).count() == 0


def test_plain_words_go_to_the_model_alone():
    """Words of a to z have the library's ids without its normaliser and splitter; other vocabularies keep them."""
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(resolve("word_bpe_49k.json")), pk.WordEncoder(resolve("word_bpe_49k.json"))
    words = ["Hello", "hello,", "HELLO!!", "(zqxv)", "it's", "straße", "ÉTÉ,", "naïve", "İstanbul", "ΣΑΣ", "x1", "", "…", "a_b", "<|endoftext|>", "don't."]
    for text in [" ".join(words), " ".join(reversed(words)), "\n".join(w.lower() + ";" for w in words), "KK á ﬁ"]:
        assert encode(text, 2).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    encode.tokenizer = None  # not asked for any of these
    text = "Unheard wordlings, qwrtz Qwrtz, flommox HELLO"
    assert encode(text, 2).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    other = pk.WordEncoder(resolve("word_bpe_49k.json"))
    other.SPLIT = "another"
    assert not other.takes_words()

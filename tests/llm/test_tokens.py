"""The transducer, the counter and the encoder against the tokenizer libraries."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from flowsentry.llm import bpe, packing, unigram
from flowsentry.llm.common import resolve
from flowsentry.llm.queries import QUERIES
from tests.llm.cases import ODD, documents, rows_of, table

BYTES, WORDS, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(resolve(BYTES))


def odd_texts(seed, letters, n=200, most=80):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


TEXTS = [
    "", " ", "a", "'re's'll", "a  b   c \n\n d ", "<|endoftext|> x<|endoftext|>", "日本語😀é́", "a" * 40_000, " " * 9_000 + "x", "the" * 9_000,
    "".join(odd_texts(1, "etaoinshr", 300)), "".join(odd_texts(2, "abé ñ0\n\t'sr!? \x1c", 2_000)),
    *odd_texts(3, "ab é日😀 \n\t'sre!?1\x1c\x85"),
]


def test_ids_and_text_equal_the_library(library):
    coder = bpe.merges(resolve(BYTES))
    for text in TEXTS:
        ids = list(coder.encode(text))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(ids), "<u4").tolist() == want, text[:50]
        assert "".join(coder.decode(ids)) == library.decode(want, skip_special_tokens=False)


def test_decoder_on_cut_characters_and_bad_bytes(library):
    coder, r = bpe.merges(resolve(BYTES)), random.Random(5)
    for _ in range(200):
        ids = [r.randrange(256) for _ in range(r.randint(0, 12))]
        blocks = [np.array([i], "<u4").tobytes() for i in ids]
        assert "".join(coder.decode(blocks)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("step", [1, 7, 300])
def test_transducer_emits_only_final_tokens(step):
    coder = bpe.merges(resolve(BYTES))
    data = "".join(odd_texts(6, "etaoinshrdlu", 60)).encode()
    parts = list(coder.transduce(data[i : i + step] for i in range(0, len(data), step)))
    assert [t for p in parts for t in p] == coder.merge(data)
    assert len(parts) > 2  # it did not wait for the end


def test_lookahead_of_small_merge_lists():
    # a b ab: nothing chains; (a, bc) after (b, c): the c decides b, which decides a
    assert bpe.sufficient_lookahead([(0, 1, 2)], [1, 1, 2]) == 1 + 2
    assert bpe.sufficient_lookahead([(1, 2, 3), (0, 3, 4)], [1, 1, 1, 2, 3]) == 2 + 3
    assert bpe.sufficient_lookahead([(0, 1, 3), (1, 2, 4)], [1, 1, 1, 2, 2]) == 1 + 2


@pytest.mark.parametrize("seed", range(8))
def test_lookahead_suffices_on_random_merge_lists(seed):
    """Tokens that end the lookahead before a cut are the same with and without the rest."""
    r = random.Random(seed)
    coder = object.__new__(bpe.Merges)
    size, order, spelled = [1] * 3, [], {"a", "b", "c"}
    names = ["a", "b", "c"]
    while len(order) < 25:
        x, y = r.randrange(len(names)), r.randrange(len(names))
        if names[x] + names[y] not in spelled and len(names[x] + names[y]) < 9:
            spelled.add(names[x] + names[y])
            order.append((x, y, len(names)))
            names.append(names[x] + names[y])
            size.append(len(names[-1]))
    coder.order, coder.made = order, [c for _, _, c in order]
    coder.rank = {(a, b): k for k, (a, b, _) in enumerate(order)}
    coder.first = [0] * 97 + [0, 1, 2]
    coder.bytes_of = [n.encode() for n in names]
    look = bpe.sufficient_lookahead(order, size)
    for _ in range(60):
        text = "".join(r.choice("abc") for _ in range(150)).encode()
        whole = coder.merge(text)
        cut = r.randint(look, 140)
        end = 0
        for t, u in zip(coder.merge(text[:cut]), whole):
            end += size[t]
            if end > cut - look:
                break
            assert t == u


def test_bpe_query(spark, sf, library):
    want = []
    for doc_id, text in documents(spark, sf):
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = QUERIES["op9_bpe_transducer"](spark, sf)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_odd_rows(spark):
    df = table(spark, ODD)
    assert rows_of(bpe.bpe_encode_decode(df, BYTES), "doc_id", "decoded") == sorted([(i, t or "") for i, t in ODD], key=repr)
    assert bpe.bpe_encode_decode(df.limit(0), BYTES).count() == 0


def unigram_library(fallback):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=resolve(PIECES))
    vocab = [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library(spark, sf):
    library, count = unigram_library(True), unigram.counter(resolve(PIECES))
    for text in TEXTS[:-200] + odd_texts(7, "ab cdé 日😀▁e\n", 600):
        if len(text) < 30_000:
            assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:50]
    got = dict(rows_of(QUERIES["op4_token_counts"](spark, sf), "doc_id", "n_tokens"))
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in documents(spark, sf)}


def test_ties_and_unknown_runs():
    """Small vocabularies full of ties, and without byte fallback, against the library."""
    r = random.Random(8)
    for _ in range(60):
        pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))): -float(r.randint(1, 4)) for _ in range(12)}
        vocab = [("<unk>", min(pieces.values())), *pieces.items()]
        t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        count = unigram.CountingViterbi(list(pieces.items()), False)
        for text in odd_texts(r.random(), "abc dé", 20, 25):
            assert count(text) == len(t.encode(text, add_special_tokens=False).ids), (text, vocab)


def test_count_odd_rows(spark):
    df = table(spark, ODD)
    got = rows_of(unigram.count_tokens(df, PIECES), "doc_id", "n_tokens")
    assert len(got) == len(ODD) and (1, 0) in got and (2, 0) in got
    assert unigram.count_tokens(df.limit(0), PIECES).count() == 0


def test_word_encoder_equals_the_library():
    encode, library = packing.encoder(resolve(WORDS)), Tokenizer.from_file(resolve(WORDS))
    for text in TEXTS + ["ΣΑΣ ΣΑΣ́ ÅÅ", "<|startoftext|>x <|endoftext|>y", "́a ́"]:
        assert encode(text, 2).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text[:50]

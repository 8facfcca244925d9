"""Token counts of a unigram tokenizer, without its tokens: Aho-Corasick and a count-only Viterbi.

The automaton lists every vocabulary piece that ends at a character; for each end the dynamic programme keeps
the best score and the number of pieces on that path, nothing else. Ties follow the tokenizer: nodes are
filled from the left and only a strictly better score replaces one, so of equal paths the one whose last piece
starts first stays. A character without a piece of its own costs the lowest score less ten; runs of such
characters are one unknown piece, or, with byte fallback, one piece for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsentry.llm.common import Memo, resolve, texts, to_batch

#: The mark of a word's start, and the penalty of an unknown character.
SPACE, PENALTY = "▁", 10.0
#: Words up to this length are remembered.
WORD = 64


class CountingViterbi:
    """``pieces``: (piece, score) of the vocabulary without control and byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.bytes = byte_fallback
        self.words = Memo(self.count_word, 500_000)

    def count_word(self, word: str) -> int:
        """Pieces of the best path over ``word``.

        Matches come by end, longest first, that is by start: the order in which a forward pass fills a node. A node
        keeps (score, pieces, whether its last piece is unknown).
        """
        n = len(word)
        score, count, unknown = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        matches = self.machine.iter(word)
        end, found = next(matches, (n, None))
        for i in range(n):
            best, pieces, alone = None, 0, False
            while end == i:
                size, s = found
                s += score[i + 1 - size]
                if size == 1:
                    alone = True
                if best is None or s > best:
                    best, pieces = s, count[i + 1 - size] + 1
                end, found = next(matches, (n, None))
            if not alone:
                s = self.unknown + score[i]
                if best is None or s > best:
                    best, unknown[i + 1] = s, True
                    if self.bytes:
                        pieces = count[i] + len(word[i].encode())
                    else:
                        pieces = count[i] + (not unknown[i])
            score[i + 1], count[i + 1] = best, pieces
        return count[n]

    def __call__(self, text: str) -> int:
        """Words are cut before each space, which becomes the mark; the text starts with one."""
        if not text:
            return 0
        known = self.words.__getitem__
        words = text.replace(SPACE, " ").split(" ")
        if words[0] == "" and len(words) > 1:
            words = words[1:]
        total = sum([known(SPACE + w) if len(w) <= WORD else self.count_word(SPACE + w) for w in words])
        self.words.trim()
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> CountingViterbi:
    """The pieces and scores of a sentencepiece file, read as a unigram vocabulary."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return CountingViterbi([(p.id_to_piece(i), p.get_score(i)) for i in plain], any(p.is_byte(i) for i in range(p.get_piece_size())))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens (long) of every row under the unigram vocabulary in ``vocabulary``.

    A null or empty text has 0 tokens, a null id stays null, repeated rows stay, an empty table gives an empty
    result; other columns are not read; memory grows with the longest text, not with their number.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(resolve(vocabulary))
        for frame in frames:
            if frame.num_rows:
                counts = np.fromiter((count(t.as_py()) for t in frame.column(1)), "i8", frame.num_rows)
                yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(counts)], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")

"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

A merge list fixes how far the text behind a token can still change it. Cutting the text at n changes the
run of merges only from right to left: at merge (u, v) the place up to which both runs agree can move from
the start of v to the start of u, and a later, lower merge can move it on only if that u begins its right
side. The longest such chain, measured in bytes, is the *sufficient lookahead*: tokens that end that many
bytes before n are final, whatever follows. The transducer reads blocks, emits final tokens and keeps the
rest, so its memory depends on the merge list and not on the text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsentry.llm.common import Memo, batches, resolve, texts

#: Fixed value: the splitting pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are split at once; words up to this length are remembered.
SLICE, WORD = 1 << 16, 48


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by the rule it was made with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A byte-level merge list: ``rank[(left id, right id)]``, and ``made[rank]``, the id that it makes."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.order = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.order)))}
        self.made = [c for _, _, c in self.order]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.first = [self.vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.split = regex.compile(SPLIT)
        self.safe = regex.compile(r"(?<=\S) (?=\S)")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.lookahead = sufficient_lookahead(self.order, [len(b) for b in self.bytes_of])
        #: Ids of " " + x for an x without blanks around it: a word always ends before a lone space.
        self.chunks = Memo(lambda x: self.pieces(" " + x), 400_000)
        self.uneven = re.compile(r"\s |^ | \s| $")
        self.words = Memo(lambda w: np.array(self.merge(w.encode()), "<u4").tobytes())

    def merge(self, data: bytes | list[int]) -> list[int]:
        """Token ids of a whole run of bytes: the best-ranked leftmost pair merges first."""
        ids = [self.first[b] for b in data]
        rank = self.rank
        if len(ids) < 256:
            none, merged = len(self.made), self.made
            ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                ids[i] = t = merged[best]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank.get((ids[i - 1], t), none)
                if i < len(ranks):
                    ranks[i] = rank.get((t, ids[i + 1]), none)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            t = ids[i] = self.made[best]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank.get((t, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, t, ids[k]))
            if (k := before[i]) >= 0 and (x := rank.get((ids[k], t))) is not None:
                heapq.heappush(heap, (x, k, ids[k], t))
        return [t for t in ids if t >= 0]

    def transduce(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one run of bytes that arrives in blocks; holds one block and the lookahead."""
        held = b""
        for block in blocks:
            held += block
            if len(held) <= 2 * self.lookahead:
                continue
            final, end, limit = [], 0, len(held) - self.lookahead
            for t in self.merge(held):
                if end + len(self.bytes_of[t]) > limit:
                    break
                end += len(self.bytes_of[t])
                final.append(t)
            held = held[end:]
            yield final
        if held:
            yield self.merge(held)

    def word(self, word: str) -> bytes:
        if len(word) <= WORD:
            return self.words[word]
        data = word.encode()
        step = max(4096, 4 * self.lookahead)
        return b"".join(np.array(ids, "<u4").tobytes() for ids in self.transduce(data[i : i + step] for i in range(0, len(data), step)))

    def slices(self, text: str) -> Iterator[str]:
        """Pieces that end where the pattern always ends a word: before a lone space between two other characters."""
        start = 0
        while len(text) - start > SLICE:
            found = self.safe.search(text, start + SLICE)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece."""
        start = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self.plain(text[start : found.start()])
            yield np.array([self.added[found.group()]], "<u4").tobytes()
            start = found.end()
        yield from self.plain(text[start:] if start else text)

    def plain(self, text: str) -> Iterator[bytes]:
        after, words = self.chunks.__getitem__, self.pieces
        for part in self.slices(text):
            if not part or self.uneven.search(part):
                yield words(part)
            else:
                head, *rest = part.split(" ")
                yield words(head) + b"".join(map(after, rest))
            self.chunks.trim()
            self.words.trim()

    def pieces(self, part: str) -> bytes:
        return b"".join([self.word(w) for w in self.split.findall(part)])

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of ids that arrive in blocks; a character may lie across tokens and blocks, bad bytes become U+FFFD."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for block in blocks:
            yield machine.decode(b"".join([table[i] for i in np.frombuffer(block, "<u4").tolist()]))
        yield machine.decode(b"", True)


def sufficient_lookahead(order: list[tuple[int, int, int]], size: list[int]) -> int:
    """Bytes behind a token that decide it, as told at the top; one pass over the merges in order.

    ``best[t]``: the longest chain so far whose last merge has t as its left side. ``spine[t]``: the longest
    chain that ended, before t was extended, at a proper left part of t.
    """
    best, spine, longest = [0] * len(size), [0] * len(size), 0
    for u, v, made in order:
        chain = size[u] + max(best[v], spine[v])
        best[u] = max(best[u], chain)
        spine[made] = max(spine[made], spine[u], best[u])
        longest = max(longest, chain)
    return longest + max(size)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def bpe_encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes it again.

    Returns doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded (string), one row per
    input row. A null text counts as empty and gives no ids; a null id stays null; repeated rows stay; an empty
    table gives an empty result; other columns are not read. Special strings of the vocabulary that stand in
    a text become their ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges(resolve(vocabulary))

        def rows():
            for frame in frames:
                for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                    ids = list(coder.encode(text.as_py()))
                    yield doc_id, b"".join(ids), "".join(coder.decode(ids))

        yield from batches(rows(), schema, lambda r: len(r[1]) + len(r[2]))

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")

"""Packing of token sequences under several limits at once: tokens, segments and loss-bearing tokens.

Each task packs its own examples. An open sequence takes, from a pool of examples, the one whose demand has the
largest dot product with what is left of the limits, both measured in parts of the limits; a long tail of
capacity in one dimension thereby draws examples that use it. Examples may be cut: what no whole example fits
is filled with the head of one, and the rest returns to the pool. A sequence that cannot be filled (segments or loss
are used up, or the task has no more) is cut back to a power of two tokens, so it needs no padding either.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowsentry.llm.common import Memo, batches, resolve, texts


@dataclass(frozen=True)
class Limits:
    """Of one sequence; ``pool``: examples a task holds to choose from."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    pool: int = 1024


@dataclass
class Example:
    """``ids`` from ``start`` on are still to be placed; the first ``prompt`` ids of the example bear no loss."""

    doc_id: int | None
    ids: np.ndarray
    prompt: int
    start: int = 0

    def loss(self, n: int) -> int:
        """Loss-bearing ones of the next ``n`` ids."""
        return max(0, self.start + n - max(self.start, self.prompt))


def pack_examples(examples: Iterator[Example], limits: Limits) -> Iterator[list[tuple[Example, int, int]]]:
    """Sequences as lists of (example, start, length)."""
    pool: list[Example] = []
    need = np.zeros((0, 3))
    scale = np.array([limits.tokens, limits.segments, limits.loss], float)
    demand = lambda e: (n := len(e.ids) - e.start, 1, e.loss(n))
    more = True

    def fill() -> None:
        nonlocal more, need
        new = []
        while more and len(pool) + len(new) < limits.pool:
            e = next(examples, None)
            if e is None:
                more = False
            elif len(e.ids):
                new.append(e)
        if new:
            pool.extend(new)
            need = np.concatenate([need, np.array([demand(e) for e in new], float)])

    def take(i: int) -> Example:
        """The last of the pool fills the hole."""
        nonlocal need
        e, last = pool[i], pool.pop()
        if i < len(pool):
            pool[i] = last
            need[i] = need[-1]
        need = need[:-1]
        return e

    def give(e: Example) -> None:
        nonlocal need
        pool.append(e)
        need = np.concatenate([need, np.array([demand(e)], float)])

    fill()
    while pool:
        left, out = scale.copy(), []
        while pool and left[0] >= 1 and left[1] >= 1:
            fits = (need[:, 0] <= left[0]) & (need[:, 1] <= left[1]) & (need[:, 2] <= left[2])
            if fits.any():
                i = int(np.where(fits, need @ (left / scale**2), -1.0).argmax())
                n = int(need[i, 0])
            else:  # the head of the one that fills most
                room = np.minimum(np.minimum(need[:, 0], left[0]), need[:, 0] - need[:, 2] + left[2])
                i = int(room.argmax())
                n = int(room[i])
                if not n:
                    break
            e = take(i)
            out.append((e, e.start, n))
            left -= (n, 1, e.loss(n))
            e.start += n
            if e.start < len(e.ids):
                give(e)
            if len(pool) <= limits.pool // 2:
                fill()
        used = limits.tokens - int(left[0])
        if used < limits.tokens:
            back = used - (1 << (used.bit_length() - 1))
            while back:
                e, start, n = out.pop()
                cut = min(n, back)
                back -= cut
                if e.start == len(e.ids):
                    e.start -= cut
                    give(e)
                else:  # its tail lies in the pool already
                    i = next(i for i, x in enumerate(pool) if x is e)
                    e.start -= cut
                    need[i] = demand(e)
                if n > cut:
                    out.append((e, start, n - cut))
        yield out
        fill()


def pack_stream(rows: Iterator[tuple], limits: Limits, first: int) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset) of (doc_id, ids, prompt); sequences count up from ``first``."""
    for number, sequence in enumerate(pack_examples((Example(d, ids, p) for d, ids, p in rows), limits)):
        offset = 0
        for e, start, n in sequence:
            yield e.doc_id, start, e.ids[start : start + n].tobytes(), len(e.ids), first + number, offset
            offset += n


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECES_SQL = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def first_sequence() -> int:
    """Sequences of a task are numbered in a range of its own."""
    return TaskContext.get().partitionId() << 33


def pack_tokens(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Packs tokenised examples: doc_id long, ids array<int>, prompt int (ids at the start that bear no loss).

    Returns one row per piece: doc_id, start, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. Each id lies in exactly one piece. Null or empty ids give no piece, a null prompt is 0, a null doc_id
    stays null, repeated rows are packed each; an empty table gives an empty result; other columns are not read.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for frame in frames:
                for d, ids, p in zip(*(frame.column(i).to_pylist() for i in range(3))):
                    yield d, np.array(ids or [], "<u4"), p or 0

        yield from batches(pack_stream(rows(), limits, first_sequence()), PIECES, lambda r: len(r[2]))

    return examples.select(F.col("doc_id").cast("long"), "ids", F.col("prompt").cast("int")).mapInArrow(run, PIECES_SQL)


#: A part of a text that is one word, perhaps with signs behind it; "'" and "<" may belong to longer units.
PLAIN = re.compile(r"([^\W\d_]+)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")
SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of texts by a tokenizer whose words never cross a space or line feed.

    Its normaliser works on characters between blanks and its splitter ends words at them, so a text's ids are
    those of its parts; a part is encoded once, by the tokenizer itself, while it is remembered. Parts that are a
    word and signs are made of the ids of both, in lower case as the normaliser makes it; new words go through the tokenizer
    as one text, of which each word's last token is marked, or, where nothing comes before its model but what leaves a word
    of small letters from a to z as it is, to the model.
    """

    #: Fixed value: the mark of a word's last token.
    END = "</w>"
    #: Fixed value: a splitter that leaves words of letters whole.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.model = self.tokenizer.model if self.takes_words() else None
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.END)]] = True
        self.parts = Memo(None, 500_000)
        self.signs = Memo(self.whole, 10_000)

    def whole(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes() if part else b""

    def takes_words(self) -> bool:
        """Whether a word of the letters a to z reaches the model as it is."""
        parts = json.loads(self.tokenizer.to_str())
        first = parts["normalizer"]
        before = first.get("normalizers", [first]) if first else []
        split, coded = [*(parts["pre_tokenizer"] or {}).get("pretokenizers", []), None, None][:2]
        return bool(
            split and coded and len(parts["pre_tokenizer"]["pretokenizers"]) == 2 and not any(t["content"].isalpha() for t in parts["added_tokens"])
            and all(x["type"] in ("NFC", "Lowercase") or (x["type"], x.get("pattern")) == ("Replace", {"Regex": r"\s+"}) for x in before)
            and split["type"] == "Split" and split["pattern"].get("Regex") == self.SPLIT and split["invert"]
            and coded["type"] == "ByteLevel" and not coded["add_prefix_space"] and not coded["use_regex"]
        )

    def learn(self, lacking: set[str]) -> None:
        """Remembers parts."""
        plain, new, known, old, model = [], {}, self.parts, self.parts.old, self.model
        for p in lacking:
            if (ids := old.get(p)) is not None:
                known[p] = ids
                continue
            if p.isascii():
                w = p.rstrip(SIGNS)
                signs, word = p[len(w) :], w.isalpha()
                w = w.lower()
            elif word := bool((m := PLAIN.fullmatch(p)) and "Σ" not in p and (w := m[1].lower()).isalpha() and is_normalized("NFC", m[1]) and is_normalized("NFC", w)):
                signs = m[2]
            if not word:
                known[p] = self.whole(p)
                continue
            ids = None if w == p else known.get(w) or old.get(w)
            if ids is None and model and w.isascii():
                ids = known[w] = array("I", [t.id for t in model.tokenize(w)]).tobytes()
            if ids is None:
                new[w] = None
                plain.append((p, w, signs))
            else:
                known[p] = ids + self.signs[signs] if signs else ids
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(new):
                raise ValueError("a word has not one last token")
            data, start = ids.tobytes(), 0
            for w, end in zip(new, ends):
                known[w] = data[4 * start : 4 * end]
                start = end
        for p, w, signs in plain:
            known[p] = known[w] + self.signs[signs]

    def __call__(self, text: str, end: int) -> np.ndarray:
        """Ids with ``end`` after the last."""
        parts, known = text.replace("\n", " ").split(" "), self.parts
        ids = list(map(known.get, parts))
        if lacking := [i for i, x in enumerate(ids) if x is None]:
            self.learn({parts[i] for i in lacking})
            for i in lacking:
                ids[i] = known[parts[i]]
        ids.append(end.to_bytes(4, "little"))
        out = np.frombuffer(b"".join(ids), "<u4")
        known.trim()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 2, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises every text, puts ``end`` after it and packs the ids; all of them bear loss. Rows as of ``pack_tokens``.

    A null text is an empty one, of which the end alone is packed; very long texts are cut into sequences as they come.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(resolve(vocabulary))

        def rows():
            for frame in frames:
                for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                    yield doc_id, encode(text.as_py(), end), 0

        yield from batches(pack_stream(rows(), limits, first_sequence()), PIECES, lambda r: len(r[2]))

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES_SQL)

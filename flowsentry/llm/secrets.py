"""Secret scans: shaped secrets by pattern, unshaped ones by the entropy of sliding windows.

A candidate is a run of letters a secret can be written in. For each character class of the rules, a window slides over the
class's runs; entering and leaving letters change integer letter counts and a running sum of c * log2(c), so a
step costs the same whatever the window. Windows of high entropy are merged into spans. Strings of the allow
list (identifiers by design, alphabets, placeholders) raise no entropy span.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsentry.llm.common import batches, texts

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: Runs in which keys of every other kind lie; the shapes below are only looked for inside them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyRule:
    """Windows of ``width`` letters of class ``letters`` with at least ``bits`` bits a letter and all of ``needs``."""

    kind: str
    letters: str
    width: int
    bits: float
    needs: tuple[str, ...]


RULES = (
    EntropyRule("entropy_hex", "0-9A-Fa-f", 20, 3.0, ("[0-9]", "[A-Fa-f]")),
    EntropyRule("entropy_alnum", "A-Za-z0-9", 20, 3.6, ("[0-9]", "[A-Z]", "[a-z]")),
    EntropyRule("entropy_base64", "A-Za-z0-9+/_-", 24, 4.0, ("[0-9]", "[A-Z]", "[a-z]")),
    # one case: digits must stand among the letters, or numbered words and names would do
    EntropyRule("entropy_lower", "a-z0-9", 24, 3.5, ("(?:[0-9]+[a-z]+){3}",)),
    EntropyRule("entropy_upper", "A-Z0-9", 24, 3.5, ("(?:[0-9]+[A-Z]+){2}",)),
)
#: What spares a candidate that it touches; words of a placeholder hold for their own token, not beyond ``=`` or ``/``.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:[a-z0-9+]*(?:abcdefghij|0123456789)[a-z0-9+]*)",
    r"(?i:[a-z0-9_+-]*(?:example|placeholder|changeme|xxxxxx|your[_-])[a-z0-9_+-]*)",
)

#: c * log2(c) in units of 2^-30, as integers: running sums stay exact.
UNIT = 1 << 30


def weight(c: int) -> int:
    return round(c * math.log2(c) * UNIT) if c else 0


def hot_windows(run: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``width`` letters with at least ``bits`` bits a letter."""
    if len(run) < width:
        return []
    steps = [weight(c) for c in range(width + 2)]
    most = int((math.log2(width) - bits) * width * UNIT)  # entropy = log2(width) - sum / width
    count: dict[str, int] = {}
    total, out = 0, []
    for i, c in enumerate(run):
        k = count.get(c, 0)
        total += steps[k + 1] - steps[k]
        count[c] = k + 1
        if i >= width:
            gone = run[i - width]
            k = count[gone]
            total += steps[k - 1] - steps[k]
            count[gone] = k - 1
        if i >= width - 1 and total <= most:
            start, end = i - width + 1, i + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


class Scanner:
    def __init__(self, rules: tuple[EntropyRule, ...] = RULES, allowed: tuple[str, ...] = ALLOWED):
        self.rules = [(r, re.compile(f"[{r.letters}]{{{r.width},}}"), [re.compile(x) for x in r.needs]) for r in rules]
        self.allowed = re.compile("|".join(allowed)) if allowed else None
        self.order = {k: i for i, k in enumerate((*BASE, *(r.kind for r in rules)))}

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind, then end; code points, end exclusive."""
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
        runs = [m.span() for m in CANDIDATE.finditer(text)]
        for start, end in runs:
            out += [("access", *m.span()) for m in ACCESS.finditer(text, start, end)]
            out += [("hex", *m.span()) for m in HEX.finditer(text, start, end)]
        base = [(a, b) for _, a, b in out]
        for start, end in runs:
            spared = None
            for rule, runs_of, needs in self.rules:
                for run in runs_of.finditer(text, start, end):
                    for a, b in hot_windows(run.group(), rule.width, rule.bits):
                        a, b = a + run.start(), b + run.start()
                        if not all(n.search(text, a, b) for n in needs) or any(x <= a and b <= y for x, y in base):
                            continue
                        if spared is None:
                            spared = [m.span() for m in self.allowed.finditer(text, start, end)] if self.allowed else []
                        if not any(x < b and a < y for x, y in spared):
                            out.append((rule.kind, a, b))
        return sorted(out, key=lambda s: (s[1], self.order[s[0]], s[2]))


def mask(text: str, spans: list[tuple[str, int, int]], cover: str) -> str:
    """``text`` with every maximal run of overlapping spans replaced by ``cover``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], cover]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[EntropyRule, ...] = RULES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end>> in order of start, kind and end; one row per input row.

    A null text has no spans, a null id stays null, repeated rows stay, an empty table gives an empty result; texts of
    any length are read whole; other columns are not read. A span of entropy that lies inside a shaped one is
    not told twice.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
    ])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(rules, allowed)

        def rows():
            for frame in frames:
                for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                    yield doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in scan(text.as_py())]

        yield from batches(rows(), schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact_secrets(
    docs: DataFrame, text_col: str = "text", cover: str = "[SECRET]", rules: tuple[EntropyRule, ...] = RULES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """The rows of ``docs`` with secrets covered; all rows and columns stay, a null text stays null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def covered(column):
        scan = Scanner(rules, allowed)
        return column.map(lambda t: t if t is None else mask(t, scan(t), cover))

    return docs.withColumn(text_col, covered(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

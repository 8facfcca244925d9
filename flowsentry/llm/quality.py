"""Quality rules: text measures and a learned, ordered list of threshold conditions, all as column expressions.

Learning is sequential covering. A rule grows condition by condition, each the threshold with most information gain among
the labelled rows that the rule still covers and no earlier rule has; then its last conditions are pruned away as
long as that serves the rows kept aside. It enters the list if it is pure enough there, its rows leave, and the next one
grows. Every step is one Spark aggregate over the labelled measures: counts by feature, quantile bin and label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowsentry.functions.net import once
from flowsentry.plans.storage import materialize

#: What separates words, and what counts as a symbol.
BLANKS, BLANK_CLASS, SYMBOLS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]", "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_measures(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name`` of measures of its texts (null counts as empty).

    Repeated 3-word windows are found inside the row: each window's hash, with its place in the low bits, goes
    into one sorted array of longs, where equal windows are neighbours; their words are then compared.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns]
    text, words, lines, marks, bits, at = (F.col(f"`{name}`.{x}") for x in ("text", "words", "lines", "marks", "bits", "at"))

    def layer(df: DataFrame, **fields: Column) -> DataFrame:
        return df.select(*rest, once(F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias(name))))

    shift = lambda way, x: F.call_function(way, x, bits)
    place = lambda x: x.bitwiseAND(shift("shiftleft", F.lit(1).cast("long")) - 1).cast("int")
    window = lambda i: F.struct(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    same = lambda x, y: F.coalesce(
        F.when(shift("shiftright", x) == shift("shiftright", y), window(place(x)) == window(place(y))), F.lit(False)
    )
    without = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))

    out = layer(docs, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    out = layer(
        out, text=text, words=F.filter(F.split(text, BLANK_CLASS + "+"), lambda w: w != ""),
        lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    out = layer(out, text=text, words=words, lines=lines, bits=F.ceil(F.log2(F.size(words) + 2)).cast("int"))
    hashed = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: shift("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).bitwiseOR(i.cast("long")),
    )
    out = layer(out, text=text, words=words, lines=lines, bits=bits, marks=F.sort_array(hashed))
    equal = F.filter(marks, lambda x, k: same(F.get(marks, k - 1), x) | same(F.get(marks, k + 1), x))
    out = layer(out, text=text, words=words, lines=lines, at=F.sort_array(F.transform(equal, place)))
    out = layer(
        out, text=text, n_words=F.size(words).cast("long"), n_lines=F.size(lines).cast("long"),
        word_chars=(F.length(text) - without(BLANKS)).cast("long"), n_symbols=without(SYMBOLS).cast("long"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        n_repeat_words=F.aggregate(
            F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - p), F.lit(3)).cast("long")),
            F.lit(0).cast("long"), lambda a, x: a + x,
        ),
        n_upper=F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"), n_marks=without("!?").cast("long"),
    )
    m = {x: F.col(f"`{name}`.{x}") for x in ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")}
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    shares = {
        "mean_word": share(m["word_chars"], m["n_words"]), "symbol_share": share(m["n_symbols"], m["n_words"]),
        "dup_line_share": share(m["n_dup_lines"], m["n_lines"]), "repeat_share": share(m["n_repeat_words"], m["n_words"]),
        "upper_share": share(m["n_upper"], m["word_chars"]), "mark_share": share(m["n_marks"], m["n_words"]),
    }
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return layer(out, **{k: v for k, v in m.items()}, **shares, base_failed=failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: str) -> Column:
        value = F.col(f"`{of}`.{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects. ``rules``: tuples of conditions."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self, of: str) -> Column:
        """One conditional expression over the measures in struct column ``of``: the number of the rule that rejects, else 0."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column(of)
            out = F.when(holds, i) if out is None else out.when(holds, i)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"{i}: reject if " + " and ".join(map(str, r)) for i, r in enumerate(self.rules, 1))


@dataclass(frozen=True)
class Learning:
    """``fit_rows``: the documented bound of labelled rows that are used, the first by a hash of their id.

    ``purity``: the least share of bad rows among those a rule covers, on the rows kept aside for pruning.
    """

    fit_rows: int = 20_000
    max_rules: int = 8
    max_conditions: int = 4
    least: int = 5
    purity: float = 0.95


#: Shares of the rows below the thresholds that may be chosen; both ends are finer.
QUANTILES = [0.001, 0.002, 0.005, 0.01, 0.015, *(i / 50 for i in range(1, 50)), 0.985, 0.99, 0.995, 0.998, 0.999]


def learn_rules(docs: DataFrame, labels: DataFrame, how: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DecisionList:
    """A decision list that rejects what ``labels`` marks 0; without usable labels it is empty and rejects nothing."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good"))
        .filter("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("id"), "id").limit(how.fit_rows)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = with_measures(rows, "m").select("good", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).alias("aside"), "m")
    rows = materialize(rows)
    cuts = rows.select([F.percentile_approx(f"m.{f}", QUANTILES, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: middles(sorted({float(x) for x in cuts[f] or ()})) for f in FEATURES}
    bins = F.array(*[bin_of(F.col(f"m.{f}"), cuts[f]) for f in FEATURES])
    rows = materialize(rows.select("good", "aside", "m", bins.alias("bins")))

    def holds(rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & c.column("m")
        return out

    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(rules) < how.max_rules:
        rule: list[Condition] = []
        while len(rule) < how.max_conditions:
            c = best_condition(rows.filter(left & holds(rule) & ~F.col("aside")), cuts, how)
            if c is None:
                break
            rule.append(c)
        tried = [tuple(rule[:n]) for n in range(1, len(rule) + 1)]
        if not tried:
            break
        counts = rows.filter(left & F.col("aside")).agg(*[
            F.count_if(holds(r) & (F.col("good") == g)).alias(f"{g}_{i}") for i, r in enumerate(tried) for g in (0, 1)
        ]).first()
        worth = [((counts[f"0_{i}"] - counts[f"1_{i}"]) / max(1, counts[f"0_{i}"] + counts[f"1_{i}"]), -i) for i in range(len(tried))]
        i = -max(worth)[1]
        bad, good = counts[f"0_{i}"], counts[f"1_{i}"]
        if bad < how.purity * (bad + good) or not bad:
            break
        rules.append(tightest(tried[i]))
        left = left & ~holds(tried[i])
    return DecisionList(tuple(rules))


def middles(values: list[float]) -> list[float]:
    """Thresholds half way between neighbours, so that none sits on a value that rows have."""
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def tightest(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """Without conditions that a later one on the same feature implies."""
    return tuple({(c.feature, c.above): c for c in rule}.values())


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def best_condition(rows: DataFrame, cuts: dict[str, list[float]], how: Learning) -> Condition | None:
    """The threshold with most information gain on ``rows``; None if nothing gains or no good row is left."""
    counts = rows.select("good", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin", "good").count().collect()
    table: dict[int, dict[int, list[int]]] = {}
    for r in counts:
        table.setdefault(r["f"], {}).setdefault(r["bin"], [0, 0])[r["good"] != 0] += r["count"]
    best, found = 0.0, None
    for f, by_bin in sorted(table.items()):
        bad, good = (sum(x[k] for x in by_bin.values()) for k in (0, 1))
        if not bad or not good:
            return None
        before = math.log2(bad / (bad + good))
        below = [0, 0]
        for j, cut in enumerate(cuts[FEATURES[f]]):  # above the cut: bins over j
            for k in (0, 1):
                below[k] += by_bin.get(j, (0, 0))[k]
            for above, (p, n) in ((True, (bad - below[0], good - below[1])), (False, tuple(below))):
                if p >= how.least and n < good and (gain := p * (math.log2(p / (p + n)) - before)) > best + 1e-9:
                    best, found = gain, Condition(FEATURES[f], above, cut)
    return found


def judge(docs: DataFrame, rules: DecisionList, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``name``: the measures, base_failed, rule (0: none rejects) and kept.

    One row per input row; null and empty texts have no words and so fail the base rules; repeated rows and all other
    columns stay; an empty table stays empty.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = with_measures(docs, name, text_col)
    m = F.col(f"`{name}`")
    out = out.select(*columns, once(F.struct(F.struct(m.alias("m"), rules.verdict(name).alias("rule")).alias(name))))
    both = F.col(f"`{name}`")
    return out.select(*columns, both["m"].withField("rule", both["rule"]).withField("kept", ~both["m"]["base_failed"] & (both["rule"] == 0)).alias(name))

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowsentry.llm import quality as ql
from flowsentry.llm.queries import QUERIES
from tests.llm.cases import ODD, documents, rows_of, table


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if often[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_measures(spark, sf):
    got = QUERIES["op8_quality_rules"](spark, sf)
    assert rows_of(got, "doc_id", *BASE) == sorted(((i, *plain(t)) for i, t in documents(spark, sf)), key=repr)
    assert got.filter("base_failed and kept").count() == 0


def test_odd_texts(spark):
    rows = ODD + [(20, "a b c a b c a b"), (21, "x\nx\n x\n\n\t\ny\ny"), (22, "\x1c \x85#$ %😀<>"), (23, "w " * 4000), (24, "a b a b a")]
    df = table(spark, rows).withColumn("q", F.lit(1)).withColumn("m", F.lit(2))
    got = ql.judge(df, ql.DecisionList(()), "judged")
    assert got.columns == [*df.columns, "judged"]
    assert rows_of(got.select("doc_id", "judged.*"), "doc_id", *BASE) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert ql.judge(df.limit(0), ql.DecisionList(()), "judged").count() == 0


def test_main_path_is_native(spark, sf):
    plan = QUERIES["op8_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def planted(spark, n=1500):
    """Good texts, and two kinds of bad ones: many marks, or upper case."""
    rows, labels = [], []
    for i in range(n):
        words = [f"word{(i * 7 + k * k) % 977}" for k in range(60 + i % 40)]
        kind = i % 10
        if kind == 0:
            words = [w + "!!" for w in words]
        elif kind == 1:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 13 == 0 else int(kind > 1)))
    return table(spark, rows), spark.createDataFrame([*labels, (None, 0), (n + 5, 0)], "doc_id long, quality int")


def test_learned_rules(spark):
    docs, labels = planted(spark)
    rules = ql.learn_rules(docs, labels)
    assert 2 <= len(rules.rules) <= 4, str(rules)
    got = ql.judge(docs, rules, "q").select("doc_id", "q.kept").collect()
    wrong = [r.doc_id for r in got if r.kept != (r.doc_id % 10 > 1)]
    assert not wrong, (str(rules), wrong[:5])


def test_order_of_rules(spark):
    rules = ql.DecisionList(((ql.Condition("n_words", False, 2.0),), (ql.Condition("n_words", False, 5.0), ql.Condition("n_symbols", True, 0.0))))
    df = table(spark, [(1, "a"), (2, "a b c #"), (3, "a b c d"), (4, "a b c d e f #")])
    assert rows_of(ql.judge(df, rules, "q").select("doc_id", "q.rule"), "doc_id", "rule") == [(1, 1), (2, 2), (3, 0), (4, 0)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 1), (2, 1)], [(1, 0), (2, 0)]])
def test_without_useful_labels(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    assert ql.learn_rules(table(spark, ODD), labels).rules == ()

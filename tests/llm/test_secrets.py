import math
import random
import re
from collections import Counter

import pytest

from flowsentry.llm import secrets as se
from flowsentry.llm.queries import QUERIES
from tests.llm.cases import ODD, documents, rows_of, table


def plain_base(text):
    """The three patterns as they are stated, failing matches dropped."""
    assign = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
    out = [("assign", *m.span()) for m in assign if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], se.BASE.index(s[0])))


def plain_windows(run, width, bits):
    """Every window's entropy anew."""
    hot = set()
    for i in range(len(run) - width + 1):
        c = Counter(run[i : i + width]).values()
        if math.log2(width) - sum(x * math.log2(x) for x in c) / width >= bits - 1e-12:
            hot.update(range(i, i + width))
    return hot


@pytest.mark.parametrize("seed", range(5))
def test_running_entropy(seed):
    r = random.Random(seed)
    for bits in (3.01, 3.3, 3.61):
        run = "".join(r.choice("abcdefghijABCDEF0123456789"[: r.randint(4, 26)]) for _ in range(r.randint(0, 150)))
        spans = se.hot_windows(run, 20, bits)
        assert {i for a, b in spans for i in range(a, b)} == plain_windows(run, 20, bits)
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("text", [
    'token="abcdef"', "token=abcde", "TOKEN : 'aB/+=._-x'", "api_key=apikey=secret", "password=token:abcdefgh", "ſecret=abcdefgh",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B9" * 12, "f" * 23, "f" * 24, "Aabc" + "0f" * 14 + "G", "secret  =  \"x\"",
    "toKen=" + "ab12" * 9 + " password: " + "0123456789abcdef" * 2,
])
def test_base_spans(text):
    assert [s for s in se.Scanner()(text) if s[0] in se.BASE] == plain_base(text)


def test_entropy_spans_and_allow_list():
    scan = se.Scanner()
    key = "q7Xr2Lm9Tz4Kp8Vb1Nc6Hd3W"
    assert [s[0] for s in scan(f"key {key} end")] == ["entropy_alnum", "entropy_base64"]
    assert scan("id 3f2b8c1e-9d4a-4e7b-8a6c-5d1f0e9b7a2c end") == []
    assert scan("see abcdefghijKLMNOP0123456789xyzQRS") == []
    assert scan(f"use {key}EXAMPLE now") == []
    assert scan("thhatheringtionthouestnd") == []
    assert [s[0] for s in scan("A1B2C3D4E5F60718293A")] == ["entropy_hex"]


def test_query_over_documents(spark, sf):
    want = []
    for doc_id, text in documents(spark, sf):
        kinds = Counter(s[0] for s in plain_base(text))
        want.append((doc_id, *(kinds[k] for k in se.BASE)))
    got = QUERIES["op1_secret_scan"](spark, sf)
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex") == sorted(want, key=repr)


def test_odd_rows_and_redaction(spark):
    rows = [*ODD, (9, "x token=abcdef1234 y"), (10, "token=abcdef" + "0" * 24)]
    df = table(spark, rows)
    assert rows_of(se.find_secrets(df), "doc_id") == sorted([(i,) for i, _ in rows], key=repr)
    assert se.find_secrets(df.limit(0)).count() == 0
    after = dict(rows_of(se.redact_secrets(df), "doc_id", "text"))
    assert after[9] == "x [SECRET] y" and after[10] == "[SECRET]" and after[1] is None and after[7] == ODD[8][1]
    assert se.redact_secrets(df).columns == df.columns


@pytest.mark.parametrize("text,kinds", [
    ("key k9f3m2x7q8w1z5b4n6v0c2d8j3h5g7t1 end", {"entropy_lower"}),
    ("seed Q3ZK7XW2MNB5TJ4YHC6RDVPS2GLA", {"entropy_upper"}),
    ("MY_EXAMPLE_KEY=aB3dE6gH9jK2mN5pQ8sT1vW4", {"entropy_alnum", "entropy_base64"}),
    ("see /your_folder/aB3dE6gH9jK2mN5pQ8sT1vW4", {"entropy_alnum"}),
    ("EXAMPLEaB3dE6gH9jK2mN5pQ8sT1vW4", set()),
    ("chapter12paragraph34subsection", set()), ("ANNUALREPORTOFTHEYEAR2024FINAL", set()), ("internationalization0", set()),
])
def test_keys_of_one_case_and_placeholders_of_one_token(text, kinds):
    assert {k for k, _, _ in se.Scanner()(text)} == kinds

import hashlib
import random
from collections import defaultdict

import pytest

from flowsentry.llm import exact_dedup as ed
from tests.llm.cases import ODD, rows_of, table


@pytest.mark.parametrize("memory", [1 << 20, 2_000, 600])
def test_trie_keeps_every_string_once(memory):
    r = random.Random(memory)
    stems = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(12)]
    keys = [(r.choice(stems) + "".join(r.choice("abc") for _ in range(r.randint(0, 6)))).encode() for _ in range(800)] + [b"", b""]
    trie, want = ed.OwnerTrie(lambda a, b: (min(a[0], b[0]), a[1] + b[1]), memory), {}
    for i, k in enumerate(keys):
        trie.insert(k, (i, 1))
        old = want.get(k)
        want[k] = (min(old[0], i), old[1] + 1) if old else (i, 1)
    got = list(trie.owners())
    assert len(got) == len(want) and dict(got) == want
    assert bool(trie.spilled) == (memory < 1 << 20)


def test_deep_trie():
    trie = ed.OwnerTrie(lambda a, b: a + b)
    for n in range(3_000):
        trie.insert(b"a" * n, 1)
    assert len(list(trie.owners())) == 3_000


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        text = text or ""
        groups["".join(c for c in text if c not in " \t\n\x0b\x0c\r")].append((-len(text), i is None, i or 0, i))
    for norm, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        for *_, i in members:
            yield i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()


@pytest.mark.parametrize("memory", [ed.MEMORY, 500])
def test_groups(spark, memory):
    r = random.Random(4)
    rows = ODD + [(100 + i, r.choice(["a b", "ab", "a\nb ", "é é", "c" * 50, "", None, "d" * r.randint(1, 30)])) for i in range(300)]
    got = ed.dedup_exact(table(spark, rows), memory=memory)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute(rows), key=repr)
    kept = got.filter("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count() == got.select("text_sha256").distinct().count()
    assert ed.dedup_exact(table(spark, rows).limit(0)).count() == 0

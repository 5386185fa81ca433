"""Periodic runs against a plain loop over all periods; the registered query against its contract."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from caregrid.llm import periodic, queries
from tests.llm.test_documents import all_ids, ids


def plain_runs(s):
    """Every run by trying all periods."""
    n, out = len(s), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            part = s[i:i + size]
            if size >= max(6, 4 * q) and all(part[r:] != part[:size - r] for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_a_plain_loop():
    rng, seen = random.Random(3), 0
    for _ in range(800):
        docs = []
        for _ in range(rng.randint(1, 4)):
            letters, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, 60)
            s = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)] + [rng.randrange(letters) for _ in range(rng.randint(0, 20))]
            docs.append([b"%d" % x for x in s])
        for d, got in zip(docs, periodic.find_in(docs), strict=True):
            want = plain_runs(d)
            assert [tuple(r) for r in got.tolist()] == want
            seen += len(want)
            if d:
                whole = periodic.runs(np.unique(np.array(d), return_inverse=True)[1])
                assert [tuple(r) for r in whole.tolist()] == want
    assert seen > 500


def test_extensions_equal_comparison():
    rng = random.Random(5)
    s = [rng.randint(1, 2) for _ in range(400)] + [1] * 60
    common = periodic.Extensions(*periodic.Tree(s).tour())
    pairs = np.array([(i, j) for i in range(len(s)) for j in rng.sample(range(len(s)), 20) if i != j])
    want = [next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0) for i, j in pairs]
    assert common(pairs[:, 0], pairs[:, 1]).tolist() == want


def test_long_texts_stay_linear():
    for period in (1, 2, 37, 5000):
        assert periodic.runs(np.arange(60_000) % period).tolist() == [[0, 60_000, period]]


def contract(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words) if n < 3000 else [tuple(r) for r in periodic.find_in([[w.encode() for w in words]])[0].tolist()]
    keep = [True] * n
    for a, size, q in found:
        keep[a + q:a + size] = [False] * (size - q)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
            sha(" ".join(w for w, k in zip(words, keep, strict=True) if k)))


def test_query_equals_its_contract(spark, table, nothing, monkeypatch):
    df, rows = table
    monkeypatch.setattr(queries, "read", lambda *a: df)
    got = Counter(tuple(r) for r in queries.op11_periodic(spark, "").collect())
    want = Counter(contract(doc, text) for doc, text, *_ in rows)
    assert got == want
    assert sum(r[1] > 0 for r in got) >= 8
    monkeypatch.setattr(queries, "read", lambda *a: nothing)
    assert queries.op11_periodic(spark, "").count() == 0


def test_operator_keeps_rows_and_gives_texts(table):
    df, rows = table
    out = periodic.find_runs(df)
    assert ids(out) == all_ids(rows)
    long = out.where("doc_id = 9005").first()
    assert long["collapsed"] == "word" and [tuple(r) for r in long["runs"]] == [(0, 60_000, 1)]

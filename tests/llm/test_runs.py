import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimtrends.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, periods=4):
    """Every maximal stretch of equal words q apart, of those the ones with smallest period q."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, periods * q):
                own = words[i:i + length]
                if not any(all(own[k] == own[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    best = (None,) * 4
    if found:
        s, length, q = max(found, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]))
        best = s, length, q, 1000 * length // q
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *best, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in drop))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(2, 4))
def test_runs_equal_brute_force(words, periods):
    assert runs.runs(words, 2 * periods, periods) == plain_runs(words, 2 * periods, periods)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_documents_equal_brute_force(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.randrange(200):
        unit = [rng.choice(["a", "b", "c", "d"]).encode() for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
    assert runs.document_runs(words) == plain_runs(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80))
def test_common_extensions(words):
    tree = runs.SuffixTree(words)
    n = len(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    a, b = a[a != b], b[a != b]
    for i, j, k in zip(a, b, tree.lce(a, b), strict=True):
        x, y = words[i:], words[j:]
        assert k == next((m for m, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert sorted(range(n), key=lambda i: words[i:]) == sorted(range(n), key=lambda i: tree.rank[i])
    assert sorted(range(n), key=lambda i: [*words[i:], 9]) == sorted(range(n), key=lambda i: tree.late[i])


def test_long_range_minima():
    values = np.random.default_rng(1).integers(0, 10**6, 5_000)
    low = np.random.default_rng(2).integers(0, 5_000, 3_000)
    high = np.minimum(4_999, low + np.random.default_rng(3).integers(0, 4_000, 3_000))
    assert runs.Minima(values)(low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high, strict=True)]


def test_whole_table_equals_brute_force(llm):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in runs.detect(docs, change=runs.planted).collect())
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs.collect())
    assert any(r[1] for r in got)


@pytest.mark.parametrize("text,found", [
    ("x " * 6, [(0, 6, 1)]), ("x " * 5, []), ("a b " * 4, [(0, 8, 2)]), ("a b a b a b a", []),
    ("a b c " * 4 + "a", [(0, 13, 3)]), ("a a a a a a b " * 4, [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]),
])
def test_small_texts(text, found):
    assert runs.document_runs(text.encode().split()) == found


def test_edges(llm):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (None, "y " * 8, 9), (None, "y " * 8, 9), (5, "\xa0 " * 7, 9),
            (6, "Z z " * 30_000, 9), (7, "a b c d e f " * 4, 9)]
    frame = llm.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = sorted(map(tuple, runs.detect(frame).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1:])
    assert all(by_id[i] == [(0, None, None, None, None, empty, empty)] for i in (1, 2, 3))
    assert [r[:5] for r in by_id[None]] == [(1, 0, 8, 1, 8000)] * 2
    assert by_id[None][0][6] == hashlib.sha256(b"y").hexdigest()
    assert by_id[5][0][:5] == (1, 0, 7, 1, 7000)
    assert by_id[6][0][:5] == (1, 0, 60_000, 2, 30_000_000)
    assert by_id[6][0][6] == hashlib.sha256(b"Z z").hexdigest()
    assert by_id[7][0][:5] == (1, 0, 24, 6, 4000)
    assert runs.detect(frame.limit(0)).count() == 0

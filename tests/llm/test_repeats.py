import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from claimtrends.llm import repeats, suffix
from claimtrends.llm.queries import QUERIES

DOCS = "doc_id long, text string, spans string"


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, sha) of each text, from all strings counted."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = int(np.sum(gone[1:] < gone[:-1]))
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


def check(llm, texts, length, gram):
    docs = llm.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    repeats_ = repeats.repeats
    try:
        repeats.repeats = lambda d, **more: repeats_(d, **{**more, "gram": gram})
        got = {r.doc_id: tuple(r)[1:] for r in repeats.digests(docs, length=length).collect()}
    finally:
        repeats.repeats = repeats_
    assert [got[i] for i in range(len(texts))] == plain(texts, length)


def mixed(rng, n, alphabet="abcé "):
    passages = ["".join(rng.choices(alphabet, k=rng.randint(15, 90))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choices(alphabet + "xyz", k=rng.randint(1, 60)))
                 for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[0], texts[1], texts[1], None, "", "a" * 300, "ab" * 100, "ab" * 100 + "c", "a" * 300 + "b"]
    edited = list(texts[2] * 3)
    return [*texts, "".join(edited), "".join(edited[:-3]) + "!"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(llm, monkeypatch, seed):
    monkeypatch.setattr(repeats, "SHARD", 2_000)
    check(llm, mixed(random.Random(seed), 50), 20, 6)


def test_common_anchors_are_split_without_loss(llm, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 2_000)
    monkeypatch.setattr(repeats, "HOT", 300)
    rng = random.Random(5)
    lead = "the licence line of all "
    letters = lambda k: "".join(rng.choices("pqrst", k=k))
    texts = [letters(30) + lead + letters(30) for _ in range(40)]
    texts += [t[5:40] + letters(20) for t in texts[:10]] + [letters(9) + texts[3][8:] for _ in range(4)] + mixed(rng, 15)
    check(llm, texts, 20, 6)


def test_null_ids_and_empty_table(llm):
    text = "z" * 100 + "".join(random.Random(1).choices("abcdefgh", k=300))
    docs = llm.createDataFrame([(None, text, None), (1, text, "s"), (1, text, "s"), (2, text[:250], None), (3, text[:199], None)], DOCS)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.digests(docs).collect())
    assert got == Counter({(None, 400, 400, 1): 1, (1, 400, 400, 1): 2, (2, 250, 250, 1): 1, (3, 199, 0, 0): 1})
    assert repeats.digests(docs.limit(0)).count() == 0
    members, cuts = repeats.repeats(docs)
    assert members.columns == ["doc_id", "spans", "_key", "_bytes"]
    assert {tuple(s) for r in cuts.collect() for s in r.spans} == {(0, 400), (0, 250)}


def test_query_equals_brute_force(llm):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs], 200), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_repeats"](llm, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    for n in rng.integers(0, 70, 60):
        text = rng.integers(1, rng.integers(2, 6), n)
        if n % 3 == 0:
            text = np.tile(text[: n // 5], 5)
        text = np.append(text, 0).astype(np.uint16)
        order = suffix.suffix_array(text)
        own = text.tolist()
        assert order.tolist() == sorted(range(len(own)), key=lambda i: own[i:])
        previous, length = suffix.common_prefixes(text, order)
        for a, b in zip(order[1:], order[:-1], strict=True):
            same = 0
            while own[a + same] == own[b + same]:
                same += 1
            assert (previous[a], length[a]) == (b, same)
        for least in (1, 2, 5):
            strings = Counter(tuple(own[i:i + least]) for i in range(len(own) - least + 1))
            want = [i + least <= len(own) and strings[tuple(own[i:i + least])] > 1 for i in range(len(own))]
            assert suffix.repeated(text, least).tolist() == want


def _fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("body", [
    [3] * 5000, [1, 2] * 3000, _fibonacci(6000), [2, 1, 3, 1, 2] * 900 + [2, 1, 3, 1, 1], [9] * 2000 + [1] + [9] * 2000,
    list(range(1, 3000)) + list(range(1, 3000)), list(range(3000, 0, -1)) * 2,
], ids=["one byte", "two bytes", "fibonacci", "period", "two runs", "rising", "falling"])
def test_names_that_tie_are_sorted_by_the_same_algorithm(monkeypatch, body):
    """Degenerate texts, by doubled ranks; each level has at most half the symbols of the one above."""
    text = np.append(body, 0).astype(np.uint16)
    rank = text.astype(np.int64)
    for k in (2**i for i in range(14)):
        ahead = np.append(rank[k:], np.full(min(k, len(rank)), -1))[:len(rank)]
        rank = np.unique(np.stack([rank, ahead], 1), axis=0, return_inverse=True)[1].reshape(-1)
    levels, whole = [], suffix.suffix_array

    def watched(part):
        levels.append(len(part))
        return whole(part)

    monkeypatch.setattr(suffix, "suffix_array", watched)
    assert (rank[watched(text)] == np.arange(len(text))).all()
    assert all(b <= a // 2 + 1 for a, b in zip(levels, levels[1:], strict=False))
    if body[:2] == [1, 2] and len(body) == 6000:
        assert len(levels) > 1


@pytest.mark.parametrize("block", [7, 1 << 22])
def test_runs_cover_every_string_once(monkeypatch, block):
    monkeypatch.setattr(repeats, "_BLOCK", block)
    rng = np.random.default_rng(3)
    sizes = np.array([0, 30, 9, 10, 11, 0, 55, 40])
    data = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
    data[60:100] = 97
    offsets = np.concatenate([[0], sizes.cumsum()])
    own = repeats.runs(data, offsets, 10, 4)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(own.first, own.last, strict=True)])
    assert starts.tolist() == [o + i for o, n in zip(offsets, sizes, strict=False) for i in range(n - 9)]
    anchor = {}
    for a, at, first, last in zip(own.anchor, own.at, own.first, own.last, strict=True):
        for s in range(first, last + 1):
            assert s <= at <= s + 6
            string = data[s:s + 10].tobytes()
            assert anchor.setdefault(string, (a, at - s)) == (a, at - s)

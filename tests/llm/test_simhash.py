import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from claimtrends.llm import simhash
from claimtrends.llm.common import Stages
from claimtrends.llm.components import components, local_components
from claimtrends.llm.queries import QUERIES

from .conftest import SMALL


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ")
             .replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", [
    None, "", " \n ", "One", "one TWO", "a b c", "a b c d a b c", "Été À b c d", "x " * 5000,
])
def test_fingerprint_equals_plain_count(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(text, block=2) == plain_fingerprint(text)


def test_query_equals_brute_force(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    prints = [plain_fingerprint(t) for t in docs.text]
    want = dict(zip(docs.doc_id, zip(
        [f"{p:016x}" for p in prints], plain_components(list(docs.doc_id), prints), strict=True),
        strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](llm, SMALL).collect()}
    assert got == want


def test_edges_repeats_and_clashing_columns(llm):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "x"), (5, text, "x"), (3, text, "y"), (None, text, None), (9, None, None),
            (8, "", "z"), (None, "entirely other words stand here", None), (1, "short", None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("5", 3), ("5", 3), ("3", 3), ("None", 3), ("9", 8), ("8", 8),
                          ("None", None), ("1", 1)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["random", "cluster", "one half"])
def test_sharded_trees_lose_no_link(llm, monkeypatch, shape):
    """Many shards, fingerprints of near and dense groups: the same components as all pairs."""
    monkeypatch.setattr(simhash, "SHARD", 150)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(500)]
    if shape == "one half":
        base = [rng.getrandbits(32) for _ in range(900)]
    points = set(base)
    for p in (base[:1] * 900 if shape == "cluster" else base[:200]):
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        points.add(p)
    points = sorted(points)
    frame = llm.createDataFrame(pd.DataFrame({"fp": np.array(points, np.uint64).view(np.int64)}))
    stages = Stages(llm, "test")
    edges = simhash.linked(frame, stages).toPandas()
    at = {p: i for i, p in enumerate(np.array(points, np.uint64).view(np.int64).tolist())}
    label = local_components(len(points), edges.a.map(at).to_numpy(int), edges.b.map(at).to_numpy(int))
    want = plain_components(list(range(len(points))), points)
    assert label.tolist() == want
    assert len(edges) < 8 * len(points)
    spark_label = {r.node: r.label for r in components(llm.createDataFrame(edges), stages).collect()}
    for node, i in at.items():
        assert (spark_label.get(node, node) == node) == (spark_label.get(node) is None or node in spark_label.values())
    groups = {}
    for node, i in at.items():
        groups.setdefault(spark_label.get(node, node), set()).add(label[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(label.tolist()))


def test_components_of_a_long_chain(llm):
    stages = Stages(llm, "test")
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = llm.createDataFrame(list(zip(order, order[1:], strict=False)) + [(900, 901), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges, stages).collect()}
    assert {got[i] for i in order} == {got[order[0]]} and got[900] == got[901] != got[0]
    assert set(got) == {*order, 900, 901}

import numpy as np
import pandas as pd
import pytest

from claimtrends.llm import lanes, maxscore


def plain(ids, vectors, queries, top):
    out = []
    for q in queries:
        scores = vectors @ vectors[q]
        other = [i for i in range(len(ids)) if ids[i] != ids[q]]
        order = sorted(other, key=lambda i: (-scores[i], ids[i]))[:top]
        out += [(ids[q], r + 1, ids[i], int(scores[i])) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "sparse", "clusters"])
def test_equals_brute_force(llm, monkeypatch, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24))
    if kind == "ties":
        x = np.round(x)
    if kind == "sparse":
        x *= rng.random(x.shape) < 0.1
    if kind == "clusters":
        x = x[rng.integers(0, 12, 900)] + 0.05 * x
    monkeypatch.setattr(maxscore, "SHARD", 100)
    monkeypatch.setattr(maxscore, "QUERIES_PER_BLOCK", 7)
    monkeypatch.setattr(lanes, "LANES", 2)
    monkeypatch.setattr(lanes, "SHARDS_PER_LANE", 3)
    frame = llm.createDataFrame(pd.DataFrame({"vec_id": list(range(900)), "embedding": x.tolist()})).repartition(3)
    vectors = maxscore.quantised(frame)
    got = sorted(map(tuple, maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()))
    whole = np.floor(256 * x).astype(np.int64)
    assert got == plain(list(range(900)), whole, range(0, 900, 50), 5)


def test_edges(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5], 1), (0, [0.5, -0.5], 2), (1, [1.0, 0.0], 3), (2, [1.0, 0.0], 4), (2, [1.0, 0.0], 5),
            (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (None, [9.0, 9.0], 1),
            (50, [1.0], 1), (100, [], 1), (7, [-1.0, 0.003], 9)]
    frame = llm.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    vectors = maxscore.quantised(frame)
    got = sorted(map(tuple, maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 2, 32768), (0, 4, 7, -32768)]
    assert maxscore.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_products_beyond_a_long_are_an_error(llm):
    frame = llm.createDataFrame([(0, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>")
    vectors = maxscore.quantised(frame)
    with pytest.raises(Exception, match="do not fit"):
        maxscore.top_k(vectors, vectors).collect()


def test_plan_and_driver_do_not_grow_with_queries(llm, monkeypatch):
    """The same jobs for three queries as for many blocks, and no rows on the driver."""
    rng = np.random.default_rng(2)
    frame = llm.createDataFrame(pd.DataFrame({"vec_id": range(400), "embedding": rng.normal(size=(400, 8)).tolist()}))
    vectors = maxscore.quantised(frame)
    monkeypatch.setattr(maxscore, "QUERIES_PER_BLOCK", 8)
    shapes = []
    for every in (200, 2):
        found = maxscore.top_k(vectors, vectors.where(f"vec_id % {every} = 0"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        shapes.append((plan.count("Join"), plan.count("Relation"), plan.count("MapInArrow"), plan.count("Union")))
        assert found.count() == 5 * (400 // every)
    assert shapes[0] == shapes[1] == (1, 2, 1, 0)

import numpy as np
import pandas as pd
import pytest

from claimtrends.llm import lanes, negatives


def plain(rows, anchors):
    """rows and anchors are (id, vector, label); every pair is scored."""
    out = []
    for a, q, label in anchors:
        scored = [(-sum(x * y for x, y in zip(q, v)), i, lab) for i, v, lab in rows if i != a and len(v) == len(q)]
        same = sorted((s, i) for s, i, lab in scored if lab == label)[:5]
        for ps, p in same:
            fit = sorted((s, i) for s, i, lab in scored if lab != label and 80 * -ps <= 100 * -s <= 100 * -ps)[:5]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def as_rows(frame):
    return [(r.vec_id, r.v, r.label) for r in frame.collect()]


@pytest.mark.parametrize("kind", ["normal", "ties", "clusters", "copies", "norms"])
def test_equals_brute_force(llm, monkeypatch, kind):
    rng = np.random.default_rng(4)
    n = 900
    x, label = rng.normal(size=(n, 12)) / 3, rng.integers(0, 4, n)
    if kind == "ties":
        x = np.round(x)
    if kind == "clusters":
        x = x[rng.integers(0, 9, n)] + 0.02 * x
    if kind == "copies":
        x[100:400] = x[7]
    if kind == "norms":
        x *= rng.exponential(size=(n, 1)) ** 2
    monkeypatch.setattr(negatives, "SHARD", 150)
    monkeypatch.setattr(negatives, "BLOCK", 5)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(lanes, "LANES", 2)
    monkeypatch.setattr(lanes, "SHARDS_PER_LANE", 3)
    frame = llm.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": x.tolist(), "label": label})).repartition(3)
    vectors = negatives.quantised(frame)
    anchors = vectors.where("vec_id % 60 = 0")
    got = sorted(map(tuple, negatives.mine(vectors, anchors).collect()))
    assert got == plain(as_rows(vectors), as_rows(anchors)) and got


def test_tree_covers_its_points():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(size=(400, 6)), np.repeat(rng.normal(size=(1, 6)), 200, 0)])).astype(np.int64)
    labels = rng.integers(0, 9, 600)
    tree = negatives.cover_tree(x, labels)
    own, norms = x[tree["order"]].astype(float), (x.astype(float) ** 2).sum(1)
    own = np.concatenate([own, np.sqrt(norms.max() - norms[tree["order"]])[:, None]], 1)
    seen = np.zeros(600, int)
    for k in range(len(tree["centre"])):
        a, b, n, c = (tree[f][k] for f in ("first", "end", "children", "child"))
        assert a <= tree["centre"][k] < b
        assert np.linalg.norm(own[a:b] - own[tree["centre"][k]], axis=1).max() <= tree["radius"][k] + 1e-6
        assert tree["least"][k] == labels[tree["order"]][a:b].min() and tree["most"][k] == labels[tree["order"]][a:b].max()
        if n:
            assert [tree["first"][c], tree["end"][c + n - 1]] == [a, b]
            assert (tree["radius"][c:c + n] <= tree["radius"][k] / 2 + 1e-3).all()
        else:
            seen[a:b] += 1
    assert (seen == 1).all()


def test_branches_are_skipped(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(16, 8)).repeat(128, 0) + 0.001 * rng.normal(size=(2048, 8))
    x = np.floor(256 * x).astype(np.int64)
    found = negatives.cover_tree(x, np.zeros(2048, np.int64))
    order = found.pop("order")
    row = {"width": 8, "ids": np.arange(2048).tobytes(), "v": x[order].tobytes(), "labels": np.zeros(2048, np.int64).tobytes()}
    row |= {k: np.ascontiguousarray(found[k], t).tobytes() for k, t in negatives._FIELDS.items()}
    shard, offered = negatives.Shard(row), []
    windows = negatives.Windows(-1, 0, True, np.array([-2**62]), np.array([2**62]), 5)
    take = windows.offer
    monkeypatch.setattr(windows, "offer", lambda s, i, lab: (offered.append(len(s)), take(s, i, lab)))
    negatives.descend(shard, x[0], windows)
    assert sum(offered) < 600
    assert windows.held[0][0].tolist() == sorted((x @ x[0]).tolist(), reverse=True)[:5]


def test_edges(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, 5), (0, [1.0, 0.0], 1, 5), (1, [0.9, 0.0], 1, 5), (2, [0.8, 0.5], 2, 5), (2, [0.8, 0.5], 2, 5),
            (3, [0.9, 0.0], 3, 5), (4, [0.5, 0.0], 3, 5), (5, None, 1, 5), (6, [nan, 1.0], 1, 5), (8, [inf, 1.0], 2, 5),
            (9, [None, 1.0], 2, 5), (10, [0.85, 0.0], None, 5), (None, [0.85, 0.0], 2, 5), (11, [0.85], 2, 5),
            (100, [-1.0, 0.0], 1, 5), (200, [0.0, 0.0], 4, 5), (201, [0.0, 0.0], 4, 5), (300, [], 6, 5), (301, [], 6, 5), (302, [], 7, 5)]
    frame = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int")
    vectors = negatives.quantised(frame)
    anchors = vectors.where("vec_id % 100 = 0")
    got = sorted(map(tuple, negatives.mine(vectors, anchors).collect()))
    distinct = [x for i, x in enumerate(as_rows(anchors)) if x not in as_rows(anchors)[:i]]
    assert got == plain(as_rows(vectors), distinct)
    assert (0, 1, 1, 3, 58880, 58880) in got and (300, 301, 1, 302, 0, 0) in got
    assert negatives.mine(vectors.limit(0), vectors.limit(0)).count() == 0
    assert negatives.mine(vectors, vectors.limit(0)).count() == 0


def test_products_beyond_a_long_are_an_error(llm):
    frame = llm.createDataFrame([(0, [1e16], 1), (1, [1e16], 1)], "vec_id long, embedding array<double>, label int")
    vectors = negatives.quantised(frame)
    with pytest.raises(Exception, match="do not fit"):
        negatives.mine(vectors, vectors).collect()


def test_large_products_are_exact(llm):
    frame = llm.createDataFrame([(0, [3e5 + 0.1, 1.0], 1), (1, [3e5 + 0.2, 2.0], 1), (2, [3e5 + 0.05, 1.0], 2), (3, [3e5 + 0.1, 0.5], 2)],
                                "vec_id long, embedding array<double>, label int")
    vectors = negatives.quantised(frame)
    got = sorted(map(tuple, negatives.mine(vectors, vectors.where("vec_id = 0")).collect()))
    assert got == plain(as_rows(vectors), [x for x in as_rows(vectors) if x[0] == 0]) and len(got) == 2

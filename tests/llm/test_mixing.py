import re
from collections import defaultdict
from fractions import Fraction

import pytest

from claimtrends.llm import mixing

from .conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(words, weights=(5, 2, 1), epochs=3):
    """source -> target by clamping one round after the other."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(words.values()), {}
    while True:
        open_ = [s for s in order if s not in clamped]
        if not open_:
            return clamped
        level = Fraction(total - sum(clamped.values()), sum(weight[s] for s in open_))
        over = [s for s in open_ if weight[s] * level > epochs * words[s]]
        if not over:
            return clamped | {s: weight[s] * level for s in open_}
        clamped |= {s: Fraction(epochs * words[s]) for s in over}


def check(rows, near):
    words, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        words[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = plain_targets(words)
    for r in rows:
        assert r.source_size == words[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
    for s in want:
        assert abs(taken[s] - want[s]) <= near(s), (s, taken[s], float(want[s]))
    repeats = defaultdict(set)
    for r in rows:
        if r.size:
            repeats[r.source].add(r.taken // r.size)
    assert all(max(x) - min(x) <= 1 for x in repeats.values())
    return want


@pytest.mark.parametrize("cell", [256, 4])
def test_whole_table(llm, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    monkeypatch.setattr(mixing, "AIM", max(1, cell // 2))
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes = {r.doc_id: len(WORD.findall(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == sizes and len(rows) == len(sizes)
    check(rows, lambda s: 20 if cell == 256 else 3_000)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(again) == sorted(rows)


def test_edges(llm):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, "d\te f\n", None, 9), (2, None, "x", 9), (3, "", "", 9),
            (4, "g " * 50_000, "y", 9), (5, "one", "", 9), (None, None, None, 9), (6, "h i j", "\U0001F600", 9)]
    frame = llm.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(frame).collect()
    assert sorted(r.size for r in out) == [0, 0, 0, 1, 2, 3, 3, 3, 50_000]
    want = check(out, lambda s: 25_000 if s == "y" else 2)
    assert set(want) == {"", "x", "y", "\U0001F600", None}
    assert mixing.mix(frame.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(frame.withColumn("text", mixing.F.lit(" "))).collect())


def test_one_row_repeated_and_one_hot_source(llm):
    hot = llm.range(3_000).selectExpr("7L doc_id", "'same words here' text", "'hot' source")
    rest = llm.range(6_000).selectExpr(
        "id + 100 doc_id", "repeat(concat('w', id, ' '), cast(1 + id % 9 as int)) text",
        "case when id % 3 = 0 then 'hot' else concat('s', id % 40) end source")
    rows = mixing.mix(hot.unionByName(rest).repartition(5)).collect()
    check(rows, lambda s: 2)


def test_cascade_of_clamps():
    words = {f"s{i:02d}": 2**i for i in range(12)} | {None: 5}
    want = plain_targets(words)
    assert sum(want.values()) == sum(words.values())


def test_water_level_equals_rounds_of_clamping(llm):
    words = {f"s{i:02d}": 2**i for i in range(12)} | {None: 5, "": 0}
    want = plain_targets(words)
    from claimtrends.llm.common import Stages
    frame = llm.createDataFrame([(s, w, 1) for s, w in words.items()], "source string, words long, docs long")
    got = {r.source: r.target for r in mixing.targets(frame, Stages(llm, "test")).collect()}
    assert got == pytest.approx({s: float(t) for s, t in want.items()})


def test_small_table_is_read(llm):
    assert mixing.mix(llm.read.parquet(f"{SMALL}/documents.parquet")).count() == 200

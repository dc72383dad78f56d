import numpy as np
import pytest

from claimtrends.llm import decontaminate

DOCS = "doc_id long, text string, item_id string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def found(llm, docs, items, **more):
    docs = llm.createDataFrame(docs, DOCS)
    items = llm.createDataFrame(items, "item_id long, text string, doc_id string")
    return sorted(map(tuple, decontaminate.contaminated(docs, items, **more).collect()), key=str)


def test_share_of_shingles_decides(llm):
    words = ITEM.split()  # 11 shingles, 9 needed
    filler = " ".join(f"w{i}" for i in range(3000))
    docs = [
        (1, f"{filler} {ITEM} {filler}", None), (2, filler, None),
        (3, " ".join(["x", *words[:13], "y"]), None),   # 9 shingles
        (4, " ".join(["x", *words[:12], "y"]), None),   # 8 shingles
        (5, "ALPHA, beta; " + " ".join(words[2:]), "z"), (None, ITEM, None), (1, f"{filler} {ITEM} {filler}", None),
        (6, None, None), (7, "", None),
    ]
    got = found(llm, docs, [(10, ITEM, "a"), (11, None, None), (12, " . ", None)])
    assert got == sorted([(1, 10, 11, 11, 1.0), (1, 10, 11, 11, 1.0), (3, 10, 9, 11, 9 / 11),
                          (5, 10, 11, 11, 1.0), (None, 10, 11, 11, 1.0)], key=str)


def test_short_items_repeats_and_nulls(llm):
    docs = [(1, "one two three four", None), (2, "two  THREE", None), (3, "three two", None)]
    items = [(1, "two three", None), (1, "two three", None), (None, "two", None)]
    got = found(llm, docs, items)
    assert got == sorted([(1, 1, 1, 1, 1.0)] * 2 + [(2, 1, 1, 1, 1.0)] * 2
                         + [(i, None, 1, 1, 1.0) for i in (1, 2, 3)], key=str)
    assert found(llm, docs, []) == [] and found(llm, [], items) == []


def test_blocks_of_items_give_the_same(llm, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(rng.integers(1, 30)), None) for i in range(60)]
    docs = [(i, " ".join([text(20), items[rng.integers(60)][1], text(400)]), None) for i in range(60)]
    want = found(llm, docs, items)
    plain = []
    for d, text_, _ in docs:
        for i, item, _ in items:
            ws, k = item.split(), min(5, len(item.split()))
            a = {tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)}
            b = {tuple(text_.split()[j:j + k]) for j in range(len(text_.split()) - k + 1)}
            if len(a & b) >= 0.8 * len(a) - 1e-9:
                plain.append((d, i, len(a & b), len(a), len(a & b) / len(a)))
    assert want == sorted(plain, key=str) and len(want) >= 60
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    assert found(llm, docs, items) == want


def test_clean_keeps_rows_and_columns(llm):
    docs = llm.createDataFrame([(1, ITEM, "x"), (2, "something else entirely", None), (None, None, "y")], DOCS)
    items = llm.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = decontaminate.clean(docs, items)
    assert out.schema == docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 2").collect()))


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 20, 66])
def test_a_sketch_leaves_less_than_the_need(n):
    assert n - (n - decontaminate.need(n, 0.8) + 1) < decontaminate.need(n, 0.8)

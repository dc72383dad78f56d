import itertools
import zlib

import numpy as np
import pytest

from claimtrends.llm import crf
from claimtrends.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def plain_marginals(scores, moves, start):
    n, size = scores.shape
    out = np.zeros((n, size))
    for path in itertools.product(range(size), repeat=n):
        weight = start[path[0]] + sum(scores[t, k] for t, k in enumerate(path))
        weight = np.exp(weight + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for t, k in enumerate(path):
            out[t, k] += weight
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_marginals_equal_all_paths(monkeypatch, block):
    monkeypatch.setattr(crf, "BLOCK", block)
    rng = np.random.default_rng(2)
    lengths = np.array([1, 6, 3, 2, 7])
    scores, moves, start = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = crf.marginals(scores, lengths, moves, start)
    for part, end in zip(lengths, lengths.cumsum(), strict=True):
        assert np.allclose(got[end - part:end], plain_marginals(scores[end - part:end], moves, start))


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    scores, gold = rng.normal(size=(2, 4, 3)), rng.integers(0, 3, (2, 4))
    model = crf.Model(["a", "b", "c"], None, None, None, None, rng.normal(size=(3, 3)), rng.normal(size=3))

    def likelihood(s, moves, start):
        total = 0
        for i in range(2):
            value = lambda path, i=i: start[path[0]] + sum(s[i, t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
            total += value(gold[i]) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=4)))
        return total

    grads = crf._gradient(scores, gold, model)
    for which, at in ((0, (1, 2, 0)), (0, (0, 0, 1)), (1, (2, 1)), (2, (1,))):
        args = [scores.copy(), model.transitions.copy(), model.start.copy()]
        args[which][at] += 1e-5
        up = likelihood(*args)
        args[which][at] -= 2e-5
        assert (up - likelihood(*args)) / 2e-5 == pytest.approx(grads[which][at], abs=1e-5)


def test_held_out_accuracy(llm):
    got = QUERIES["op4_language"](llm, FOLDER).toPandas()
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    both = got.merge(docs, on="doc_id")
    assert len(both) == 10_000 and both.score.between(0, 1).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.99


def test_code_switched_text_and_edges(llm):
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = crf.fit(docs, sample=800)
    words = {x: docs.where(f"lang = '{x}' and length(text) > 900").orderBy("doc_id").first().text.split()[:40] for x in ("en", "de")}
    mixed = " ".join(words["en"] + words["de"] + words["en"][::-1])
    rows = [(1, mixed, "old"), (2, None, None), (3, "", "x"), (4, "12 — … 34 !!", None), (None, " ".join(words["de"]), "x"),
            (5, "日本", None), (1, mixed, "old"), (6, " ".join(words["en"]) + " z" * 30_000, None)]
    frame = llm.createDataFrame(rows, "doc_id long, text string, score string")
    out = {r.doc_id: r for r in crf.identify(frame, model, spans=True).collect()}
    assert crf.identify(frame, model).columns == ["doc_id", "text", "lang_pred", "score"]
    spans = [s.lang for s in out[1].lang_spans if s.last - s.first > 4]
    assert spans == ["en", "de", "en"] and out[1].lang_pred == "en" and 0.5 < out[1].score < 0.9
    assert out[None].lang_pred == "de" and out[None].lang_spans[0].first == 0
    assert [(out[i].lang_pred, out[i].score, out[i].lang_spans) for i in (2, 3, 4)] == [("und", 0.0, [])] * 3
    assert out[5].lang_pred in model.labels and out[6].lang_spans[-1].last >= 30_000
    assert crf.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in crf.identify(frame, None).collect()} == {"und"}
    assert crf.identify(frame.limit(0), model).count() == 0


def test_training_input_is_bounded_and_the_same_in_any_order(llm):
    """One id on a third of the rows, texts of 20 MB, and the same id with two languages."""
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    hot = llm.range(500).selectExpr("7L doc_id", "concat('hot words here ', id) text", "if(id % 2 = 0, 'en', 'de') lang")
    long = llm.range(4).selectExpr("id + 5000 doc_id", "repeat('das ist ein langer Text ', 850000) text", "'de' lang")
    frame = docs.unionByName(hot).unionByName(long)
    one, two = (crf.fit(x, sample=300) for x in (frame, frame.repartition(13, "text")))
    assert one.labels == two.labels
    assert all(np.array_equal(a, b) for a, b in zip(one[1:], two[1:], strict=True))
    got = crf.identify(docs.select("doc_id", "text"), one).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97

import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from claimtrends.llm import quality
from claimtrends.llm.common import sampled, utf8
from claimtrends.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def rows(texts):
    return quality.features(*utf8(pa.array(texts, pa.large_string())))


def dense(texts):
    r = rows(texts)
    out = np.zeros((len(texts), r.columns.max() + 1))
    for i in range(len(texts)):
        np.add.at(out[i], r.columns[r.start[i]:r.start[i + 1]], r.values[r.start[i]:r.start[i + 1]])
    return out


def test_features_do_not_depend_on_the_batch():
    texts = ["a b a", None, "", "x | y | z", "a b a", "été, ÉTÉ!", "w " * 5000]
    whole = rows(texts)
    for i, t in enumerate(texts):
        own, span = rows([t]), slice(whole.start[i], whole.start[i + 1])
        assert sorted(zip(own.columns, own.values.round(9))) == sorted(zip(whole.columns[span], whole.values[span].round(9)))
    assert len(rows([""]).columns) == 1
    shares = dense(["a b a"])[0][1:1 + quality.ORDER * quality.TIMES]
    assert shares[0] == pytest.approx(1 / 3) and shares[1] == pytest.approx(2 / 3)
    assert shares[quality.TIMES] == 1


def test_ftrl_equals_plain_updates():
    texts, labels = ["good words here", "bad $$$ words", "good", "$$$ $$$"], np.array([1.0, 0, 1, 0])
    x = dense(texts)
    z, n = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = lambda: np.where(abs(z) <= quality.L1, 0, -(z - np.sign(z) * quality.L1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2))
    rng = np.random.default_rng(3)
    for _ in range(2):
        for r in rng.permutation(4):
            w = weight()
            g = (1 / (1 + np.exp(-(w @ x[r]))) - labels[r]) * x[r]
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA * w
            n += g * g
    got = quality.learn(rows(texts), labels, passes=2)
    assert np.allclose(got[: len(z)], weight()) and not got[len(z):].any()


def test_held_out_accuracy(llm):
    got = QUERIES["op2_quality"](llm, FOLDER).toPandas()
    labels = llm.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.98
    assert both[both.quality == 1].predicted.mean() > 0.99


def test_edges(llm):
    docs = llm.createDataFrame([(1, None, 0.1), (1, "", 0.2), (None, "x y", None), (2, "x y", 0.3)],
                               "doc_id long, text string, score double")
    labels = llm.createDataFrame([(1, 1), (2, None), (None, 1), (2, 0), (2, 0), (9, 1)], "doc_id long, label int")
    weights = quality.fit(docs, labels)
    out = sorted(map(tuple, quality.scored(docs, weights).collect()), key=str)
    assert len(out) == 4 and out[0][1] == out[1][1]
    none = quality.fit(docs.limit(0), labels.limit(0))
    assert not none.any()
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), none).count() == 0


def test_training_input_is_bounded_and_the_same_in_any_order(llm, monkeypatch):
    """One id on a third of the rows, a text of 20 MB, and more labelled texts than are learned from."""
    plain = llm.range(600).selectExpr("id doc_id", "concat('w', id % 7, ' good'  , id % 3, ' text ', id) text")
    hot = llm.range(300).selectExpr("5L doc_id", "concat('hot ', id) text")
    long = llm.range(1).selectExpr("1000L doc_id", "repeat('long text here ', 1400000) text")
    docs = plain.unionByName(hot).unionByName(long)
    labels = llm.range(600).selectExpr("id doc_id", "cast(id % 2 as int) label").unionByName(
        llm.createDataFrame([(1000, 1), (5, 0), (5, 1), (None, 1)], "doc_id long, label int"))
    monkeypatch.setattr(quality, "PER_LEARNER", 100)
    seen = []
    for frame in (docs, docs.repartition(11, F.rand(3)).orderBy(F.desc("text"))):
        weights = quality.fit(frame, labels.orderBy(F.rand(1)), sample=400)
        assert weights.any()
        seen.append(weights)
    assert np.array_equal(*seen)
    once = sampled(docs, "doc_id", 10_000, "text")
    assert once.count() == 601 and once.where("doc_id = 5").count() == 1
    some = sampled(docs, "doc_id", 10_000, "text", 1_000_000)
    assert sorted(some.drop("text").collect()) == sorted(once.where("doc_id < 1000").drop("text").collect())
    few = sampled(docs, "doc_id", 50, "text", 600).collect()
    assert 10 < len(few) < 50 and sum(len(r.text.encode()) for r in few) <= 600
    assert sorted(sampled(docs.repartition(9), "doc_id", 50, "text", 600).collect()) == sorted(few)
    nulls = llm.createDataFrame([(None, None), (None, "b"), (1, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sampled(nulls, "doc_id", 9, "text").count() == 2
    assert sampled(nulls.limit(0), "doc_id", 9, "text").count() == 0

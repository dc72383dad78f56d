import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from claimtrends.llm import pieces
from claimtrends.llm.common import utf8
from claimtrends.llm.queries import QUERIES, TOKENIZER

from .conftest import SMALL

MODEL = pieces.load(TOKENIZER)
ODD = ["", " ", "  a", "a  b   c", "a ", "\n\t x", "▁", "a▁b ▁▁ c", "日本語 😀 \x00", "é" * 300, "=" * 500,
       "ab" * 4000, " x", "Hello world", "a b " * 3, "x" + " " * 70 + "y"]


def best_by_all_ends(model, signs):
    """Plain dynamic programme: the best score over all segmentations."""
    best = [0.0] + [-math.inf] * len(signs)
    for end in range(1, len(signs) + 1):
        for start in range(max(0, end - model.longest), end):
            piece = model.pieces.get(signs[start:end])
            if piece:
                best[end] = max(best[end], best[start] + piece[0])
        if signs[end - 1] not in model.pieces:
            best[end] = max(best[end], best[end - 1] + pieces.BYTE_SCORE * len(signs[end - 1].encode()))
    return best[-1]


def value(model, ids):
    score = {i: s for s, i in model.pieces.values()}
    return sum(score.get(i, pieces.BYTE_SCORE) for i in ids)


@pytest.mark.parametrize("check", [1, 5, 64])
def test_stream_is_the_best_segmentation(check):
    rng = random.Random(2)
    words = ["▁the", "▁" + "".join(rng.choices("abcdeé日t", k=40)), "▁▁▁▁x", "ing" * 50, "日" * 20, "q" * 200]
    for word in words:
        runs = list(pieces.stream(MODEL, word, check))
        assert value(MODEL, itertools.chain(*runs)) == pytest.approx(best_by_all_ends(MODEL, word))
    assert len(list(pieces.stream(MODEL, "the quick " .replace(" ", "▁") * 40, check))) > (10 if check < 64 else 3)


def test_window_stays_bounded(monkeypatch):
    widest = 0
    real = pieces._meeting

    def watch(live, back):
        nonlocal widest
        widest = max(widest, len(back))
        return real(live, back)

    monkeypatch.setattr(pieces, "_meeting", watch)
    text = "".join(random.Random(1).choices("abcdefgh", k=20_000))
    assert sum(len(x) for x in pieces.stream(MODEL, text)) > 1000
    assert widest < 400


@pytest.mark.parametrize("split", [True, False])
def test_exact_round_trip_of_odd_texts(split):
    model = MODEL._replace(split=split)
    data, offsets = utf8(pa.array([*ODD, None], pa.large_string()))
    ids, of = pieces.encode(model, data, offsets)
    back, back_of = pieces.decode(model, ids, of)
    assert back.tobytes() == data.tobytes() and (back_of == offsets).all()
    for i, text in enumerate(ODD):
        own = ids[of[i]:of[i + 1]].tolist()
        want = best_by_all_ends(model, ("▁" + text.replace(" ", "▁"))) if "▁" not in text and text else None
        if want is not None:
            assert value(model, own) == pytest.approx(want), text


def test_words_side_by_side_equal_the_stream():
    rng = random.Random(7)
    words = ["".join(rng.choices(["th", "er", "é", " ", "日", "x", "ion", "\x00", "😀", "Q"], k=rng.randint(1, 20))) for _ in range(500)]
    words = [" " * rng.randint(0, 3) + w.replace(" ", "") for w in words]
    words = [w for w in words if w]
    data, offsets = utf8(pa.array(words, pa.large_string()))
    ids, count = pieces.encode_words(MODEL, data, offsets)
    at = 0
    for word, n in zip(words, count.tolist(), strict=True):
        assert ids[at:at + n].tolist() == pieces.encode_word(MODEL, word.encode()), word
        at += n
    assert at == len(ids)


def test_query_covers_all_documents_exactly(llm):
    out = QUERIES["op7_pieces"](llm, SMALL)
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert out.count() == docs.count() and out.where("not exact or size(ids) <> n_ids").count() == 0
    back = pieces.decoded(out, MODEL).select("doc_id", "text")
    assert back.exceptAll(docs).count() == 0
    import sentencepiece
    plain = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    row = out.orderBy("doc_id").first()
    assert plain.decode(row.ids) == docs.where(f"doc_id = {row.doc_id}").first().text


def test_columns_nulls_repeats_and_errors(llm):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x y", "c"), (2, "x y", None), (2, "x y", None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encoded(docs, MODEL)
    assert out.columns == ["doc_id", "ids", "n_ids", "exact"]
    got = sorted(((r.doc_id, r.ids, r.n_ids, r.exact) for r in out.collect()), key=str)
    ids = next(r[1] for r in got if r[0] == 2)
    assert got == sorted([(1, None, 0, True), (1, [], 0, True), (None, ids, len(ids), True),
                          (2, ids, len(ids), True), (2, ids, len(ids), True)], key=str)
    assert sorted(map(str, (r.text for r in pieces.decoded(out, MODEL).collect()))) == ["", "None", "x y", "x y", "x y"]
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0
    with pytest.raises(Exception, match="not in the model"):
        pieces.decoded(llm.createDataFrame([([40_000],)], "ids array<int>"), MODEL).collect()
    assert np.all(np.diff(sorted(i for _, i in MODEL.pieces.values())) > 0)


def test_both_paths_give_the_same_ids_over_a_table(llm, monkeypatch):
    texts = [r.text for r in llm.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    ids, ends = pieces.encode(MODEL, data, offsets)
    monkeypatch.setattr(pieces, "SHORT", 0)
    streamed, same_ends = pieces.encode(MODEL, data, offsets)
    assert len(ids) and np.array_equal(ids, streamed) and np.array_equal(ends, same_ends)

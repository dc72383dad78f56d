import numpy as np
import pytest

import corpus_pipeline
from claimtrends.llm import pieces, secrets
from claimtrends.llm.common import Stages

from .conftest import SMALL
from .test_simhash import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_dedup", "decontamination", "redaction", "encoding"]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" ")


def shingles(text):
    ws = [w for w in words(text) if w]
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def test_each_stage_equals_plain_code(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    more = [(9001, None, None, "x", 0), (9002, "", "en", "x", 0), (9003, "1234 .. 99", None, None, 9),
            (None, "a null id with words of its own here", "en", None, 36), (9004, docs.first().text, None, "x", 1),
            (9005, 'the one with a token = "4efe2d42c16b845d5c2e16d71d7cc67296c995e8" and more of that', "en", "x", 1)]
    docs = docs.unionByName(llm.createDataFrame(more, docs.schema))
    stages, seen = Stages(llm, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stages.save(stage(llm, docs, SMALL), name)
        if name != "encoding":
            assert docs.columns == COLUMNS
        seen[name] = before.collect(), docs.collect()

    before, after = seen["language"]
    kept = {r.doc_id for r in after}
    assert {r.doc_id for r in before} - kept == {9001, 9002, 9003}
    assert all(r.lang for r in after)

    before, after = seen["near_dedup"]
    ids = [r.doc_id for r in before]
    group = plain_components(ids, [plain_fingerprint(r.text) for r in before])
    assert sorted(map(str, (r.doc_id for r in after))) == sorted(map(str, {g for g, i in zip(group, ids, strict=True)}))
    assert len(after) < len(before)

    before, after = seen["decontamination"]
    items = [s for r in llm.read.parquet(f"{SMALL}/benchmark.parquet").collect() if (s := shingles(r.text))]
    clean = [r for r in before if not any(len(s & shingles(r.text)) >= 0.8 * len(s) - 1e-9 for s in items)]
    assert sorted(after, key=str) == sorted(clean, key=str) and len(after) < len(before)

    before, after = seen["redaction"]
    was = {r.doc_id: r for r in before}
    assert len(after) == len(before)
    assert all(r.text == was[r.doc_id].text for r in after if "[secret]" not in r.text)
    assert all(r.n_chars == len(r.text) and r.source == was[r.doc_id].source for r in after)
    assert not any(e - s > 12 for r in after for _, _, e, s in secrets.base(r.text))
    assert any("[secret]" in r.text for r in after)

    before, after = seen["encoding"]
    model = pieces.load(corpus_pipeline.TOKENIZER)
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before) and all(r.exact for r in after)
    for r in after:
        out = pieces.decode(model, np.array(r.ids), np.array([0, len(r.ids)]))[0]
        assert out.tobytes().decode() == texts[r.doc_id]


def test_run_gives_the_rows_of_the_stages(llm):
    out = corpus_pipeline.run(llm, SMALL)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_ids", "exact"]
    assert 0 < out.count() < llm.read.parquet(f"{SMALL}/documents.parquet").count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(llm, name, stage):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert stage(llm, docs, SMALL).count() == 0

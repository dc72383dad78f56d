import corpus_pipeline
from claimtrends.llm import crf

from .conftest import SMALL


def test_a_clean_text_in_several_languages_stays(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    by = {}
    for r in docs.where("lang is not null").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).extend(r.text.split())
    most = sorted(by, key=lambda k: (-len(by[k]), k))[:5]
    mixed = [(9101 + n, " ".join(" ".join(by[k][:120]) for k in most[:n]), None, "x", 1) for n in (2, 3, 4, 5)]
    mixed = llm.createDataFrame([*mixed, (9100, "12 34 ..", None, "x", 1)], docs.schema)
    # The former rule, on the share of one language, lets some of them go.
    scores = crf.identify(mixed, crf.fit(docs.unionByName(mixed))).where("doc_id > 9100").select("score").collect()
    assert min(r.score for r in scores) < 0.5
    kept = corpus_pipeline.language(llm, docs.unionByName(mixed), SMALL).where("doc_id > 9000").collect()
    assert sorted(r.doc_id for r in kept) == [9103, 9104, 9105, 9106]
    assert all(r.lang for r in kept)


def test_documents_stay_without_a_model(llm):
    rows = [(1, "some words", None, "x", 1), (2, "12 34", None, "x", 1), (3, None, None, "x", 1), (4, "été", None, "x", 1)]
    docs = llm.createDataFrame(rows, llm.read.parquet(f"{SMALL}/documents.parquet").schema)
    kept = corpus_pipeline.language(llm, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, None), (4, None)]

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from twins import DATA, assert_twins, connect

import corpus_pipeline
from gleaner.llm import catalog, quality, simhash
from gleaner.llm.common import table

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert_twins(spark, connect(), catalog.queries()[name], ORACLES[name])


def test_all_are_registered():
    assert {n.split("_")[0] for n in catalog.queries()} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, DATA, "documents")
    good = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert good.columns == docs.columns
    model = quality.fit_quality(docs, table(spark, DATA, "labels"))
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= 0.3}

    one = corpus_pipeline.dedup_stage(spark, good, DATA)
    assert one.columns == docs.columns
    texts = [r.text for r in one.collect()]
    normal = [" ".join(t.lower().split()) for t in texts]
    assert len(set(normal)) == len(normal)  # no exact copies are left
    kept = {r.doc_id for r in one.collect()}
    roots = {r.id.id: r.root.id for r in simhash.sketch_classes(good.selectExpr("struct(doc_id AS id, 0L AS h) AS r", "text"), "r", "text").collect()}
    assert kept == set(roots.values())

    clean = corpus_pipeline.secrets_stage(spark, one, DATA)
    assert clean.columns == docs.columns and clean.count() == one.count()
    mixed = corpus_pipeline.mixing_stage(spark, clean, DATA)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == kept  # none dropped
    tokens = corpus_pipeline.tokens_stage(spark, mixed, DATA)
    assert tokens.count() == mixed.count()


def test_empty_pipeline(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0

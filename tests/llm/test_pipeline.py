"""The pipeline, stage by stage, on the smallest tables and on awkward rows."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from indemna.llm.common import settle

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after and after <= before, name
        if name != "mixing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
            assert docs.count() == len(after)
        before = after
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_letter_salad_is_rejected(spark):
    rng = random.Random(31)
    real = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null and lang is not null").orderBy("doc_id").limit(150).select("text", "lang").collect()
    salad = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(30)) for letters in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") for _ in range(10)]
    short = [" ".join(r.text.split()[:5]) for r in real if len(r.text.split()) > 50][:30]
    rows = [(i, r.text, r.lang, "x", 0) for i, r in enumerate(real)] + [(1000 + i, t, None, "x", 0) for i, t in enumerate(short)] + [(2000 + i, t, None, "x", 0) for i, t in enumerate(salad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, FOLDER).select("doc_id").collect()}
    assert len(short) == 30 and set(range(1000, 1030)) <= kept
    assert not kept & set(range(2000, 2020))


@pytest.mark.parametrize("n", [0, 4])
def test_awkward_rows(spark, n):
    rows = [(1, None, "en", None, None), (2, "", None, "src1", 0), (3, "the thing is what it is and was", None, "src1", 5), (3, "the thing is what it is and was", "en", "x", 5)][:n]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER))
    assert docs.count() <= n


def test_rows_of_one_id_and_without_id(spark):
    """Unlike texts of one id all stay; of a group one row does, with an id before one without."""
    rng = random.Random(59)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(4)]
    near = lambda t: t + " more"
    rows = [(1, texts[0]), (1, texts[1]), (2, near(texts[0])), (None, near(texts[1])), (None, texts[2]), (None, texts[2]), (3, texts[3]), (3, texts[3]), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (3, texts[3]), (4, ""), (4, None)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)

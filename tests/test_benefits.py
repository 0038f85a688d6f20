"""Markers of treatments and of their cover against texts with known results; hooks for models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from indemna.functions import benefits as b
from indemna.operators import facts, retrieval


def items(spark, said):
    rows = spark.createDataFrame([(said,)], "said string")
    return [tuple(x) for x in b.treatment_items(rows, "said").first()["items"] or []]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        (None, []),
        ("", []),
        ("2026-08-10 도수치료 통원, 진료비 10만원", [(b.MUSCULOSKELETAL, "도수치료")]),
        ("빈도수가 늘어남", []),
        ("체외충격파쇄석술", []),
        ("eswt 3회와 fims", [(b.MUSCULOSKELETAL, "eswt")]),
        ("도\u200b수치료를 받음", [(b.MUSCULOSKELETAL, "도수치료")]),
        ("영양주사로 맞음", [(b.INJECTION, "영양주사")]),
        ("엠알아이", [(b.MRI, "엠알아이")]),
        ("무릎 mri", [(b.MRI, "mri")]),
        ("비 급여 진료", [(b.NONCOVERED, "비급여")]),
        ("치료비 급여 항목", [(b.COVERED, "급여 항목")]),
        ("실비보험 청구", []),
        ("비보험", [(b.NONCOVERED, "비보험")]),
        ("非給與", [(b.NONCOVERED, "非給與")]),
        ("지급 여부", []),
        ("급여 적용 안 되는 진료", []),
        ("급여 본인부담률 20%", []),
        ("요양급여 중 본인부담금", [(b.COVERED, "요양급여 중 본인부담금")]),
        ("비급여: 없음", [(b.NONCOVERED, "비급여"), (b.COVERED, "비급여: 없음")]),
        ("급여ㆍ비급여 합계", [(b.NONCOVERED, "비급여"), (b.COVERED, "급여ㆍ비급여")]),
        ("진료비 100만원, 비급여 30만원", [(b.NONCOVERED, "비급여"), (b.COVERED, "비급여 30만원")]),
        ("비급여 10만원 통원", [(b.NONCOVERED, "비급여")]),
        ("진료비 10만원, 비급여 10만원", [(b.NONCOVERED, "비급여")]),
        ("임의비급여 없음", [(b.NONCOVERED, "비급여")]),
        ("근로복지공단 부담", []),
        ("무릎\n주사", [(b.INJECTION, "주사")]),
        ("\U0001f600 공단이 부담했어요", [(b.COVERED, "공단이 부담했어요")]),
    ],
)
def test_items(spark, said, want):
    assert items(spark, said) == want


def test_long_blanks_end_soon(spark):
    assert items(spark, "급여" + " " * 20_000 + "끝") == []


def test_carved_out(spark):
    texts = [(1, b.SEVERE, "도수치료와 비급여 주사"), (2, b.BENEFIT, "도수치료와 비급여 주사"), (3, b.MILD, "급여 항목"), (4, "해외여행", "MRI")]
    rows = b.treatment_items(spark.createDataFrame(texts, "id int, product string, said string"), "said")
    got = sorted((r.id, r.item, r.excluded) for r in b.carved_out(rows).collect())
    assert got == [(1, b.MUSCULOSKELETAL, False), (1, b.INJECTION, False), (2, b.NONCOVERED, True), (3, b.COVERED, True)]


def test_hooks(spark):
    def make_predict():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    rows = spark.createDataFrame([("ab", "abcd"), ("abc", "a")], "q string, d string")
    assert [r.v for r in rows.select(retrieval.embedder(make_predict, 1)("q").alias("v")).collect()] == [[2.0, 1.0], [3.0, 1.0]]
    score = retrieval.pair_scorer(lambda q, d: [len(x) - len(y) for x, y in zip(q, d, strict=True)])
    assert [r.s for r in rows.select(score("q", "d").alias("s")).collect()] == [-2.0, 2.0]

    claim = spark.createDataFrame([(["A00"], ["B00"], 5, None, False)], "given array<string>, written array<string>, given_amount int, institution string, abroad boolean")
    got = facts.assemble(claim, lambda c: c.withColumn("guessed", F.array(F.lit("A00"), F.lit("C00")))).first()
    assert (got.codes, got.weak_codes) == (["A00", "B00"], ["C00"])

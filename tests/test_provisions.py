"""Provisions, defined terms, receipts and answers of models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from indemna.functions import receipts
from indemna.operators import provisions

XML = (
    "<부칙공포일자>20260506</부칙공포일자><부칙공포번호>7</부칙공포번호><부칙내용 ><![CDATA[제1조(시행일) 이 세칙은 2026년 5월 6일부터 시행한다. "
    "제2조(적용례) ① 별표15. 표준약관(개인실손의료보험은 제외한다) 개정내용은 2026년 6월 6일부터 체결되는 보험계약부터 적용한다. "
    "② [별표 15] 생명보험 표준약관 제7조 및 별표 3의 개정사항은 2027. 1. 1.부터 적용한다.]]></부칙내용>"
    "<부칙공포일자>20200101</부칙공포일자><부칙공포번호>8</부칙공포번호><부칙내용><![CDATA[이 세칙은 공포한 날부터 시행한다.]]></부칙내용>"
)


def test_provisions(spark):
    rows = provisions.provisions(spark.createDataFrame([(XML,)], "value string")).collect()
    assert len(rows) == 1 and rows[0].promulgated_on == "20260506" and rows[0].new_contracts_only
    assert rows[0].candidate_dates == ["2026-06-06", "2027-01-01"] and rows[0].excluded == ["개인실손의료보험"]
    whole, part = rows[0].scopes
    assert (whole.applies_on, whole.new_contracts_only, whole.articles, whole.tables) == ("2026-06-06", True, [], [])
    assert (part.applies_on, part.new_contracts_only, part.articles, part.tables) == ("2027-01-01", False, ["7"], ["3"])
    assert "생명보험" in part.products


def test_version_scope(spark):
    df = provisions.provisions(spark.createDataFrame([(XML,)], "value string"))
    r = df.select(provisions.version_scope(F.col("scopes")).alias("v"), F.size(provisions.article_scopes(F.col("scopes"))).alias("n")).first()
    assert r.v.applies_on == "2026-06-06" and r.n == 1
    asked = df.crossJoin(spark.createDataFrame([("기본형 실손의료보험(급여)",), ("생명보험",)], "product string"))
    got = {x["product"]: x.c for x in asked.select("product", provisions.provision_covers(F.col("product")).alias("c")).collect()}
    assert got == {"기본형 실손의료보험(급여)": False, "생명보험": True}


def test_defined_terms(spark):
    rows = [
        ("용어의 정의", "가. 계약자: 회사와 계약을 체결한 사람\n나. 장해: <부표 3> 장해분류표에서 정한 기준\n다. 피보험자: 사람"),
        ("용어의 정의", "┃ 용어 │ 정의 ┃\n┃ 입원의료비 │ 비용 ┃\n┃ 비 │ 조각 ┃"),
        ("정의", "용어의 뜻은 <붙임 1>과 같습니다"),
        ("목적", "가. 아님: 정의 조문이 아니다"),
        ("정의", None),
    ]
    got = {tuple(r) for r in provisions.defined_terms(spark.createDataFrame(rows, "title string, text string")).collect()}
    assert got == {("계약자", "defined"), ("장해", "defined"), ("피보험자", "defined"), ("장해", "hollow"), ("입원의료비", "defined"), ("붙임1", "deferred")}


@pytest.mark.parametrize(("raw", "want"), [("종합 병원", ("종합병원", False)), ("의원급", ("의원", False)), ("병원", (None, True)), ("[ ]종합병원", (None, True)), ("[]", (None, False)), ("", (None, False)), (None, (None, False))])
def test_institution(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(receipts.institution(F.col("x")).alias("i")).first().i) == want


def test_mentions(spark):
    said = "상급종합병원이 아니라 종합 병원이고 내과의원, 국회의원은 아님. 본인부담률 60%, 환자부담 0.2 그리고 보상비율 80%, 본인부담금 13,500원"
    r = spark.createDataFrame([(said,)], "x string").select(receipts.institutions_in(F.col("x")).alias("i"), receipts.copay_rates_in(F.col("x")).alias("c")).first()
    assert r.i == ["상급종합병원", "의원", "종합병원"] and r.c == [0.6, 0.2]


def test_model_answers(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert tuple(one("s62.0, F20 and S62.0 maybe", receipts.model_codes)) == (["S62.0", "F20"], ["AND", "MAYBE"])
    assert tuple(one(" none ", receipts.model_codes)) == ([], [])
    assert one("1, 3, 9, 3", lambda x: receipts.model_choices(x, F.lit(4))) == [1, 3]
    tail = lambda codes, text: tuple(spark.createDataFrame([(codes, text)], "c array<string>, t string").select(receipts.split_tail(F.col("c"), F.col("t")).alias("y")).first().y)
    assert tail(["O10", "I10"], "임신 중") == (["O10"], ["I10"]) and tail(["S06", "I62"], "낙상") == ([], ["S06", "I62"]) and tail(["O10", "I10"], "고혈압") == (["I10"], ["O10"])

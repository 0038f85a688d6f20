"""Column functions and single operators against rows with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from indemna.functions import codes, money, text
from indemna.operators import adjudication as adj
from indemna.operators import dictionary, retrieval, structure, versions


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("정신질환(F04∼F99)", [("F", 4, 99, None)]),
        ("N39.3, N39.4 및 A00~A09", [("A", 0, 9, None), ("N", 39, 39, "3"), ("N", 39, 39, "4")]),
        ("A00-B99", [("A", 0, 0, None), ("B", 99, 99, None)]),
        ("없음", []),
    ],
)
def test_code_ranges(spark, said, want):
    assert [tuple(r) for r in one(spark, said, codes.code_ranges)] == want


@pytest.mark.parametrize(("code", "clause", "want"), [("N39.40", "N39.4", True), ("N39", "N39.4", False), ("F20", "F04∼F99", True), ("G20", "F04∼F99", False), ("F03.9", "F04~F99", False)])
def test_in_range(spark, code, clause, want):
    assert one(spark, clause, lambda c: F.exists(codes.code_ranges(c), lambda r: codes.in_range(F.lit(code), r))) is want


@pytest.mark.parametrize(("given", "want"), [(["S62.0"], "injury"), (["V87"], None), (["V87", "I10"], "disease"), ([], None), (["R51"], "disease")])
def test_coverage_kind(spark, given, want):
    assert one(spark, given, codes.coverage_kind, "array<string>") == want


def test_codes_in_text(spark):
    assert one(spark, "F20으로 s620 및 F20, XA123 A1", codes.codes_in) == ["F20", "S62.0"]
    assert tuple(one(spark, "S62.0 f20;F200", codes.codes_strict)) == (["S62.0", "F20", "F20.0"], [])
    assert tuple(one(spark, "S62.0, 골절", codes.codes_strict)) == ([], ["골절"])
    assert tuple(one(spark, " ", codes.codes_strict)) == ([], [])


def test_money(spark):
    assert one(spark, "작년에 300만원, 1,500,000원 그리고 2억 원과 999원, 제3조", money.amounts_in) == [3_000_000, 1_500_000, 200_000_000]
    row = spark.createDataFrame([(100000,)], "x long").select(money.trunc_double(F.col("x"), F.lit(0.29)), money.trunc_exact(F.col("x"), F.lit("0.29").cast("decimal(9,6)"))).first()
    assert tuple(row) == (28999, 29000)


def test_quotes(spark):
    quote = lambda limit: lambda c: text.prose_quote(c, limit)
    assert one(spark, "가  나\n다", quote(10)) == "가 나 다"
    assert one(spark, "", quote(10)) == ""
    assert one(spark, "회사는 다음 각 호의 어느 하나에 해당하는 때에는 보상한다 ┏━━┓ 표", quote(100)) == "회사는 다음 각 호의 어느 하나에 해당하는 때에는 보상한다 …(표)"
    assert one(spark, "짧다 ┏━━┓ 표", quote(100)) == "짧다 …(표)"
    assert one(spark, "0123456789", quote(4)) == "0123…"


def test_text(spark):
    assert one(spark, "지급 대상에 치과 병원에서", text.stemmed_tokens) == ["지급", "대상", "치과", "병원"]
    assert one(spark, "치과(K00, 다만, 골절은 보상)ㆍ한방(약)", text.without_provisos) == "치과 ㆍ한방(약)"
    masked = one(spark, "900101-1234567, 010-1234-5678", lambda c: text.mask(c, text.PERSONAL_KO))
    assert tuple(masked) == ("900101-*******, 010-****-5678", True)
    assert one(spark, "Ｆ２０​ ㄱ", text.clean) == "F20 ᄀ"
    assert str(one(spark, "2020.13.45 뒤 2021년 2월 3일", text.first_date)) == "2021-02-03"
    assert one(spark, "날짜 없음", text.first_date) is None
    assert [tuple(one(spark, x, text.valid_ratio, "double")) for x in (0.2, -1.0, 0.0, 1.5, float("nan"), None)] == [(0.2, False), (None, False), (None, True), (None, True), (None, True), (None, False)]


def test_split_lines(spark):
    said = "\n".join(["a" * 60, "b" * 50, "", "c" * 60, "d" * 500])
    got = one(spark, said, lambda c: structure.split_lines(c, 120, 50))
    assert got == ["a" * 60 + "\n" + "b" * 50, "b" * 50 + "\n" + "c" * 60, "c" * 60 + "\n" + "d" * 500]
    assert one(spark, " \n", structure.split_lines) == [] and one(spark, None, structure.split_lines) is None


def test_versions_before_the_first_are_null(spark):
    v = spark.createDataFrame([("2010", "2020", None, [], []), ("2020", "9999", "2021", ["p"], [])], "version string, effective_to string, applies_from string, included array<string>, excluded array<string>")
    facts = spark.createDataFrame([("p", "2009"), ("p", "2020"), ("p", "2021"), ("q", "2020")], "product string, day string")
    got = {(r["product"], r["day"]): r["version"] for r in versions.valid_for(facts, v, "product", "day").collect()}
    assert got == {("p", "2009"): None, ("p", "2020"): "2010", ("p", "2021"): "2020", ("q", "2020"): "2020"}


BASE = {
    "claim_id": "c", "product": "p", "coverage": "any", "claimed_amount": 100000, "days_since": 10, "inpatient": True, "institution": "clinic", "copay_rate": None, "room_charge": 0, "hospital_days": 0, "sum_insured": None,
    "paid_this_year": 0, "visits_this_year": 0, "self_paid_this_year": 0, "inpatient_rate": 0.8, "outpatient_rate": 1.0, "annual_limit": 1000000, "deductible": 10000, "deductible_rate": 0.2, "visit_limit": None, "deductible_tertiary": None,
    "uses_copay": False, "deductible_inpatient": False, "reduction_days": None, "reduction_rate": None, "annual_visits": None, "self_pay_cap": None, "room_rate": None, "room_daily_cap": None, "clinic_cap": None, "limit_from_policy": False,
}
KINDS = "claim_id string, product string, coverage string, claimed_amount long, days_since int, inpatient boolean, institution string, copay_rate double, room_charge long, hospital_days int, sum_insured long, paid_this_year long, visits_this_year int, self_paid_this_year long, inpatient_rate double, outpatient_rate double, annual_limit long, deductible long, deductible_rate double, visit_limit long, deductible_tertiary long, uses_copay boolean, deductible_inpatient boolean, reduction_days int, reduction_rate double, annual_visits int, self_pay_cap long, room_rate double, room_daily_cap long, clinic_cap long, limit_from_policy boolean"


@pytest.mark.parametrize(
    ("change", "payable", "missing", "down"),
    [
        ({}, 80000, [], []),
        ({"claimed_amount": 0}, 0, [], []),
        ({"coverage": None}, 0, [], []),
        ({"days_since": None}, 0, [], []),
        ({"inpatient": False}, 80000, [], []),
        ({"inpatient": False, "deductible_rate": 0.29}, 71000, [], []),
        ({"inpatient": False, "deductible_tertiary": 30000, "institution": "general hospital"}, 70000, [], []),
        ({"inpatient": False, "deductible_tertiary": 30000, "institution": None}, 80000, ["institution"], []),
        ({"inpatient": False, "uses_copay": True}, 80000, ["copay rate"], []),
        ({"inpatient": False, "uses_copay": True, "copay_rate": 0.5}, 50000, [], []),
        ({"inpatient": False, "visit_limit": 20000}, 20000, [], []),
        ({"inpatient": False, "deductible": None}, 0, [], []),
        ({"clinic_cap": 30000}, 30000, [], []),
        ({"clinic_cap": 30000, "institution": "tertiary hospital"}, 80000, [], []),
        ({"clinic_cap": 30000, "institution": "nursing home"}, 80000, ["general hospital or not"], []),
        ({"clinic_cap": 90000, "institution": "nursing home"}, 80000, [], []),
        ({"clinic_cap": 30000, "institution": None}, 80000, ["institution"], []),
        ({"room_charge": 50000, "room_rate": 0.5, "room_daily_cap": 10000, "hospital_days": 3}, 95000, [], []),
        ({"room_charge": 50000, "room_rate": 0.5, "room_daily_cap": 10000}, 85000, [], []),
        ({"reduction_days": 30, "reduction_rate": 0.5}, 40000, [], []),
        ({"reduction_days": 10, "reduction_rate": 0.5}, 80000, [], []),
        ({"inpatient": False, "annual_visits": 5, "visits_this_year": 5}, 0, [], []),
        ({"inpatient": False, "annual_visits": 5, "paid_this_year": None}, 80000, ["visits this year", "paid this year"], []),
        ({"self_pay_cap": 15000}, 85000, [], []),
        ({"self_pay_cap": 15000, "self_paid_this_year": 15000}, 100000, [], []),
        ({"self_pay_cap": 15000, "paid_this_year": None}, 80000, ["paid this year"], ["self-paid this year"]),
        ({"annual_limit": 90000, "paid_this_year": 60000}, 30000, [], []),
        ({"annual_limit": 90000, "paid_this_year": 99000}, 0, [], []),
        ({"annual_limit": None}, 0, [], []),
        ({"annual_limit": None, "limit_from_policy": True, "sum_insured": 50000}, 50000, [], []),
        ({"annual_limit": None, "limit_from_policy": True, "sum_insured": 0}, 80000, ["sum insured"], []),
    ],
)
def test_amounts(spark, change, payable, missing, down):
    row = BASE | change
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in KINDS.split(", "))], KINDS).withColumn("copay_rate", F.col("copay_rate").cast("decimal(9,6)")).withColumn("deductible_rate", F.col("deductible_rate").cast("decimal(9,6)"))
    got = adj.amounts(df).select("payable", "missing", "missing_down").first()
    assert (got.payable, got.missing, got.missing_down) == (payable, missing, down)


def test_guardrails_demote_once(spark):
    rows = spark.createDataFrame(
        [("PAID", 5, True, True, False, False, False, False), ("PAID", 5, False, False, True, True, True, True), ("DENIED", 0, False, True, True, True, True, False), ("PARTIAL", 5, True, True, False, False, True, False), ("NEEDS_DOCS", 0, False, False, True, True, True, False)],
        "decision string, amount long, grounded boolean, computed boolean, uncertain boolean, is_upper boolean, is_lower boolean, pii boolean",
    )
    got = [(r.decision, r.amount, r.fired) for r in adj.guardrails(rows).collect()]
    assert got == [("PAID", 5, []), ("NEEDS_DOCS", 0, ["pii_masked", "grounding_gate"]), ("NEEDS_DOCS", 0, ["grounding_gate"]), ("HUMAN_REVIEW", 0, ["amount_lower_bound"]), ("NEEDS_DOCS", 0, [])]


def test_fusion_keeps_first_seen_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, uid string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "x", 2)], "query_id int, uid string, rank int")
    assert [r.uid for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == ["x", "z", "y"]


def test_longer_keys_win(spark):
    keys = spark.createDataFrame([("ring",), ("red ring",), ("bolt",)], "key string")
    texts = spark.createDataFrame([(1, "A red ring."), (2, "ring, red"), (3, None), (4, "")], "id int, t string")
    assert {tuple(r) for r in dictionary.dictionary_match(texts, "id", "t", keys).collect()} == {(1, "red ring"), (2, "ring")}


def test_keys_of_any_words(spark):
    keys = spark.createDataFrame([("a b c d e f",), ("c d",), ("유착 방지",), (None,)], "key string")
    texts = spark.createDataFrame([(1, "x A b c-d e f"), (2, "a b, C d"), (3, "유착 방지 도포")], "id int, t string")
    assert {tuple(r) for r in dictionary.dictionary_match(texts, "id", "t", keys).collect()} == {(1, "a b c d e f"), (2, "c d"), (3, "유착 방지")}


def test_terms_of_a_dictionary(spark):
    keys = spark.createDataFrame([("비만",), ("치아우식",), ("자연유산",), ("유산",), ("복사의 골절",), ("골절",), ("장유착",), ("a(b",), ("",), (None,)], "key string")
    said = {
        1: "검사비만 청구", 2: "고도비만 수술", 3: "비만", 4: "충치 치료", 5: "세계자연유산 관광", 6: "자연 유산과 자연유산", 7: "유산소 운동", 8: "유산 소파술",
        9: "발목 골절", 10: "장유착방지제 도포", 11: "세계유산 관광 후 유산", 12: "xa(b", 13: "", 14: None, 15: "검사비만, 비만",
    }
    texts = spark.createDataFrame([*said.items(), (3, "비만")], "id int, t string")
    got = sorted(tuple(r) for r in dictionary.entity_match(texts, "id", "t", keys).collect())
    assert got == sorted(
        [(1, "비만", False), (2, "비만", True), (3, "비만", True), (3, "비만", True), (4, "치아우식", True), (5, "자연유산", False), (5, "유산", False), (6, "자연유산", True), (7, "유산", False), (8, "유산", True)]
        + [(9, "복사의 골절", True), (10, "장유착", False), (11, "유산", True), (12, "a(b", True), (15, "비만", True)]
    )


def test_codes_of_a_dictionary(spark):
    keys = spark.createDataFrame([("급성 편도염", "full", ["J03"]), ("출혈", "tail", ["O20", "R58"]), ("비만", "full", ["E66"])], "key string, kind string, categories array<string>")
    texts = spark.createDataFrame([(1, "급성 편도염, 검사비만"), (2, "임신 중 출혈"), (3, "출혈"), (4, "없음")], "id int, t string")
    got = {r.id: (r.codes, r.weak) for r in dictionary.dictionary_codes(texts, "id", "t", keys).collect()}
    assert got == {1: (["J03"], ["E66"]), 2: (["O20"], ["R58"]), 3: (["R58"], ["O20"])}


def test_strings_inside_texts(spark):
    texts = ["abcdefghij", "xabcdefghijy", "b", "😀c", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    got = sorted((r.part, r.whole) for r in dictionary.contained(rows, "t", rows, "t").collect())
    assert got == sorted((a, b) for a in texts for b in texts if a and b and a in b)


def test_gold_of_short_and_long_keywords(spark):
    asked = spark.createDataFrame([(1, "ab cd"), (2, "b cd ef gh ij kl m"), (3, "x"), (4, "q w e"), (5, ""), (6, None)], "query_id int, k string")
    rows = spark.createDataFrame([(1, "ab cd ef gh ij kl mn"), (2, "ab cde x"), (3, "aq w ef"), (4, None), (5, "")], "uid int, t string")
    assert sorted(tuple(r) for r in retrieval.resolve_gold(asked, rows, "k", "t").collect()) == [(1, 1), (1, 2), (2, 1), (3, 2), (4, 3)]

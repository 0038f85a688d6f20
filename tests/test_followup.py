"""Revisions of claims, what changed, and new facts in turns."""

from __future__ import annotations

from indemna.operators import followup, revision


def test_fold_changes(spark):
    rows = [("a", 0, 100, 0, "first", ["F20"]), ("a", 1, -1, -5, " \n ", []), ("a", 2, 0, 7, None, None), ("a", 3, None, 0, "second", ["F21"]), ("b", 5, -1, -1, None, None)]
    df = spark.createDataFrame(rows, "id string, at int, paid long, amount long, said string, codes array<string>").repartition(3)
    got = {(r.id, r.revision): (r.paid, r.amount, r.said, r.codes) for r in revision.fold_changes(df, "id", "at", {"paid": "count", "amount": "amount", "said": "text", "codes": "list"}).collect()}
    assert got == {("a", 0): (100, None, "first", ["F20"]), ("a", 1): (100, None, "first", ["F20"]), ("a", 2): (0, 7, "first", ["F20"]), ("a", 3): (0, 7, "second", ["F21"]), ("b", 0): (None, None, None, None)}


def test_held_items(spark):
    rows = [("a", 0, ["x"]), ("a", 1, []), ("a", 2, ["y"]), ("a", 3, ["x"]), ("b", 0, None), ("b", 1, None)]
    got = {(r.id, r.at): r.held for r in revision.hold_items(spark.createDataFrame(rows, "id string, at int, now array<string>"), "id", "at", "now").collect()}
    assert got == {("a", 0): [], ("a", 1): ["x"], ("a", 2): ["x"], ("a", 3): ["y"], ("b", 0): [], ("b", 1): []}


def test_verdict_changes(spark):
    rows = [("a", 0, "PAID", 5, []), ("a", 1, "PAID", 5, []), ("a", 2, "HUMAN_REVIEW", 0, ["p", "q"]), ("a", 3, "HUMAN_REVIEW", 0, ["q", "r"])]
    got = revision.verdict_changes(spark.createDataFrame(rows, "id string, at int, decision string, amount int, fired array<string>"), "id", "at").orderBy("at").collect()
    assert [r.changes for r in got] == [None, "", "decision PAID -> HUMAN_REVIEW / amount 5 -> 0 / came p, q", "gone p / came r"]


def test_as_it_stood(spark):
    turns = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 9, "z"), ("b", 1, "w")], "id string, at int, said string").repartition(2)
    stood = spark.createDataFrame([("a", 2, 10), ("a", 4, 20), ("a", 4, 20), ("c", 0, 5)], "id string, at int, v int")
    got = {(r.id, r.at): (r.said, r.claim and r.claim.v) for r in followup.as_it_stood(turns, stood, "id", "at").collect()}
    assert got == {("a", 1): ("x", None), ("a", 2): ("y", 10), ("a", 9): ("z", 20), ("b", 1): ("w", None)}


def test_new_facts(spark):
    severe = "실손의료보험 특별약관1(중증 비급여 실손의료비)"
    claim = (severe, 3_000_000, 0, None, 200_000, "차량가액 300만원인데 수리비 400만원을 청구", "도수치료", ["F20", "J20.9"], 3, "20200101", "20210304", "종합병원", False, 0.2)
    schema = "struct<product:string,claimed_amount:long,room_charge:long,paid_this_year:long,self_paid_this_year:long,narrative:string,treatment:string,codes:array<string>,hospital_days:int,enrolled_on:string,incident_on:string,institution:string,abroad:boolean,copay_rate:double>"
    abroad = (*claim[:11], "종합병원", True, None)
    want = {
        "300만원이라 했는데요": [], "수리비 4,000,000원": [], "500만원입니다": ["amount"], "올해 500만원을 이미 받았어요": ["paid this year"], "올해 20만원": [], "F20으로": [], "J20.9로 K35도": ["code"],
        "3일 입원": [], "10일간 입원했어요": ["days"], "2021년 3월 4일에": [], "2021.3.5": ["date"], "도수치료 맞아요": [], "MRI 찍었어요": ["treatment"], "급여 진료였어요": ["covered"], "비급여였어요": [],
        "상급종합병원이었어요": ["institution"], "종합 병원": [], "본인부담률 30%": ["copay"], "본인부담 20%": [], "왜요": [], "": [],
    }
    rows = [(t, claim) for t in want] + [(None, claim), ("500만원", None)]
    got = followup.new_facts(spark.createDataFrame(rows, f"text string, claim {schema}")).collect()
    assert {r.text: r.facts for r in got if r.text and r.claim} | {"": []} == want
    assert all(r.facts == [] for r in got if r.text is None or r.claim is None)
    told = followup.new_facts(spark.createDataFrame([("상급종합병원, 본인부담률 20%", abroad)], f"text string, claim {schema}")).first()
    assert told.facts == ["copay"]


def test_scores(spark):
    rows = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "c"], []), ([], [])], "gold array<string>, facts array<string>")
    assert {(r.fact, r.hit, r.missed, r.false) for r in followup.followup_scores(rows).collect()} == {("a", 1, 1, 0), ("b", 0, 0, 1), ("c", 0, 1, 0)}

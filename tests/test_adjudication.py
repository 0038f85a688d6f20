"""Verdicts: rules that may not be used, evidence by role, reasons, guardrails."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from indemna.functions import benefits
from indemna.operators import adjudication as adj
from indemna.plans.catalog import SQL
from indemna.plans.views import RULE_SCHEMA


@pytest.fixture(scope="module")
def rules(spark):
    row = lambda product, coverage, policy=False, abroad=False: (product, coverage, 0.8, 0.8, None if policy else 50000, 100, Decimal("0.1"), None, None, False, False, None, None, None, None, None, None, None, policy, abroad)
    return spark.createDataFrame([row("A", "injury"), row("A", "disease"), row("B", "any"), row("H", "overseas", True, True), row("H", "injury")], RULE_SCHEMA)


def claims(spark, rows):
    """(claim_id, product, abroad, kinds, kind, hint)"""
    return spark.createDataFrame(rows, "claim_id string, product string, abroad boolean, kinds array<string>, kind string, hint string")


def test_why_no_rule(spark, rules):
    rows = [("1", "A", True, ["injury"], "injury", None), ("2", "A", None, ["injury", "disease"], "injury", None), ("3", "H", False, ["injury", "disease"], "injury", None), ("4", "H", True, ["injury"], "injury", None), ("5", "B", False, [], None, None), ("6", "X", True, [], None, None)]
    carved = spark.createDataFrame([("5", "MRI", "MRI", "part 3", False), ("5", "MRI", "엠알아이", "part 3", False), ("5", "주사료", "주사", "제4조", True), ("1", "MRI", "MRI", "part 3", False)], "claim_id string, item string, word string, place string, excluded boolean")
    got = {r.claim_id: r for r in adj.rule_lookup(adj.why_no_rule(claims(spark, rows), rules, carved), rules).collect()}
    assert {i: r.no_rule for i, r in got.items()} == {"1": "treated abroad", "2": None, "3": "injury and disease together", "4": None, "5": "MRI: dealt with in part 3; 주사료: not covered by 제4조", "6": None}
    assert {i: r.coverage for i, r in got.items()} == {"1": None, "2": "injury", "3": None, "4": "overseas", "5": None, "6": None}


def test_hints(spark, rules):
    rows = [("1", "A", False, [], "injury", "disease"), ("2", "A", False, [], "injury", "3"), ("3", "B", False, [], None, "3"), ("4", "A", False, [], None, None)]
    assert {r.claim_id: r.coverage for r in adj.rule_lookup(claims(spark, rows), rules).collect()} == {"1": "disease", "2": "injury", "3": "any", "4": None}


def test_evidence(spark):
    hits = [("a", f"x{i}", True) for i in range(4)] + [("a", "w0", False), ("b", "x0", False), ("b", "x1", False), ("b", "x2", False)] + [("c", f"y{i:02}", True) for i in range(50)]
    hits = spark.createDataFrame(hits, "claim_id string, clause_uid string, certain boolean")
    covers = spark.createDataFrame([(f"c{i}", "P", "V") for i in range(5)] + [("", "Q", "V")], "article_uid string, product string, version string")
    exceptions = spark.createDataFrame([("x0", "e2"), ("x1", "e1"), ("x1", "e2"), ("x2", "e9"), ("y00", "e0")], "clause_uid string, exception_uid string")
    found, cover = adj.evidence_rows(hits, covers, exceptions)
    plain = lambda e: [f"{x.role[:2]}:{x.uid}" for x in e]
    assert {r.claim_id: plain(r.evidence) for r in found.collect()} == {
        "a": ["ex:x0", "ex:x1", "ex:x2", "ex:x3", "ex:e2", "ex:e1"],
        "b": ["un:x0", "un:x1", "ex:e2", "ex:e1"],
        "c": [f"ex:y{i:02}" for i in range(6)],
    }
    assert {r["product"]: plain(r.evidence) for r in cover.collect()} == {"P": ["co:c0", "co:c1"], "Q": ["co:"]}


def test_reasons_of_guardrails(spark):
    rows = [("1", "PAID", 5, False, True, False, False, False, False, "b", [], []), ("2", "PAID", 5, True, False, True, True, True, True, "why", ["x"], []), ("3", "DENIED", 0, True, True, False, False, False, False, "e", [], []), ("4", "PARTIAL", 5, True, True, False, True, False, False, "b", ["x", "y"], []), ("5", "PARTIAL", 5, True, True, False, False, True, False, "b", [], ["z"])]
    drafts = spark.createDataFrame(rows, "id string, decision string, amount long, grounded boolean, computed boolean, uncertain boolean, is_upper boolean, is_lower boolean, pii boolean, reason string, missing array<string>, missing_down array<string>")
    got = {r.id: (r.decision, r.amount, r.fired, r.reason) for r in adj.guardrails(drafts).collect()}
    assert got == {
        "1": ("NEEDS_DOCS", 0, ["grounding_gate"], "no clause to point at"),
        "2": ("HUMAN_REVIEW", 0, ["pii_masked", "amount_not_computed"], "amount not computed: why"),
        "3": ("DENIED", 0, [], "e"),
        "4": ("HUMAN_REVIEW", 0, ["amount_upper_bound"], "an upper bound without x, y"),
        "5": ("HUMAN_REVIEW", 0, ["amount_lower_bound"], "a lower bound without z"),
    }


def test_answer_material(spark):
    e = [("exclusion", "x"), ("uncertain", "y"), ("exclusion", "z"), ("exclusion", "w"), ("exception", "e"), ("coverage", "c")]
    rows = spark.createDataFrame([("1", "DENIED", ["pii_masked"], "r", e), ("2", "PAID", [], "b", [])], "claim_id string, decision string, fired array<string>, reason string, evidence array<struct<role:string,uid:string>>")
    got = {r.claim_id: r for r in adj.answer_material(rows).collect()}
    assert (got["1"].clauses, got["1"].coverages, got["1"].exceptions, got["1"].missing) == (["x", "y", "z"], ["c"], ["e"], "r; guardrails: pii_masked")
    assert got["2"].clauses == [] and got["2"].missing is None


def test_screen_by_words_and_codes(spark):
    clauses = spark.createDataFrame([("c1", "P", "V", "steel anvil (unless small bolt is meant)"), ("c2", "P", "V", "Mental disorders (F05~F09)"), ("c3", "Q", "V", "steel")], "clause_uid string, product string, version string, content string")
    rows = [("1", "P", "V", ["F07"], [], "a STEEL anvils"), ("2", "P", "V", [], ["F07"], "small bolt"), ("3", "P", "V", [], [], None), ("4", "Z", "V", ["F07"], [], "steel"), ("5", "P", "V", [], [], "x" * 50_000 + "anvil"), ("6", None, None, ["F07"], [], "steel")]
    df = spark.createDataFrame(rows, "claim_id string, product string, version string, codes array<string>, weak_codes array<string>, narrative string")
    assert {(r.claim_id, r.clause_uid, r.via) for r in adj.screen(df, clauses).collect()} == {("1", "c1", "word"), ("1", "c2", "code"), ("2", "c2", "weak"), ("5", "c1", "word")}
    assert {(r.claim_id, r.clause_uid): r.word for r in adj.word_overlap(df, clauses, ["product", "version"]).collect()} == {("1", "c1"): "anvil", ("5", "c1"): "anvil"}


def test_texts_of_the_views(spark):
    """What the views' claims say of treatments, as the SQL writes it by hand."""
    from indemna.plans.views import TREATMENTS

    told = benefits.treatment_items(spark.createDataFrame([(t,) for t in TREATMENTS], "t string"), "t").collect()
    assert {r.t: [x["item"] for x in r["items"]] for r in told if r["items"]} == {
        "도수치료 3회": ["근골격계 이학요법ㆍ체외충격파치료"],
        "어깨 MRI 촬영": ["자기공명영상진단"],
        "비급여 진료": ["비급여"],
        "비타민 주사": ["주사료"],
        "급여 진료비와 도수치료": ["근골격계 이학요법ㆍ체외충격파치료", "급여"],
        "급여 진료": ["급여"],
    }


def test_every_guardrail_fires():
    con = duckdb.connect()
    for t in "lineitem orders customer part".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    fired = {f for (x,) in con.sql(f"select distinct fired from ({SQL['verdict_counts']})").fetchall() for f in x.split(",") if f}
    assert fired == {"pii_masked", "grounding_gate", "amount_not_computed", "uncertain_exclusion", "amount_upper_bound", "amount_lower_bound"}

"""Work that must not grow with rows that say the same, or with pairs of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from indemna.functions import benefits
from indemna.operators import retrieval, terms


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_notes_meet_contracts_by_equality(spark):
    notes = spark.createDataFrame([("v", ["a보험"], "1", "n1"), ("v", [], "2", "n2"), ("v", ["b"], "3", "n3"), ("w", [], "1", "n4")], "version string, products array<string>, article string, note string")
    contracts = spark.createDataFrame([(1, "v", "A"), (2, "v", "A"), (3, "w", "b")], "contract long, version string, product string")
    found = terms.scoped_notes(notes, contracts)
    assert sorted((r["contract"], r["note"]) for r in found.collect()) == [(1, "n1"), (1, "n2"), (2, "n1"), (2, "n2"), (3, "n4")]
    # Names are compared below a distinct, and notes are joined on their products as well.
    joins = [line for line in plan(found).splitlines() if "Join Inner" in line]
    assert any("products" in line for line in joins)


def test_equal_texts_are_read_once(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") % 3 == 0, "도수치료 3회").when(F.col("id") % 3 == 1, "수술").alias("said"))
    told = benefits.told_treatments(rows, "said")
    assert "Aggregate [said" in plan(told.select("items"))
    want = {r["id"]: r["items"] for r in benefits.treatment_items(rows, "said").collect()}
    got = {r["id"]: r["items"] for r in told.collect()}
    assert got == want and len(got) == 40


def test_best_of_groups_scores_every_pair_of_a_group(spark):
    rows = spark.createDataFrame([(1, "a", "red fox runs"), (2, "a", None), (3, "b", "red fox"), (4, "a", "blue sea"), (5, None, "red fox")], "uid long, product string, text string")
    asked = spark.createDataFrame([("q", "a"), ("r", "a"), ("r", "b")], "query_id string, product string")
    questions = spark.createDataFrame([("q", "red fox"), ("r", "sea fox"), ("s", "red")], "query_id string, question string")
    found = retrieval.best_of_groups(asked, questions, "question", rows, "text", "product", 2)
    got = sorted((r["query_id"], r["uid"], round(r["score"], 6), r["rank"]) for r in found.collect())
    assert got == [("q", 1, 0.666667, 1), ("q", 2, 0.0, 2), ("r", 3, 0.333333, 1), ("r", 4, 0.333333, 2)]


def test_expand_keeps_each_row_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (5, None), (6, "c")], "uid long, product string")
    hits = spark.createDataFrame([("q", 1, 1), ("q", 4, 2), ("q", 5, 3), ("q", 9, 4), ("r", 6, 1)], "query_id string, uid long, rank int")
    found = retrieval.expand(hits, rows, "product")
    assert sorted((r["query_id"], r["uid"], r["rank"], r["seed"]) for r in found.collect()) == [
        ("q", 1, 1, True), ("q", 2, None, False), ("q", 3, None, False), ("q", 4, 2, True), ("q", 5, 3, True), ("q", 9, 4, True), ("r", 6, 1, True),
    ]


def test_postings_are_scored_without_a_shuffle_of_their_terms(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "fox")], "uid long, text string")
    queries = spark.createDataFrame([("q", "red"), ("q", "fox")], "query_id string, term string")
    found = retrieval.lexical_search(queries, retrieval.terms(docs, "uid", "text"), 5)
    assert sorted((r["uid"], r["score"], r["rank"]) for r in found.collect()) == [(1, 3, 1), (2, 1, 2)]
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in physical and "hashpartitioning(uid#" in physical


def test_verdicts_shuffle_no_claim_for_terms_and_rules(spark):
    from indemna.plans import claim_queries
    from indemna.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    shown = plan(claim_queries.verdicts(t))
    # Claims come of three joins, each once; all that is joined to them later is made of terms and rules.
    assert shown.count("p_name#") > 0 and shown.count("l_orderkey#") > 0
    assert sum("lineitem" in line or "l_partkey" in line and "Relation" in line for line in shown.splitlines()) == 1
    assert not any("Aggregate [claim_id" in line or "windowspecdefinition(claim_id" in line for line in shown.splitlines())


def test_clauses_met_in_one_row(spark):
    from indemna.operators import adjudication as adj

    clauses = spark.createDataFrame([("c2", "P", "V", "Mental disorders (F05~F09)"), ("c1", "P", "V", "steel anvil, F07"), ("c1", "P", "V", "wood"), ("c3", "P", "V", "건강검진")], "clause_uid string, product string, version string, content string")
    exceptions = spark.createDataFrame([("c1", "e2"), ("c1", "e1"), ("c2", "e1")], "clause_uid string, exception_uid string")
    rows = [("1", "P", "V", ["F07"], [], "WOOD"), ("2", "P", "V", [], ["F07.1"], None), ("3", "P", "V", ["F7"], ["Z05"], "wood"), ("4", "Q", "V", ["F07"], [], "steel"), ("5", "P", None, None, None, "steel")]
    df = spark.createDataFrame(rows, "claim_id string, product string, version string, codes array<string>, weak_codes array<string>, narrative string")
    met = adj.with_clauses_met(df, clauses, exceptions=exceptions)
    assert {r.claim_id: [(m.clause_uid, m.way) for m in r.met] for r in met.collect()} == {"1": [("c1", 0), ("c2", 0)], "2": [("c1", 1), ("c2", 1)], "3": [("c1", 3), ("c3", 2)], "4": [], "5": []}
    told = met.withColumn("evidence", adj.evidence_met("met"))
    assert {r.claim_id: [f"{e.role[:2]}:{e.uid}" for e in r.evidence] for r in told.collect()} == {"1": ["ex:c1", "ex:c2", "ex:e1", "ex:e2"], "2": ["un:c1", "un:c2", "ex:e1", "ex:e2"], "3": ["un:c1", "un:c3", "ex:e1", "ex:e2"], "4": [], "5": []}


def test_changes_of_one_row_stand_as_folded(spark):
    from indemna.operators import revision

    kinds = {"paid": "count", "stated": "amount", "said": "text"}
    rows = [("a", 0, -1, 0, " x "), ("a", 1, 5, 0, " "), ("a", 2, -1, 7, "y"), ("a", 3, 0, 0, "x"), ("b", 0, None, None, None)]
    df = spark.createDataFrame(rows, "id string, at int, paid int, stated int, said string")
    want = {(r.id, r.revision): (r.paid, r.stated, r.said) for r in revision.fold_changes(df, "id", "at", kinds).collect()}
    one = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "paid", "stated", "said"))).alias("changes"))
    got = one.select("id", F.explode(revision.folded_changes(F.col("changes"), kinds, "said")).alias("c")).collect()
    assert {(r.id, r.c.revision): (r.c.paid, r.c.stated, r.c.said) for r in got} == want
    assert {(r.id, r.c.revision): r.c.so_far for r in got} == {("a", 0): ["x"], ("a", 1): ["x"], ("a", 2): ["x", "y"], ("a", 3): ["x", "y"], ("b", 0): []}


def test_headings_are_matched_once_and_walked_by_bracket(spark):
    lines = ["제 1조(가(나) 다) 라 [마)", "제2조의3 [가(나] 다", "제3조(가 (나)", "제4조() ", "제5조 (" + "가(나) " * 5000 + ") 끝 <개정 2015. 3. 3.>", "가 제6조(나)", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    found = df.select("i", terms.article_head(F.col("line")).alias("h"))
    # The text behind the number is taken from a line once, not for each use or character.
    assert plan(found).count("(.*)$") == 1
    got = {r.i: r.h and tuple(r.h) for r in found.collect()}
    assert got == {0: ("1", "가(나) 다", "라 [마)"), 1: ("2의3", "가(나", "다"), 2: None, 3: ("4", "", ""), 4: ("5", ("가(나) " * 5000).strip(), "끝 <개정 2015. 3. 3.>"), 5: None, 6: None}


def test_lines_of_marks_are_walked_once(spark):
    from indemna.operators import pages

    df = spark.createDataFrame([(1, 0, "제1조(가", 1, False), (1, 1, "나 (다) 라", 1, False), (1, 2, ")) ((", 2, False), (1, 3, "마", 2, False)], "d int, i int, line string, page int, boxed boolean")
    found = pages.rejoined_lines(df, "d", "i", "line", "page", "boxed")
    assert plan(found).count("[^\\(\\)]+") <= 2
    assert sorted((r.i, r.line, r.page) for r in found.collect()) == [(0, "제1조(가 나 (다) 라 )) ((", 1), (3, "마", 2)]


def test_beginnings_and_endings_of_words_are_not_shuffled(spark):
    from indemna.operators import fusion

    corpus = spark.createDataFrame([("wordily said twice said",), ("said twice\nsaid twice",)], "text string")
    pairs = spark.createDataFrame([("word", "ily"), ("said", "twice"), ("aid", "twi"), ("wordil", "y"), ("q", "x")], "left string, right string")
    found = fusion.fusion_evidence(pairs, corpus)
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(kl" not in physical and "hashpartitioning(end" in physical and "hashpartitioning(deal" in physical
    assert {(r.left, r.right): r.fused for r in found.collect()} == {("word", "ily"): True, ("said", "twice"): False, ("aid", "twi"): False, ("wordil", "y"): True, ("q", "x"): False}


def test_search_shuffles_its_sides_only(spark, monkeypatch):
    from indemna.operators import graph
    from indemna.plans.catalog import QUERIES

    monkeypatch.setattr(graph, "_ARTICLES", 2)
    monkeypatch.setattr(graph, "_QUERIES", 3)
    monkeypatch.setattr(graph, "_RUN", 2)
    asked = spark.createDataFrame([(i, "v" if i % 3 else "w", "a" if i % 2 else "b") for i in range(10)] + [(1, "v", "a"), (10, "v", None), (11, "x", "a")], "query_id long, version string, product string")
    articles = spark.createDataFrame([("v", "a", "1", 3), ("v", "a", "2", 0), ("v", "a", "3", None), ("w", "b", "4", 1), ("w", "b", "4", 1), ("v", "b", "5", 2), ("v", None, "6", 1), ("v", "a", "7", -1)], "version string, product string, article_uid string, n_items int")
    found = graph.search_items(asked, articles)
    want = [(q.query_id, f"{a.article_uid}#{i}") for q in asked.collect() for a in articles.collect() if a.product and (q.version, q.product) == (a.version, a.product) for i in range(1, (a.n_items or 0) + 1)]
    assert sorted((r.query_id, r.item_uid) for r in found.collect()) == sorted(want) and len(want) > 20
    # Five rows of queries and four columns of articles, each cell a task.
    assert found.rdd.getNumPartitions() == 20
    physical = QUERIES["graph_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in physical and physical.count("shufflepartitionidpassthrough") == 2


def test_editions_go_to_the_facts(spark):
    from indemna.operators import versions

    facts, editions = spark.createDataFrame([("1", "05"), ("2", "30"), ("3", "00")], "id string, day string"), spark.createDataFrame([("01", "10"), ("10", "99")], "version string, effective_to string")
    found = versions.valid_on(facts, editions, "day")
    assert "BroadcastNestedLoopJoin BuildRight" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("1", "05", "01"), ("2", "30", "10")]


def test_expansion_is_dealt_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_PAIRS", 12)
    monkeypatch.setattr(retrieval, "_QUERIES", 3)
    monkeypatch.setattr(retrieval, "_RUN", 2)
    rows = [(i, "ab"[i % 2]) for i in range(20)] + [(20, "a"), (20, "b"), (21, None)]
    hits = [(q, (3 * q + j) % 22, j + 1) for q in range(7) for j in range(3)] + [(0, 0, 9)]
    found = retrieval.expand(spark.createDataFrame(hits, "query_id int, uid int, rank int"), spark.createDataFrame(rows, "uid int, product string"), "product")
    # Three rows of queries and five columns of rows: before, all pairs were made in as few tasks as their small sides took.
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("shufflepartitionidpassthrough") == 2 and ", 15)" in physical
    want = {}
    for q in range(7):
        seeds = {u: min(r for x, v, r in hits if (x, v) == (q, u)) for x, u, _ in hits if x == q}
        reached = {g for u, g in rows if u in seeds and g}
        want |= {(q, u): seeds.get(u) for u in {u for u, g in rows if g in reached} | set(seeds)}
    assert {(r.query_id, r.uid): r["rank"] for r in found.collect()} == want and found.count() == len(want)


def test_words_at_a_stop_are_dealt_by_more_than_it(spark):
    from indemna.operators import fusion

    texts = ["He sat. Eve ran. It rained. a b c, 1 2", "x. E y. Ea", "a. E\nat. Ev", None, ""]
    corpus = spark.createDataFrame([(x,) for x in texts], "text string")
    probes = [(l, r) for l in ("t.", "n.", ".", "x.", "b", "a", "1", "sat.", "He sat.", "z") for r in ("E", "Ev", "Eve", "It", "c", "c,", "b", "2", "y", "Ea", "Eva")]
    found = fusion._apart(spark.createDataFrame(probes, "l string, r string"), corpus, "text")
    shown = plan(found)
    # Only words at characters that are asked for are dealt; these are the two next to the blank, not a stop and a capital alone.
    assert "Join LeftSemi" in shown and "RepartitionByExpression [end#" in shown
    pairs = {(a, b) for x in texts if x for line in x.split("\n") for a, b in zip(line.split(" "), line.split(" ")[1:])}
    want = {(l, r) for l, r in probes if any(a.endswith(l) and b.startswith(r) for a, b in pairs)}
    assert {(x.l, x.r) for x in found.collect()} == want and {(".", "E"), ("t.", "Ev"), ("a", "b"), ("1", "2")} < want

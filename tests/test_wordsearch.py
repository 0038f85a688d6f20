"""Searches by words in one reading of the texts, and groups that are counted instead of listed."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from indemna.operators import retrieval, wordsearch

TEXTS = [(1, "a", "Red fox red"), (2, "a", None), (3, "b", "red fox"), (4, "a", "blue sea, sea"), (5, None, "red fox"), (6, "b", "fox"), (6, "a", "sea fox"), (None, "b", "red")]
QUESTIONS = {"q": "red fox", "r": "sea fox", "s": "none such"}


def frames(spark):
    docs = spark.createDataFrame(TEXTS, "uid long, product string, text string")
    questions = spark.createDataFrame([(q, w) for q, t in QUESTIONS.items() for w in t.split()], "query_id string, term string")
    return docs, questions, retrieval.lexical_forms(questions, strategies=("lexical",))


def said(text):
    return re.findall("[a-z]{2,}", (text or "").lower())


def test_words_of_a_uid_count_together_and_once(spark):
    docs, questions, forms = frames(spark)
    rows = wordsearch.by_uid(docs, "product")
    got = {(r.strategy, r.query_id, r.uid, r.score, r["rank"]) for r in wordsearch.word_search(rows, "product", forms, 2).collect()}
    want = set()
    for q, t in QUESTIONS.items():
        score = Counter()
        for uid, _, text in TEXTS:
            score[uid] += sum(w in t.split() for w in said(text))
        best = sorted((-n, uid is None, uid or 0, uid) for uid, n in score.items() if n)[:2]
        want |= {("lexical", q, uid, -n, i) for i, (n, _, _, uid) in enumerate(best, 1)}
    assert got == want and len(got) == 4
    df = {r.term: r.df for r in wordsearch.text_frequency(rows).collect()}
    assert df == Counter(w for uid in {x[0] for x in TEXTS} for w in {w for i, _, t in TEXTS if i == uid for w in said(t)})


def test_shared_words_score_every_row_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(wordsearch, "_PIECE", 2)
    docs, questions, forms = frames(spark)
    asked = spark.createDataFrame([("q", "a"), ("r", "a"), ("r", "b"), ("s", "b"), ("s", None)], "query_id string, product string")
    # Texts without any shared word are in the group too.
    found = wordsearch.word_search(wordsearch.by_uid(docs.where("uid < 6"), "product"), "product", forms.limit(0), 2, questions, asked, "graph")
    by_questions = spark.createDataFrame(list(QUESTIONS.items()), "query_id string, question string")
    want = retrieval.best_of_groups(asked, by_questions, "question", docs.where("uid < 6"), "text", "product", 2).collect()
    assert {(r.query_id, r.uid, round(r.score, 8), r["rank"]) for r in found.collect()} == {(r.query_id, r.uid, round(r.score, 8), r["rank"]) for r in want} and len(want) == 5


def test_groups_are_counted_and_not_listed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (5, None), (6, "c")], "uid long, product string")
    asked = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "b"), ("s", None), ("t", "d")], "query_id string, product string")
    gold = spark.createDataFrame([("q", 3), ("q", 6), ("q", 5), ("r", 4), ("r", 1), ("s", 1)], "query_id string, uid long")
    got = {(r.query_id, r.found, r.candidates) for r in retrieval.of_groups(asked, rows, "product", gold).collect()}
    assert got == {("q", 1, 4), ("r", 1, 2)}
    counted = retrieval.of_groups(asked, rows, "product", gold).withColumn("strategy", F.lit("graph"))
    hits = spark.createDataFrame([("graph", "q", 5), ("vector", "q", 6)], "strategy string, query_id string, uid long")
    told = {(r.strategy, r.query_id): (r.found, r.gold, r.candidates) for r in retrieval.recall_by_question(hits, gold, ("graph", "vector"), counted).collect()}
    assert told[("graph", "q")] == (2, 3, 5) and told[("vector", "q")] == (1, 3, 1) and told[("graph", "s")] == (0, 1, 0) and len(told) == 6


def test_few_queries_copy_no_chunk(spark):
    chunks = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], "uid long, v array<double>")
    queries = spark.createDataFrame([("a", [1.0, 2.0, 0.5]), ("b", [0.0, 1.0, 3.0])], "query_id string, qv array<double>")
    told = lambda side: sorted(map(tuple, retrieval.vector_search(queries, chunks, 5, side=side).collect()))
    assert told(1) == told(None) and len(told(1)) == 10
    assert "explode(sequence(0, 0" in retrieval.vector_search(queries, chunks, 5, side=1)._jdf.queryExecution().analyzed().toString()


def test_sweep_pairs_no_question_with_a_product(spark):
    from indemna.plans import retrieval_queries as plans
    from indemna.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    hits, gold, counted = plans.swept(t)
    # Before, every question was listed with every document of its products.
    assert hits.where("strategy = 'graph'").count() == 0 and hits.count() <= 40 * 10 * len(plans.STRATEGIES)
    assert counted.agg(F.sum("candidates")).first()[0] > hits.count()

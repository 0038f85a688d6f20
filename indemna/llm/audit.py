"""Audit of how filters interact: who removes what, in every order of the filters."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space between words.
_WHITE = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails each filter that sees this text alone: too short (A), too few distinct
    words (B), too many capitals (C), an odd mark (D). A null text counts as empty; an empty one fails A alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, _WHITE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def document_failures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, A to E) of every row of ``docs`` (doc_id, text), and its ``keep`` columns: what the row fails. E: its text
    is that of a smaller doc_id.

    Rows that repeat a doc_id are rows of their own, none smaller than the other. A null doc_id is no smaller than any and has
    no smaller one, so its row never fails E. Null texts count as empty, so all but the first of these fail E. Texts stay
    where they are read: two 64-bit hashes stand for each. A copy is told from the first of its group by a join on the hashes
    *and* the doc_id, so that the copies of one text, however many, are spread by their ids.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(0), text).alias("h2"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()], *keep)
    firsts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(firsts, ["h1", "h2", "doc_id"], "left")
    return rows.select("doc_id", "A", "B", "C", "D", (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"), *keep)


def filter_interactions(rows: DataFrame, part: Column, fails: Mapping[str, Column], lost: Mapping[str, Column] | None = None, orders: Iterable[Iterable[str]] | None = None) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, one count for each of ``lost``, shapley):
    what each filter does at each step of each order, zeros included, for every part of ``rows``.

    ``fails`` has a condition for each filter, ``lost`` conditions of which removed rows are counted; null counts as
    false. ``orders`` are orders of all filters, by default all; with K filters these are K! orders of K steps, and so many rows a part.
    kept: rows left after the step. removed: by it. redundant: failing its filter but removed before. unique_fails:
    failing its filter only. shapley: the rows that its filter removes, summed over the orders. A null part is the empty string.
    Without rows there are no parts and so no results.

    Rows are added up by (part, what they fail) first, 2**K masks a part at most. A mask is a row of costs, 0 for a filter that
    is failed and more than K for one that isn't; an order is inverted to a row of places. The least sum of cost and place,
    the min-plus product of both matrices, is the step that removes all rows of the mask, and more than K if none does.
    """
    names, lost = list(fails), dict(lost or {})
    k = len(names)
    orders = [list(o) for o in (permutations(names) if orders is None else orders)]
    places = [{"filter_order": "".join(o), "places": [o.index(f) + 1 for f in names]} for o in orders]
    true = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.array(*[true(c) for c in fails.values()]).alias("failed"), *[true(c).cast("long").alias(f"w{i}") for i, c in enumerate(lost.values())])
    masks = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(lost))])
    masks = masks.withColumn("cost", F.transform("failed", lambda x: F.when(x, 0).otherwise(k + 1))).withColumn("n_failed", F.size(F.filter("failed", lambda x: x)))

    every = F.from_json(F.lit(json.dumps(places)), "array<struct<filter_order: string, places: array<int>>>")
    ranks = masks.withColumn("o", F.explode(every)).select("*", "o.*").withColumn("rank", F.array_min(F.zip_with("cost", "places", lambda c, p: c + p)))
    steps = ranks.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("at", F.array_position("places", F.col("step")).cast("int"))
    steps = steps.withColumn("fails_it", F.element_at("failed", F.col("at")))
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0))
    removed = F.col("rank") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step", F.element_at(F.lit(names), F.col("at")).alias("filter")).agg(
        total(F.col("rank") > F.col("step")).alias("kept"),
        total(removed).alias("removed"),
        total(F.col("fails_it") & (F.col("rank") < F.col("step"))).alias("redundant"),
        total(F.col("fails_it") & (F.col("n_failed") == 1)).alias("unique_fails"),
        *[total(removed, f"w{i}").alias(c) for i, c in enumerate(lost)],
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))

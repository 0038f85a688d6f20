"""Retrieval over whole query tables: vectors, words, fusion, expansion, reranking and recall."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType
from pyspark.sql.window import Window

from indemna.operators.dictionary import contained
from indemna.operators.nearest import nearest

#: Distinct first words of keywords that texts are looked through for; with more of them every word is a beginning.
_FIRSTS = 10_000
#: Pairs of a query and a row that a cell of a grid may have, queries of its rows, and queries of one array.
_PAIRS, _QUERIES, _RUN = 1 << 25, 100_000, 504


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def top_k(scored: DataFrame, k: int, by: str = "query_id", uid: str = "uid") -> DataFrame:
    """Adds ``rank`` and keeps the first ``k`` of each query; equal scores rank by uid."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), uid))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int, on: list[str] | None = None, digits: int = 9, side: int | None = None) -> DataFrame:
    """(query_id, uid, score, rank): exact cosine search. ``queries`` has query_id, qv and the columns ``on``, such as
    version or product, which are compared before the limit; ``chunks`` has uid, v and the same columns. See ``nearest``."""
    return nearest(queries, chunks, k, on or [], digits=digits, side=side).select("query_id", "uid", "score", "rank")


def for_principals(best: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """(principal, query_id, uid, product, score, rank): the ``k`` best of what each principal may see (principal, product), from the
    ``k`` best of each product (query_id, product, uid, score), of which these are always some. No search is done twice, however many principals ask."""
    rank = F.row_number().over(Window.partitionBy("principal", "query_id").orderBy(F.desc("score"), "uid"))
    rows = best.select("query_id", "product", "uid", "score").join(allowed.select("principal", "product").distinct(), "product")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def terms(docs: DataFrame, uid: str, text: str, pattern: str = "[a-z]{2,}") -> DataFrame:
    """(uid, term, tf): the postings of lower-cased words. Texts are dealt out by uid and counted there, so that what is counted
    by uid afterwards needs no further shuffle."""
    dealt = docs.select(F.col(uid).alias("uid"), F.col(text).alias("text")).repartition("uid")
    words = dealt.select("uid", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term"))
    return words.groupBy("uid", "term").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame, *by: str) -> DataFrame:
    """(by, term, df)"""
    return postings.groupBy(*by, "term").agg(F.count("*").alias("df"))


def distinctive(df: DataFrame, sizes: DataFrame, share: float, *by: str) -> DataFrame:
    """Terms of at most the given share of the documents (of their group), one at least."""
    limit = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * share))
    rows = df.join(sizes, list(by)) if by else df.crossJoin(sizes)
    return rows.where(F.col("df") <= limit).select(*by, "term", "df")


def prefix_frequency(df: DataFrame, prefixes: DataFrame, least: int = 2) -> DataFrame:
    """(prefix, n): the sum of document frequencies of all terms that begin with a prefix."""
    cut = df.select("df", F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("term"))), lambda i: F.substring("term", F.lit(1), i))).alias("prefix"), F.length("term").alias("n_chars"))
    return cut.where(F.length("prefix") <= F.col("n_chars")).join(prefixes, "prefix", "left_semi").groupBy("prefix").agg(F.sum("df").alias("n"))


def prefix_forms(stems: DataFrame, vocabulary: DataFrame, least: int = 2) -> DataFrame:
    """(stem, term, df): the terms of ``vocabulary`` (term, df) that begin with each of ``stems`` (stem); stems shorter than
    ``least`` stand for themselves only. Every term is listed under its beginnings once, and stems meet these by equality."""
    size = F.length("term")
    starts = F.transform(F.sequence(F.lit(least), size), lambda n: F.substring("term", F.lit(1), n))
    listed = vocabulary.select("term", "df", F.explode(F.when(size >= least, starts).otherwise(F.array("term"))).alias("stem"))
    return stems.select("stem").distinct().join(listed, "stem").select("stem", "term", "df")


def lexical_forms(queries: DataFrame, df: DataFrame | None = None, n: DataFrame | None = None, share: float = 0.05, strategies: Sequence[str] = ("lexical", "lexical-df", "lexical-pfx")) -> DataFrame:
    """(strategy, query_id, term, times): what each strategy looks up for each query (query_id, term).

    lexical: all of its terms. lexical-df: those that some and at most ``share`` of the documents (one at least) have. lexical-pfx:
    all terms that begin with one of its terms, where these are in at most that share together; a term that several
    begin counts so many times. A query of which nothing is left uses all of its terms, or all that begin with them. ``df`` has
    document frequencies, ``n`` the number of documents in one row; lexical alone needs neither.
    """
    asked = queries.select("query_id", "term").distinct()
    forms = []
    if "lexical" in strategies:
        forms.append(asked.select(F.lit("lexical").alias("strategy"), "query_id", "term", F.lit(1).cast("long").alias("times")))

    def distinct_or_all(asked: DataFrame, kept: DataFrame, by: str) -> DataFrame:
        rare = asked.join(kept.select(by), by, "left_semi")
        return rare.unionByName(asked.join(rare.select("query_id").distinct(), "query_id", "left_anti"))

    if "lexical-df" in strategies:
        kept = distinct_or_all(asked, distinctive(df, n, share), "term")
        forms.append(kept.select(F.lit("lexical-df").alias("strategy"), "query_id", "term", F.lit(1).cast("long").alias("times")))
    if "lexical-pfx" in strategies:
        stems = asked.withColumnRenamed("term", "stem")
        told = prefix_forms(stems, df)
        counts = told.groupBy(F.col("stem").alias("term")).agg(F.sum("df").alias("df"))
        kept = distinct_or_all(stems, distinctive(counts, n, share).withColumnRenamed("term", "stem"), "stem")
        forms.append(kept.join(told, "stem").groupBy(F.lit("lexical-pfx").alias("strategy"), "query_id", "term").agg(F.count("*").alias("times")))
    return reduce(DataFrame.unionByName, forms)


def lexical_hits(forms: DataFrame, postings: DataFrame, k: int, within: Sequence[str] = ()) -> DataFrame:
    """(strategy, query_id, within, uid, score, rank): the ``k`` best of every strategy at once, by how often what it looks up
    occurs; the ``k`` best for each value of the columns ``within`` of ``postings`` (uid, term, tf, within). The postings are read once.

    What the queries look up is copied to the postings, which stay where they are: those of a uid meet and are added up
    in one task, and only the ``k`` best of a task leave it."""
    met = postings.join(F.broadcast(forms), "term").groupBy("strategy", "query_id", *within, "uid").agg(F.sum(F.col("tf") * F.col("times")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("strategy", "query_id", *within).orderBy(F.desc("score"), "uid"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def lexical_search(queries: DataFrame, postings: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, uid, score, rank): any of a query's terms, scored by how often they occur.

    With ``allowed`` (term) only those terms count; queries that have none of them fall back to all of theirs."""
    asked = queries.select("query_id", "term").distinct()
    if allowed is not None:
        rare = asked.join(allowed.select("term"), "term", "left_semi")
        asked = rare.unionByName(asked.join(rare.select("query_id").distinct(), "query_id", "left_anti"))
    forms = asked.select(F.lit("lexical").alias("strategy"), "query_id", "term", F.lit(1).cast("long").alias("times"))
    return lexical_hits(forms, postings, k).select("query_id", "uid", "score", "rank")


def fuse(rankings: list[DataFrame], k: int, constant: int = 60, digits: int = 12) -> DataFrame:
    """Reciprocal rank fusion of (query_id, uid, rank): the sum of 1 / (constant + rank); equal sums keep the order
    in which the rankings, and then their ranks, first had the row."""
    parts = [r.select("query_id", "uid", "rank", F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy("query_id", "uid").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), digits).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "uid"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "uid", "score", "rank")


def expand(hits: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Seeds (query_id, uid, rank) and all rows (uid, group) of the groups that they are in: seeds first, each once. ``hits`` is read several times.

    The result has nearly as many rows as queries times rows, so both are dealt out over a grid that grows with this product (two counts are run when the query is built), each
    cell a task. A row carries the queries that it is a seed of, and meets the queries of its group as arrays, so that what is shuffled is as small as its sides. Only rows of several
    groups, which a query may reach more than once, are shuffled as pairs."""
    # Sides that are dealt out by their cell meet by it and more without being shuffled again.
    hits.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    seeds = hits.groupBy("query_id", "uid").agg(F.min("rank").alias("rank"))
    placed = rows.where(F.col(group).isNotNull()).groupBy("uid").agg(F.collect_set(group).alias("groups"))
    groups = hits.join(rows, "uid").where(F.col(group).isNotNull()).select("query_id", group).distinct()
    queries, many = hits.select("query_id").distinct().count(), rows.count()
    over = max(1, -(-queries // _QUERIES))
    cols = max(1, -(-queries * many // (over * _PAIRS)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda df: df.withColumn("cell", F.col("row") * cols + F.col("col")).drop("row", "col").repartitionById(over * cols, "cell")
    asked = groups.withColumn("row", part("query_id", over)).groupBy(group, "row").agg(F.collect_list("query_id").alias("query_ids"))
    runs = F.transform(F.sequence(F.lit(1), F.size("query_ids"), F.lit(_RUN)), lambda at: F.slice("query_ids", at, F.lit(_RUN)))
    asked = asked.withColumn("query_ids", F.explode(runs))
    seeded = seeds.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "rank"))).alias("seeds"))
    one = placed.where(F.size("groups") == 1).select("uid", F.col("groups")[0].alias(group)).join(seeded, "uid", "left")
    met = deal(one.withColumn("col", part("uid", cols)).withColumn("row", every(over))).join(deal(asked.withColumn("col", every(cols))).hint("merge"), [group, "cell"])
    pairs = met.select("uid", "seeds", F.explode("query_ids").alias("query_id"))
    more = pairs.select("query_id", "uid", F.try_element_at("seeds", F.col("query_id")).alias("rank"))
    several = placed.where(F.size("groups") > 1).select("uid", F.explode("groups").alias(group)).join(groups, group).select("query_id", "uid").distinct()
    alone = seeds.join(placed, "uid", "left_anti").select("query_id", "uid", "rank")
    return more.unionByName(several.join(seeds, ["query_id", "uid"], "left")).unionByName(alone).withColumn("seed", F.col("rank").isNotNull())


def best_of_groups(asked: DataFrame, queries: DataFrame, question: str, rows: DataFrame, text: str, group: str, k: int, pattern: str = "[a-z]{2,}", digits: int = 9) -> DataFrame:
    """(query_id, uid, score, rank): of all rows (uid, group, text) of the groups that each query asks for (query_id, group) the ``k``
    best by the share of distinct words that both have, as ``token_overlap`` tells it.

    The questions of a group are one array that each of its rows meets. A row's words are told once, and neither its text nor a pair leaves its task but for the ``k`` best of it."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0)))
    questions = queries.select("query_id", words(F.col(question)).alias("w"))
    listed = asked.select("query_id", group).distinct().join(questions, "query_id").groupBy(group)
    listed = listed.agg(F.collect_list(F.struct("query_id", "w")).alias("asked"), F.array_distinct(F.flatten(F.collect_list("w"))).alias("any"))
    told = rows.select("uid", group, words(F.col(text)).alias("all")).join(F.broadcast(listed), group)
    told = told.select("uid", "asked", F.size("all").alias("n"), F.array_intersect("all", "any").alias("some"))

    def score(q: Column) -> Column:
        common = F.size(F.array_intersect(F.col("some"), q["w"]))
        union = F.col("n") + F.size(q["w"]) - common
        return F.struct(q["query_id"].alias("query_id"), F.when(union > 0, F.round(common / union, digits)).otherwise(F.lit(0.0)).alias("score"))

    pairs = told.select("uid", F.explode(F.transform("asked", score)).alias("p")).select("p.query_id", "uid", "p.score")
    return top_k(pairs, k)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The same hits by another score, cut to ``k``. ``score`` may be any column, such as a pandas UDF of a model."""
    return top_k(hits.drop("rank", "score").withColumn("score", score), k)


def embedder(make_predict: Callable, batch_size: int = 64) -> Callable[[Column], Column]:
    """A column function from texts to vectors. ``make_predict`` loads a model once a Python worker and returns a function
    from an array of texts to one of vectors, which gets ``batch_size`` texts at a time."""
    return predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)


def pair_scorer(score_pairs: Callable[[list[str], list[str]], Sequence[float]]) -> Callable[[Column, Column], Column]:
    """A column function from (query, text) to a score for ``rerank``; ``score_pairs`` gets an Arrow batch at a time."""

    @F.pandas_udf(DoubleType())
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score_pairs(query.tolist(), text.tolist()), dtype="float64")

    return score


def token_overlap(a: Column, b: Column, pattern: str = "[a-z]{2,}", digits: int = 9) -> Column:
    """The share of distinct words that two texts have in common: the default score of ``rerank``."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(pattern), F.lit(0))) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.round(F.size(F.array_intersect(x, y)) / union, digits)).otherwise(F.lit(0.0))


def resolve_gold(questions: DataFrame, rows: DataFrame, keyword: str, text: str, most: int = 4) -> DataFrame:
    """(query_id, uid): the rows whose text holds the question's keyword.

    Words of a keyword between its first and last blank stand between blanks in the text too: up to ``most`` of them are
    looked up by hash among the runs of words of the texts, and what meets is compared in full. Keywords with fewer than
    two blanks are met by their first characters. A null or empty keyword is in no text."""
    words = F.split(keyword, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    run = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    asked = questions.select("query_id", F.col(keyword).alias("keyword"), inner.alias("inner"), F.least(F.size(inner), F.lit(most)).alias("n"))
    anchors = asked.where("n > 0").select("query_id", "n", run(F.col("inner"), F.lit(1), F.col("n")).alias("h"))
    sizes = F.broadcast(anchors.agg(F.array_sort(F.collect_set("n")).alias("sizes")))  # ``most`` numbers at most
    told = rows.select("uid", F.split(text, " ").alias("w"))
    # Where the keywords begin with few words, only runs that begin with one of these are hashed.
    firsts = [x[0] for x in asked.where("n > 0").select(F.col("inner")[0]).distinct().limit(_FIRSTS + 1).collect()]
    at = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w")))
    at = at if len(firsts) > _FIRSTS else F.filter(at, lambda i: F.get("w", i - 1).isin(firsts))
    told = told.crossJoin(sizes).select("uid", "w", "sizes", at.alias("at"))
    runs = F.flatten(F.transform("sizes", lambda n: F.transform(F.filter("at", lambda i: i <= F.size("w") - n + 1), lambda i: run(F.col("w"), i, n))))
    met = told.select("uid", F.explode(F.array_distinct(runs)).alias("h")).join(anchors, "h").select("query_id", "uid").distinct()
    whole = met.join(rows.select("uid", F.col(text).alias("text")), "uid").join(asked.where("n > 0").select("query_id", "keyword"), "query_id")
    long = whole.where(F.contains("text", "keyword")).select("query_id", "uid")
    few = asked.where("n <= 0 and keyword <> ''")
    if few.isEmpty():
        return long
    held = contained(few, "keyword", rows, text).select(F.col("part").alias("keyword"), F.col("whole").alias("text"))
    short = held.join(few.select("query_id", "keyword"), "keyword").join(rows.select("uid", F.col(text).alias("text")), "text").select("query_id", "uid")
    return long.unionByName(short)


def of_groups(asked: DataFrame, rows: DataFrame, group: str, gold: DataFrame) -> DataFrame:
    """(query_id, found, candidates): how many uids of ``rows`` (uid, group) the groups have that each query asks for (query_id, group), and how
    many of its gold (query_id, uid) are among them. A uid counts once, whatever its groups; rows are counted by the groups that a uid has, and no query is paired with rows."""
    placed = rows.where(F.col(group).isNotNull() & F.col("uid").isNotNull()).groupBy("uid").agg(F.array_sort(F.collect_set(group)).alias("groups"))
    wanted = asked.where(F.col(group).isNotNull()).groupBy("query_id").agg(F.collect_set(group).alias("wanted"))
    among = F.arrays_overlap("wanted", "groups")
    many = placed.groupBy("groups").agg(F.count("*").alias("n")).join(F.broadcast(wanted), among).groupBy("query_id").agg(F.sum("n").alias("candidates"))
    good = gold.select("query_id", "uid").join(placed, "uid").join(wanted, "query_id").where(among).groupBy("query_id").agg(F.count("*").alias("found"))
    return many.join(good, "query_id", "left").select("query_id", F.coalesce("found", F.lit(0).cast("long")).alias("found"), "candidates")


def recall_by_question(hits: DataFrame, gold: DataFrame, strategies: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """(strategy, query_id, found, gold, candidates) of every strategy for every question that has gold. ``counted`` (strategy, query_id, found,
    candidates) has hits that are counted already, which add to ``hits``."""
    n = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    asked = n.withColumn("strategy", F.explode(F.lit(list(strategies))))
    # Judgements are copied to the hits, which are counted where they are.
    told = hits.join(F.broadcast(gold.select("query_id", "uid", F.lit(1).alias("good"))), ["query_id", "uid"], "left").groupBy("strategy", "query_id").agg(F.count("good").alias("found"), F.count("*").alias("candidates"))
    if counted is not None:
        told = told.unionByName(counted).groupBy("strategy", "query_id").agg(F.sum("found").alias("found"), F.sum("candidates").alias("candidates"))
    return asked.join(told, ["strategy", "query_id"], "left").fillna(0, ["found", "candidates"]).select("strategy", "query_id", "found", "gold", "candidates")


def recall(hits: DataFrame, gold: DataFrame, strategies: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """(strategy, queries, hit_rate, recall, candidates): over the questions that have gold."""
    return recall_by_question(hits, gold, strategies, counted).groupBy("strategy").agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("found") > 0).cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.col("found") / F.col("gold")), 6).alias("recall"),
        F.round(F.avg("candidates"), 6).alias("candidates"),
    )


def recall_matrix(hits: DataFrame, gold: DataFrame, strategies: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """(query_id, gold, one column a strategy): found/gold of each question."""
    rows = recall_by_question(hits, gold, strategies, counted).withColumn("cell", F.concat_ws("/", "found", "gold"))
    return rows.groupBy("query_id", "gold").pivot("strategy", list(strategies)).agg(F.first("cell"))


def missed_by(rows: DataFrame, strategy: str) -> DataFrame:
    """(query_id, strategy, found, gold): what the others found of the questions of which ``strategy`` found nothing."""
    none = rows.where((F.col("strategy") == strategy) & (F.col("found") == 0)).select("query_id")
    return rows.where(F.col("strategy") != strategy).join(none, "query_id").select("query_id", "strategy", "found", "gold")

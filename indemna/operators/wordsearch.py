"""Searches by words: all questions over all texts in one reading, with the k best of a task's pieces as all that leaves it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.operators.nearest import greatest

#: Texts that are scored at once, and words that a task counts until it passes on what it has.
_PIECE, _HELD = 256, 1 << 16


def by_uid(docs: DataFrame, group: str) -> DataFrame:
    """(uid, group, text, counted): the rows (uid, group, text), ``counted`` where they stand for all texts of their uid. The texts of a uid
    that several rows have make one row more, without group, that counts for them."""
    docs = docs.select("uid", group, "text").withColumn("counted", F.lit(True))
    often = docs.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("uid").alias("again"))
    if often.isEmpty():
        return docs
    same = F.col("uid").eqNullSafe(F.col("again"))
    rows = docs.join(often, same, "left_semi")
    whole = rows.groupBy("uid").agg(F.concat_ws("\n", F.collect_list("text")).alias("text")).select("uid", F.lit(None).cast(docs.schema[group].dataType).alias(group), "text", F.lit(True).alias("counted"))
    return docs.join(often, same, "left_anti").unionByName(rows.withColumn("counted", F.lit(False))).unionByName(whole)


def text_frequency(rows: DataFrame, pattern: str = "[a-z]{2,}") -> DataFrame:
    """(term, df): the number of uids that have each word, of rows made by ``by_uid``. Tasks add up texts until they hold ``_HELD`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = re.compile(pattern), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])
        for batch in batches:
            for i in range(0, batch.num_rows, _PIECE):
                for text in batch.column("text").slice(i, _PIECE).to_pylist():
                    held.update(set(words.findall(text)))
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    texts = rows.where("counted").select(F.lower("text").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _listed(rows: list[tuple[int, int, int]], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For (term, query, times): where the queries of each term begin, the queries, the times."""
    term, query, times = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return np.searchsorted(term, np.arange(terms + 1)), query, times.astype(np.float64)


def _added(listed: tuple, texts: np.ndarray, terms: np.ndarray, times: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The scores (queries, texts) of what occurs: text, term and how often."""
    start, query, weight = listed
    n = start[terms + 1] - start[terms]
    at = np.repeat(start[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.bincount(query[at] * shape[1] + np.repeat(texts, n), weight[at] * np.repeat(times, n), shape[0] * shape[1]).reshape(shape)


def _scorer(listed: dict[str, tuple], terms: dict[str, int], queries: list, k: int, pattern: str, shared: tuple | None, digits: int, group: str, schema: pa.Schema) -> Callable:
    """``shared``: the name of the strategy, the questions' own words as ``listed``, how many each has, and the queries of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(pattern)
        # The k best so far of each query: what is worse can't be among the best of all.
        best = {name: np.full((len(queries), k), -1.0) for name in [*listed, *([shared[0]] if shared else [])]}

        def kept(name: str, score: np.ndarray, ids: list) -> pa.RecordBatch:
            r, at = greatest(score, k)
            value = score[r, at]
            some = (value >= 0) & (value >= best[name].min(1)[r])
            r, at, value = r[some], at[some], value[some]
            new = np.full_like(best[name], -1.0)
            new[r, np.arange(len(r)) - np.searchsorted(r, r)] = value
            best[name] = np.sort(np.concatenate([best[name], new], 1), 1)[:, -k:]
            values = [[name] * len(r), [queries[i] for i in r], [ids[i] for i in at], value]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(0, batch.num_rows, _PIECE):
                rows = batch.slice(i, _PIECE).to_pylist()
                rows.sort(key=lambda x: (x["uid"] is None, x["uid"]))
                met, sizes = [], np.zeros(len(rows))
                for j, row in enumerate(rows):
                    said = Counter(words.findall(row["text"]))
                    sizes[j] = len(said)
                    met += [(j, terms[w], n) for w, n in said.items() if w in terms]
                text, term, n = np.array(met, np.int64).reshape(-1, 3).T
                ids, shape = [row["uid"] for row in rows], (len(queries), len(rows))
                counted = np.array([row["counted"] for row in rows])
                for name, of in listed.items():
                    score = _added(of, text, term, n, shape)
                    yield kept(name, np.where((score > 0) & counted, score, -1.0), ids)
                if shared:
                    name, own, asked, of_group = shared
                    common = _added(own, text, term, np.ones(len(term)), shape)
                    union = asked[:, None] + sizes - common
                    score = np.round(np.divide(common, union, out=np.zeros(shape), where=union > 0), digits)
                    wanted = np.zeros(shape, bool)
                    for j, row in enumerate(rows):
                        wanted[of_group.get(row[group], []), j] = True
                    yield kept(name, np.where(wanted, score, -1.0), ids)

    return run


def word_search(rows: DataFrame, group: str, forms: DataFrame, k: int, questions: DataFrame | None = None, asked: DataFrame | None = None, shared: str = "shared", pattern: str = "[a-z]{2,}", digits: int = 9) -> DataFrame:
    """(strategy, query_id, uid, score, rank): the ``k`` best texts of each strategy and query.

    Each strategy adds up how often a text has what ``forms`` (strategy, query_id, term, times) looks up; texts without any aren't found.
    With ``asked`` (query_id, group), strategy ``shared`` scores all rows of the groups that a query asks for by the share of distinct words that
    both have; ``questions`` (query_id, term) has the questions' words. ``rows`` is made by ``by_uid``. Equal scores rank by uid.

    What is looked up goes to the tasks with the function, as a broadcast would, so it has to fit one executor. A text is read once and leaves nothing but its
    place among the best of its task."""
    told = [(x["strategy"], x["query_id"], x["term"], x["times"]) for x in forms.toArrow().to_pylist()]
    own = [(x["query_id"], x["term"]) for x in questions.distinct().toArrow().to_pylist()] if asked is not None else []
    wanted = [(x["query_id"], x[group]) for x in asked.distinct().toArrow().to_pylist()] if asked is not None else []
    queries = sorted({x[1] for x in told} | {x[0] for x in wanted})
    nth = {x: i for i, x in enumerate(queries)}
    own = [x for x in own if x[0] in nth]
    terms = {w: i for i, w in enumerate(sorted({x[2] for x in told} | {x[1] for x in own}))}
    listed = {s: _listed([(terms[w], nth[q], n) for name, q, w, n in told if name == s], len(terms)) for s in sorted({x[0] for x in told})}
    common = None
    if asked is not None:
        sizes, of_group = np.zeros(len(queries)), {}
        for q, _ in own:
            sizes[nth[q]] += 1
        for q, g in wanted:
            if g is not None:
                of_group.setdefault(g, []).append(nth[q])
        common = (shared, _listed([(terms[w], nth[q], 1) for q, w in own], len(terms)), sizes, of_group)
    kinds = f"strategy string, query_id {forms.schema['query_id'].dataType.simpleString()}, uid {rows.schema['uid'].dataType.simpleString()}, score double"
    empty = rows.sparkSession.createDataFrame([], kinds).toArrow().schema
    texts = rows.select("uid", group, "counted", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    best = texts.mapInArrow(_scorer(listed, terms, queries, k, pattern, common, digits, group, empty), kinds)
    rank = F.row_number().over(Window.partitionBy("strategy", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("uid")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)

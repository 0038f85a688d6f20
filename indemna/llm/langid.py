"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.llm.common import pieces, settle, utf8

#: Most languages that profiles are made for; with ``top`` n-grams each this bounds what is broadcast.
MAX_LANGS = 1000
#: Distinct (language, n-gram) counts that a task holds before it passes them on.
_HELD = 400_000


def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1-, 2- and 3-grams of the lower-cased words of a text and their counts.

    A word is a run of letters with a blank on either side; a gram is its code points, 21 bits each.
    The blank alone is no gram, nor is one that holds a blank inside.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    cp = np.concatenate([[np.uint64(0)], np.where(letters()[cp.astype(np.int64)], cp, np.uint64(0)), [np.uint64(0)]])
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    cp = cp[keep]
    if len(cp) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    two = (cp[:-1] << np.uint64(21)) | cp[1:]
    three = ((cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:])[cp[1:-1] != 0]
    tag = np.uint64(1) << np.uint64(63)
    # Two-grams that start with the blank would equal one-grams: they carry the top bit.
    return np.unique(np.concatenate([cp[cp != 0], two | tag, three]), return_counts=True)


def language_profiles(docs: DataFrame, top: int = 400) -> DataFrame:
    """(lang, gram, rank): the ``top`` most frequent n-grams of each language of ``docs`` (text, lang).

    Every whole text counts; rows with a null lang or text teach nothing. Equal counts rank by gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            langs, codes, counts = [], [], []
            for lang, parts in held.items():
                g, n = _merged(parts)
                langs += [lang] * len(g)
                codes.append(g.view(np.int64))
                counts.append(n)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held.setdefault(lang, []).append(g := grams(text.decode("utf-8", "replace")))
                size += len(g[0])
            if size > _HELD:
                held = {k: [_merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > _HELD // 2:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    taught = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("string"))
    counts = taught.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return settle(counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", "rank"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    g = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    u, at = np.unique(g, return_inverse=True)
    return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)


def identify_language(docs: DataFrame, profiles: DataFrame, top: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text), from ``language_profiles``, and its ``keep`` columns.

    The ``top`` most frequent n-grams of the whole text are ranked; each adds the difference between
    its rank and its rank in the profile, or ``top`` if it isn't there. The language with the least sum
    wins, the first in alphabetical order on a tie. score is 1 - sum / greatest possible sum, 0 to 1.
    A null text, one without letters, and any text if nothing was learned, give ``und`` and 0. Every row is judged by
    its own whole text, so repeated rows and repeated or null ids change nothing; columns not in ``keep`` are ignored.
    Profiles of more than ``MAX_LANGS`` languages are refused with a ValueError, since they are broadcast.
    """
    n_langs = profiles.select("lang").distinct().count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"{n_langs} languages; {MAX_LANGS} at most")
    known = profiles.orderBy("lang", "rank").toPandas()
    langs = sorted(known["lang"].unique())
    tables = []
    for lang in langs:
        own = known[known["lang"] == lang]
        order = np.argsort(own["gram"].to_numpy(np.int64).view(np.uint64))
        tables.append((own["gram"].to_numpy(np.int64).view(np.uint64)[order], own["rank"].to_numpy(np.int64)[order]))
    shared = docs.sparkSession.sparkContext.broadcast((langs, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables = shared.value
        for batch in pieces(batches):
            best, score = [], []
            for text in utf8(batch.column(1)):
                g, n = grams(text.decode("utf-8", "replace"))
                if not len(g) or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                if len(g) > top:
                    least = np.partition(n, len(n) - top)[len(n) - top]
                    g, n = g[n >= least], n[n >= least]
                g = g[np.lexsort((g.view(np.int64), -n))][:top]
                rank = np.arange(1, len(g) + 1)
                sums = []
                for theirs, ranks in tables:
                    at = np.minimum(np.searchsorted(theirs, g), len(theirs) - 1)
                    sums.append(int(np.where(theirs[at] == g, np.abs(ranks[at] - rank), top).sum()))
                k = int(np.argmin(sums))
                best.append(langs[k])
                score.append(1 - sums[k] / (top * len(g)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), *[batch.column(c) for c in keep]], names=["doc_id", "lang_pred", "score", *keep])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in keep if c != "text"])
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double" + "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in keep))

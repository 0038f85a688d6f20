"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.llm.common import settle, utf8

#: What is measured of a text, in the order of the feature vector.
FEATURES = (
    "bias", "length", "word_length", "long_words", "distinct_words", "top_word", "repeats", "caps_words", "capitals", "digits", "symbols",
    "pipes", "exclamations", "sentence_ends", "blanks", "distinct_lines", "line_length", "vowel_less", "non_ascii", "symbol_words",
)

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:!?'\"()-|")


def _share(text: bytes, kind: bytes, n: int) -> float:
    return (n - len(text.translate(None, kind))) / n


def features(text: bytes) -> np.ndarray:
    """The feature vector of a text; shares between 0 and 1, lengths as logarithms scaled to about 1."""
    x = np.zeros(len(FEATURES))
    x[0] = 1
    words = text.split()
    if not words:
        return x
    n, k = len(text), len(words)
    seen = Counter(words)
    lines = [y for y in text.split(b"\n") if y.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    x[1] = np.log1p(k) / 10
    x[2] = min((n - _share(text, b" \n", n) * n) / k, 40) / 10
    x[3] = sum(len(w) > 20 for w in seen) / len(seen)
    x[4] = np.log1p(len(seen)) / np.log1p(k)
    x[5] = max(seen.values()) / k if k > 1 else 0
    x[6] = repeats / k
    x[7] = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / k
    x[8] = _share(text, _UPPER, n)
    x[9] = _share(text, _DIGITS, n)
    x[10] = _share(text, _SYMBOLS, n)
    x[11] = text.count(b"|") / k
    x[12] = text.count(b"!") / k
    x[13] = min(1.0, sum(text.count(c) for c in (b".", b"!", b"?")) / k)
    x[14] = _share(text, b" \t\n\r", n)
    x[15] = len(set(lines)) / len(lines)
    x[16] = np.log1p(n / len(lines)) / 10
    x[17] = sum(not w.translate(None, b"bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ") for w in seen) / len(seen)
    x[18] = _share(text, bytes(range(128, 256)), n)
    x[19] = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1:] in _SYMBOLS) / k
    return x


#: Pairs of features that the model also sees as products.
_PAIRS = (("distinct_words", "length"), ("repeats", "length"), ("top_word", "length"), ("distinct_lines", "length"))
#: Shares that matter when small are also seen as square roots.
_ROOTS = ("repeats", "caps_words", "symbols", "pipes", "exclamations", "symbol_words")


def expanded(x: np.ndarray) -> np.ndarray:
    """Feature rows with the roots and products that a linear score needs."""
    at = {k: i for i, k in enumerate(FEATURES)}
    more = [np.sqrt(x[:, at[k]]) for k in _ROOTS] + [x[:, at[a]] * x[:, at[b]] for a, b in _PAIRS]
    return np.column_stack([x, *more])


def measured(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns of every row of ``docs``, and the features of its whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in utf8(batch.column(0))]).reshape(batch.num_rows, len(FEATURES))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat], names=[*kept, "x"])

    own = docs.select(F.col("text").cast("string"), *kept)
    return own.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[1:]) + ", x array<float>")


#: Groups in which the sums of tasks are added up before the driver adds these.
_GROUPS = 16


def _sums(table: DataFrame, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For the rows with ``positive``, and for all: (mean loss at each point, its gradient and curvature at the first
    point, mean features), for softplus(z). One pass; executors add up the sums of tasks by group."""
    shared = table.sparkSession.sparkContext.broadcast(points)
    k, d = points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        total = np.zeros((2, 1 + k + 2 * d + d * d))
        for batch in batches:
            x = expanded(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES)))
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, own in enumerate((x[positive], x)):
                z = own @ p.T
                s = 1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500)))
                total[i] += np.concatenate([[len(own)], np.logaddexp(0, z).sum(axis=0), own.T @ s, ((own * (s * (1 - s))[:, None]).T @ own).ravel(), own.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % _GROUPS], pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x) for batch in rows for x in batch.column("sums").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    parts = table.select("x", "positive").mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(2 * (1 + k + 2 * d + d * d))).reshape(2, -1)
    out = []
    for n, rest in ((t[0], t[1:]) for t in total):
        loss, grad, curve, mean = np.split(rest / max(n, 1), [k, k + d, k + d + d * d])
        out.append([loss, grad, curve.reshape(d, d), mean])
    return out[0], out[1]


def fit_positive_unlabelled(table: DataFrame, prior: float, rounds: int, ridge: float = 1e-4, least_gain: float = 1e-5) -> np.ndarray:
    """Weights that minimise the non-negative risk of the logistic loss l over a table (x, positive) of features, whose
    rows with ``positive`` are the trusted positives and all of whose rows are the unlabelled text:

        prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)])

    As l(z) - l(-z) = -z, the risk without the bound is convex; damped Newton steps minimise it. Where the
    second term would fall below 0 (the model fits noise of the positives), only the first is descended. Where
    neither step helps, as at the edge between both, the other one is tried before the search ends.
    Every round reads the table once, on all executors; the driver gets a fixed number of sums.
    """
    d = len(expanded(np.zeros((1, len(FEATURES))))[0])
    w = np.zeros(d)
    steps = np.array([0.0])
    move, turned = np.zeros(d), False
    for _ in range(rounds):
        points = w + steps[:, None] * move
        (lp, gp, cp, mp), (lu, gu, cu, _) = _sums(table, points)  # softplus(z) = l(-z); l(z) = softplus(z) - z
        z_mean = points @ mp
        below = lu - prior * lp
        risk = prior * (lp - z_mean) + np.maximum(0, below) + ridge * (points**2).sum(axis=1)
        best = int(np.argmin(risk))
        if best:  # go there, then find the next direction from there
            w, steps, move, turned = points[best], np.array([0.0]), np.zeros(d), False
            if risk[0] - risk[best] < least_gain:
                break
            continue
        if turned:
            break
        turned = len(steps) > 1
        if (below[0] >= 0) != turned:
            grad, curve = gu - prior * mp, cu
        else:
            grad, curve = prior * (gp - mp), prior * cp
        move = -np.linalg.solve(curve + (2 * ridge) * np.eye(d), grad + 2 * ridge * w)
        steps = np.array([0.0, 1.0, 0.5, 0.25, 0.1, 0.02])
    return w


def _scored(table: DataFrame, weights: np.ndarray, *kept: str) -> DataFrame:
    """``kept`` columns and z, the linear score, of every row of ``table``."""
    shared = table.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = expanded(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.clip(x @ shared.value, -500, 500))], names=[*kept, "z"])

    own = table.select("x", *kept)
    return own.mapInArrow(run, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.schema.fields[1:]) + "z double")


def estimate_prior(table: DataFrame, rounds: int, least_share: float = 0.2) -> float:
    """The share of positives in the unlabelled text, from (x, positive, fold) alone.

    A model is fitted with four of five positives and a prior of a half. Whatever the mixture, the sets of texts above a
    score hold at least as much of the unlabelled text as the prior times what they hold of the positives; the least
    ratio over all scores, taken with the positives left out of the fit, is the estimate. Sets with less than
    ``least_share`` of these positives are too noisy to count; without positives it is 0.5.
    """
    weights = fit_positive_unlabelled(table.select("x", (F.col("positive") & ~F.col("fold")).alias("positive")), 0.5, rounds)
    bins = _scored(table, weights, "positive", "fold").groupBy(F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "z")) * 10).alias("bin"))
    counts = bins.agg(F.count_if(F.col("positive") & F.col("fold")).alias("p"), F.count("*").alias("u")).orderBy(F.desc("bin")).toPandas()  # 601 rows at most
    p, u = counts["p"].cumsum().to_numpy(float), counts["u"].cumsum().to_numpy(float)
    if not len(p) or not p[-1]:
        return 0.5
    enough = p >= least_share * p[-1]
    return float(np.clip((u[enough] / u[-1] / (p[enough] / p[-1])).min(), 0.02, 0.98))


def classify_quality(docs: DataFrame, labels: DataFrame, rounds: int = 24) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, label).

    label is 1 for trusted positives; documents without that label are unlabelled web text. Only the positives are
    learned from by their label; all rows, whatever their label, are the unlabelled text, and 0 labels teach nothing.
    The class prior is estimated from positives and unlabelled text alone (``estimate_prior``). Of several labels of
    one document the greatest counts; other labels than 0 and 1, and labels of a null doc_id, don't.

    score is the estimated probability of label 1, 0 to 1; predicted is 1 from 0.5 on. Empty and null texts
    are scored by the bias alone, very long ones by the whole text. Repeated rows count as often; rows with one id and
    unlike texts all have its label; other columns are ignored. Texts are measured once and not shuffled.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("label").cast("int")).alias("label"))
    table = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").join(known, "doc_id", "left")
    positive, fold = F.coalesce(F.col("label") == 1, F.lit(False)), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, F.lit(False))
    table = settle(table.select("doc_id", "x", positive.alias("positive"), fold.alias("fold")))
    weights = fit_positive_unlabelled(table, estimate_prior(table, rounds // 2), rounds)
    score = 1 / (1 + F.exp(-F.col("z")))
    return _scored(table, weights, "doc_id").select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))

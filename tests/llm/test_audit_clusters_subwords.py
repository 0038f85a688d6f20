"""Filter audit, centroid clusters and subword pieces against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from indemna.llm import audit, clusters, subwords

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def fails(text: str) -> set[str]:
    words = re.findall("[^\x20\x09-\x0d]+", text)
    found = {"A"} if len(words) < 200 else set()
    found |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    found |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    return found | ({"D"} if re.search("[#$%&*|]", text) else set())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}é" for _ in range(n))
    rows = []
    for i in range(60):
        text = rng.choice([words(250, 5), words(250, 400), words(20, 9), words(205, 300).upper(), words(300, 200) + " | 5 %", "\t\x0b ", "", None, "same words " * 120])
        rows.append((i, text, rng.choice(["en", "de", "", None])))
    return [*rows, (3, "again", "en"), (3, "again", "en"), (None, "again", "en"), (70, "again", "fr"), (71, "x " * 200_000, "fr"), (None, None, None)]


def test_failures(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("A", F.lit("x")).withColumn("first", F.lit(1)).withColumn("h1", F.lit(0))
    got = audit.document_failures(docs, keep=("lang",)).collect()
    smaller = lambda i, t: any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in texts)
    want = [(i, lang, *(f in fails(t or "") for f in "ABCD"), smaller(i, t or "")) for i, t, lang in texts]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.lang, r.A, r.B, r.C, r.D, r.E)) for r in got)
    assert audit.document_failures(docs.limit(0)).count() == 0


def test_interactions(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), *(rng.choice([True, False, None]) for _ in range(4)), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, p boolean, q boolean, r boolean, s boolean, bad boolean").withColumn("rank", F.lit("x")).withColumn("step", F.lit(0))
    got = audit.filter_interactions(df, F.col("part"), {f: F.col(f) for f in "pqrs"}, {"bad_lost": F.col("bad")}).collect()
    want = {}
    for part in {x[0] or "" for x in rows}:
        own = [(dict(zip("pqrs", x[1:5], strict=True)), x[5]) for x in rows if (x[0] or "") == part]
        for order in map("".join, permutations("pqrs")):
            left = own
            for step, f in enumerate(order, 1):
                went = [x for x in left if x[0][f]]
                before, left = left, [x for x in left if not x[0][f]]
                alone = sum(bool(x[0][f]) and sum(map(bool, x[0].values())) == 1 for x in own)
                want[part, order, step] = [f, len(left), len(went), sum(bool(x[0][f]) for x in own) - sum(bool(x[0][f]) for x in before), alone, sum(x[1] for x in went)]
    for part in {x[0] for x in want}:
        for f in "pqrs":
            total = sum(v[2] for k, v in want.items() if k[0] == part and v[0] == f)
            for k, v in want.items():
                if k[0] == part and v[0] == f:
                    v.append(total)
    assert {(r.part, r.filter_order, r.step): [r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.bad_lost, r.shapley] for r in got} == want
    assert len(got) == len(want) == 3 * 24 * 4
    assert audit.filter_interactions(df.limit(0), F.col("part"), {"p": F.col("p")}).count() == 0
    some = audit.filter_interactions(df, F.lit(1), {"p": F.col("p"), "q": F.col("q")}, orders=["qp"]).collect()
    assert [(r.part, r.filter_order) for r in some] == [("1", "qp")] * 2


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = [near(v) for _, v in kept]
    return [(i, j, d, sum(e for e, l in best if l == j), sum(e for e, _ in best), centroids[j]) for (i, _), (d, j) in zip(kept, best, strict=True)]


@pytest.mark.parametrize("k", [7, 500])
def test_clusters(spark, k):
    rng = random.Random(8)
    middles = [[rng.uniform(-3, 3) for _ in range(5)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(middles)]) for i in range(300)]
    rows += [(400 + i, [float(i % 2), 0.0, -1.0, 0.5, 0.25]) for i in range(20)]  # ties and copies
    rows += [(5, [9.0] * 5), (5, [9.0] * 5), (5, [-9.001] * 5), (None, [1.0] * 5), (600, None), (601, []), (602, [1.0] * 4), (603, [1.0] * 6), (604, [1.0, None, 1.0, 1.0, 1.0]), (605, [math.nan] * 5), (606, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).withColumn("inertia", F.lit(2)).repartition(3)
    got = clusters.cluster_vectors(df, k=k, dims=5).collect()
    want = plain_clusters(rows, k, 5, 5)
    assert sorted(map(repr, want)) == sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid)) for r in got)
    assert k != 7 or sum(r.n_measured for r in got) < 0.6 * k * len(got)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    assert clusters.cluster_vectors(df, dims=2).count() == 0 and clusters.cluster_vectors(df.limit(0), dims=2).count() == 0
    only = clusters.cluster_vectors(df, dims=1).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in only] == [(1, 0, 0, 0)]
    nameless = spark.createDataFrame([(None, [1.0]), (None, [3.0])], "vec_id long, embedding array<double>")
    assert sorted(r.distance for r in clusters.cluster_vectors(nameless, dims=1).collect()) == [256**2] * 2  # one centroid, moved to their middle
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster_vectors(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dims=1).count()


def test_bounds_lose_no_centroid():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (500, 16))
    centroids = np.concatenate([rng.integers(-300, 300, (30, 16)), v[:5], v[:5]])
    pivots = clusters.far_apart(centroids, 6)
    to_pivots = np.sqrt(np.stack([clusters.squared(v, p) for p in pivots], 1))
    cluster, best, measured = clusters.nearest(v, to_pivots, centroids, pivots)
    every = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all() and measured.mean() < len(centroids)
    assert len(clusters.far_apart(np.zeros((4, 3), np.int64), 3)) == 1


def fuzz(rng: random.Random, n: int) -> list[str]:
    marks = "abcdeThe   \t\n▁éß漢字ñ𝒳😀.,;!'<>0123\x00　�"
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return subwords.Merger(f.read())


def by_hand(m: subwords.Merger, text: str) -> list[str]:
    """Always the best pair of the whole text, found anew each time."""
    symbols = list(text)
    while True:
        pairs = [(m.cost[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in m.cost]
        if not pairs:
            return symbols
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_merging(model):
    rng = random.Random(2)
    for text in [*fuzz(rng, 300), "the whole thing " * 5, "aaaaaaaaaaaaaaaaaaaaa", "▁▁▁▁▁▁▁ ▁▁▁"]:
        words = model.words(text.replace(" ", "▁"))
        assert "".join(words) == text.replace(" ", "▁")
        assert model.learn(set(words)) == {w: model.spelled(w) for w in words}
        assert [s for w in words for s in model.merged(w)] == by_hand(model, text.replace(" ", "▁"))


def test_pieces(spark, model):
    rng = random.Random(1)
    texts = [*fuzz(rng, 500), "", " ", "   ", "▁", "▁▁ a ▁", "<s>a</s><unk><0x41>", "the quick brown fox " * 20_000, "ab" * 30_000, "é" * 5000, "same", "same"]
    rows = [*enumerate(texts), (7, None), (None, "lost"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("agrees", F.lit(1))
    got = subwords.encode_pieces(df, MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or "")), True) for i, t in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.ids, r.decoded, r.agrees)) for r in got)
    assert subwords.encode_pieces(df.limit(0), MODEL).count() == 0


def test_remembered_words_change_nothing(model, monkeypatch):
    monkeypatch.setattr(subwords, "_WORDS", 3)
    texts = fuzz(random.Random(9), 50)
    assert [ids.tolist() for i in range(0, 50, 5) for ids in model.encode_all(model.library.normalize(texts[i : i + 5]))] == model.library.encode(texts)
    bad = [[0xE2 + 3, 0x96 + 3, 264], [0xFF + 3], [264, 287], [28705, 264], []]
    assert [model.decode(np.array(i, np.int64)) for i in bad] == model.library.decode(bad)


def test_query_agrees(spark):
    from indemna.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op13_pieces"](spark, folder).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(texts) and all(r.agrees for r in rows)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))

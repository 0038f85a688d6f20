"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indemna.llm.audit import document_failures, filter_interactions
from indemna.llm.chat import rotate_perspectives
from indemna.llm.clusters import cluster_vectors
from indemna.llm.common import held_out
from indemna.llm.langid import identify_language, language_profiles
from indemna.llm.lines import dedup_lines
from indemna.llm.lm import cross_entropy_difference
from indemna.llm.minhash import minhash_components
from indemna.llm.mixing import mix
from indemna.llm.pii import find_pii
from indemna.llm.quality import classify_quality
from indemna.llm.subwords import encode_pieces
from indemna.llm.vectors import near_vectors
from indemna.llm.winnow import decontaminate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 5, 0).alias("held_out"))
    profiles = language_profiles(docs.where("doc_id is not null and not held_out"))
    told = identify_language(docs, profiles)
    return told.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("quality").alias("label"))
    scores = classify_quality(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", "n_words", "n_words_dropped", F.sha2("text", 256).alias("text_sha256"))


#: Weights of the mixing query by path; other nodes weigh 1.
MIX_WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain0", "en"): 2, ("domain1", "de"): 3, ("domain2", "fr", "src2"): 5}


def domain_of(source: str) -> Column:
    """A domain for each source of the tables: its number modulo 4."""
    return F.concat(F.lit("domain"), F.try_mod(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(4)).cast("string"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token prefixes of seeded epochs for half of all tokens, by the weights above."""
    docs = table(spark, sf_dir, "documents")
    taken = mix(docs, domain_of("source"), F.col("lang"), F.col("source"), MIX_WEIGHTS)
    return taken.select("doc_id", "domain", "language", "source", "epoch", "n_tokens", "n_taken")


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue once for each participant as the assistant."""
    rows = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return rows.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    return find_pii(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, similarity 0.85."""
    return minhash_components(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more every document is like the documents of good quality than like the rest."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), targets=good)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, for each language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = document_failures(docs, keep=("lang",))
    marks = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    lost = {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
    return filter_interactions(rows.join(marks, "doc_id", "left"), F.col("lang"), {f: F.col(f) for f in "ABCDE"}, lost).drop("filter")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters around integer centroids."""
    rows = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid", "n_measured")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of a vocabulary of pieces, and back."""
    import public_tokenizers

    rows = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vectors": op1_vectors,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_lines": op4_lines,
    "op5_mixing": op5_mixing,
    "op6_perspectives": op6_perspectives,
    "op7_pii": op7_pii,
    "op8_minhash": op8_minhash,
    "op9_winnowing": op9_winnowing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_audit": op11_audit,
    "op12_centroids": op12_centroids,
    "op13_pieces": op13_pieces,
}

OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, trim(regexp_replace(lower(line), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ') AS key FROM l
), w AS (
  SELECT *, CASE WHEN key = '' THEN 0 ELSE len(string_split(key, ' ')) END AS n, string_split(key, ' ') AS ws FROM k
), d AS (
  SELECT key, min(n) AS n, any_value(ws) AS ws, min((doc_id, pos)) AS first FROM w WHERE n >= 3 GROUP BY key
), halves AS (
  SELECT DISTINCT key, n, ws, first, unnest([
    'p' || (n // 2) || ' ' || array_to_string(ws[1 : n // 2], ' '), 'p' || ((n - 1) // 2) || ' ' || array_to_string(ws[1 : (n - 1) // 2], ' '),
    's' || (n // 2) || ' ' || array_to_string(ws[n - n // 2 + 1 : n], ' '), 's' || ((n - 1) // 2) || ' ' || array_to_string(ws[n - (n - 1) // 2 + 1 : n], ' ')]) AS half
  FROM d WHERE n >= 8
), near AS (
  SELECT DISTINCT b.key FROM halves a JOIN halves b ON a.half = b.half AND a.first < b.first AND abs(a.n - b.n) <= 1
  WHERE CASE
    WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.ws[i] <> b.ws[i])) = 1
    WHEN a.n > b.n THEN len(list_filter(range(1, a.n + 1), lambda i: list_concat(a.ws[1 : i - 1], a.ws[i + 1 : a.n]) = b.ws)) > 0
    ELSE len(list_filter(range(1, b.n + 1), lambda i: list_concat(b.ws[1 : i - 1], b.ws[i + 1 : b.n]) = a.ws)) > 0 END
), m AS (
  SELECT w.*, coalesce(w.n >= 3 AND ((w.doc_id, w.pos) <> d.first OR near.key IS NOT NULL), false) AS gone
  FROM w LEFT JOIN d ON w.key = d.key LEFT JOIN near ON near.key = w.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sum(n)::BIGINT AS n_words, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_words_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
"""


def _weight_sql(names: list[str]) -> str:
    found = [f"WHEN concat_ws(chr(31), {', '.join(names)}) = concat_ws(chr(31), {', '.join(repr(p) for p in path)}) THEN {w}" for path, w in MIX_WEIGHTS.items() if len(path) == len(names)]
    return f"CASE {' '.join(found)} ELSE 1 END"


def _level_sql(own: list[str], up: list[str], above: str) -> str:
    """Names and budgets of one level of the tree, as a query over the leaves and the level above."""
    by = ", ".join(up)
    return f"""
  SELECT {", ".join(["root", *own])}, tokens, least(capacity, floor(max(lev) OVER (PARTITION BY {by}) * weight))::BIGINT AS budget
  FROM (
    SELECT *, greatest(0.0, (budget - coalesce(sum(capacity) OVER (PARTITION BY {by} ORDER BY ratio, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (PARTITION BY {by} ORDER BY ratio, {own[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS lev
    FROM (SELECT *, capacity::DOUBLE / weight AS ratio FROM (
      SELECT n.*, a.budget, ({_weight_sql(own)})::BIGINT AS weight FROM (SELECT {", ".join(["root", *own])}, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 2)::BIGINT AS capacity FROM leaves GROUP BY ALL) n
      JOIN (SELECT {by}, budget FROM {above}) a USING ({by}))))"""


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('domain' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT) % 4), 'null') AS "domain", coalesce(lang, 'null') AS "language", coalesce(source, 'null') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0) AS n_tokens FROM documents
), t AS (SELECT * FROM d WHERE n_tokens > 0 AND doc_id IS NOT NULL),
leaves AS (SELECT 0 AS root, "domain", "language", source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
l0 AS (SELECT 0 AS root, floor(sum(tokens) * 0.5)::BIGINT AS budget FROM leaves),
l1 AS ({_level_sql(['"domain"'], ["root"], "l0")}),
l2 AS ({_level_sql(['"domain"', '"language"'], ['"domain"'], "l1")}),
l3 AS ({_level_sql(['"domain"', '"language"', "source"], ['"domain"', '"language"'], "l2")}),
turns AS (SELECT *, unnest(range(0, least((budget - 1) // tokens, 1) + 1)) AS epoch FROM l3 WHERE budget > 0),
r AS (
  SELECT t.*, epoch, budget - epoch * tokens AS rest, md5('7:' || epoch || ':' || doc_id || ':1') AS digest
  FROM t JOIN turns u ON t."domain" = u."domain" AND t."language" = u."language" AND t.source = u.source
), p AS (
  SELECT *, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY "domain", "language", source, epoch ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS n_taken FROM r
)
SELECT doc_id, "domain", "language", source, epoch::INT AS epoch, n_tokens::BIGINT AS n_tokens, n_taken FROM p WHERE n_taken > 0
"""

OP6_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (
  SELECT t.conv_id, perspective, place // 4096 AS segment, place, role = perspective AS own,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>'
      ELSE '<|user:' || replace(replace(replace(role, '<|', '<\\|'), '|>', '|\\>'), chr(10), ' ') || '|>' END || chr(10) AS head, replace(text, '<|', '<\\|') || '<|end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start FROM m
)
SELECT conv_id, perspective, segment,
  coalesce(sum(sum(length(head) + length(body) + 1)) OVER (PARTITION BY conv_id, perspective ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead, count(*) AS n_turns, count(*) FILTER (own) AS n_trained, sum(length(head) + length(body) + 1)::BIGINT AS n_chars,
  coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY place) FILTER (own), '') AS mask,
  sha256(string_agg(head || body || chr(10), '' ORDER BY place)) AS text_sha256
FROM o GROUP BY conv_id, perspective, segment
"""

OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN marks USING (doc_id)
), n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), r AS (SELECT *, coalesce(list_min(list_transform(string_split(fails, ''), lambda x: CASE WHEN x = '' THEN NULL ELSE strpos(filter_order, x) END)), 6) AS went FROM n, o),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS f, coalesce(sum(n) FILTER (went > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (went = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (went < step AND contains(fails, filter_order[step])), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = filter_order[step]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (went = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (went = step), 0)::BIGINT AS toxic_lost
  FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM s
"""


def _clusters_sql(rounds: int = 5) -> str:
    """Each round as three tables: the nearest centroids, sums of components, and what they move the centroids to."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v.v) AS v, min((list_sum(list_transform(list_zip(v.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, c.cluster)) AS best
  FROM v, c{r} c GROUP BY row
)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v FROM (SELECT vec_id, v FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), v LIMIT 40)
), {",".join(steps)}
SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = best[2]
"""


OP12_SQL = _clusters_sql()

SQL: dict[str, str] = {"op4_lines": OP4_SQL, "op5_mixing": OP5_SQL, "op6_perspectives": OP6_SQL, "op11_audit": OP11_SQL, "op12_centroids": OP12_SQL}

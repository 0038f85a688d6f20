"""From raw documents to a training mix: five stages, each one operator over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indemna.llm.common import among, join_in_parts, settle
from indemna.llm.langid import identify_language, language_profiles
from indemna.llm.lines import dedup_lines
from indemna.llm.minhash import near_duplicate_rows
from indemna.llm.mixing import mix
from indemna.llm.winnow import decontaminate

#: Columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document with a lower score in its best language is rejected; it lies between letter salad and clean texts.
LEAST_LANGUAGE_SCORE = 0.3
#: Share of the tokens left that the mix takes, and weights by path; other nodes weigh 1.
MIX_SHARE = 0.8
MIX_WEIGHTS = {("domain0",): 3, ("domain1",): 2, ("domain0", "en"): 2}


def _columns() -> list[Column]:
    """The columns of documents by name; n_chars follows the text."""
    return [F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.length("text").cast("long").alias("n_chars")]


def _without(docs: DataFrame, gone: DataFrame, once: bool) -> DataFrame:
    """``docs`` less the rows that ``gone`` (doc_id, th) names by id, which may be null, and hash of the text. With
    ``once``, ``gone`` has ``left`` too, and one of equal rows stays where that is true. Rows that are surely not
    named are not shuffled."""
    gone = settle(gone)
    hashes = settle(gone.select(F.xxhash64("doc_id", "th")))
    keyed = docs.withColumn("th", F.xxhash64("text"))
    named = gone.withColumnsRenamed({"doc_id": "gone_id", "th": "gone_th"})
    maybe, same = among(keyed, F.xxhash64("doc_id", "th"), hashes), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th"))
    out = among(keyed, F.xxhash64("doc_id", "th"), hashes, False).unionAll(maybe.join(named, same, "left_anti"))
    if once:
        stays = maybe.join(named.where("left"), same, "left_semi")
        out = out.unionAll(stays.dropDuplicates(["doc_id", "th"]))
    return out.select(*_columns())


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a known language, with lang as predicted; those without letters, or like none
    of the languages, go: null, empty and blank texts do. Profiles are learned from all documents that name their
    language. Every row is judged by itself, so repeated rows and rows with a null or repeated id stay or go by their
    own text; a null source stays null; columns other than those of documents are dropped; no documents give none."""
    told = identify_language(docs, language_profiles(docs), keep=("text", "source"))
    told = told.where(F.col("lang_pred") != "und").where(F.col("score") >= LEAST_LANGUAGE_SCORE)
    return told.withColumnRenamed("lang_pred", "lang").select(*_columns())


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has; documents that lose all their words to it go, as do those without a
    word. Rows with one id and one text lose the same lines; other rows with a repeated or null id are documents of
    their own. Columns other than those of documents are dropped; no documents give none."""
    kept = dedup_lines(docs.select(*COLUMNS))
    kept = kept.where(F.col("n_words") > F.col("n_words_dropped"))
    return kept.select(*_columns())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8.

    Every row is a document, whatever its id: rows with one id and unlike texts all stay. Of a group the row with the
    least id stays (ids before nulls, then by hash of the text), of equal rows one. Texts without words are in no
    group and stay. Columns other than those of documents are dropped; no documents give none."""
    told = settle(near_duplicate_rows(docs))
    several = told.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th", "row")
    chosen = told.join(several, "component").groupBy("component").agg(F.min(order).alias("first"))
    grouped = settle(join_in_parts(told, chosen, ["component"], ["row"], several, told.count()))
    stays = F.col("row") == F.col("first.row")
    gone = grouped.groupBy("doc_id", "th").agg(F.max(stays).alias("left"), F.count_if(~stays).alias("n")).where("n > 0")
    return _without(docs, gone.select("doc_id", "th", "left"), once=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Every row is judged by its own text, whatever its id;
    null and empty texts hold none and stay. Columns other than those of documents are dropped; no documents give none."""
    told = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, told.where("contaminated").select("doc_id", F.col("text_hash").alias("th")).distinct(), once=False)


def domain_of(source: str) -> Column:
    """A domain for each source: its number modulo 4."""
    return F.concat(F.lit("domain"), F.try_mod(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(4)).cast("string"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, n_tokens, n_taken): what the mix takes, a row for each epoch.

    Documents with a null id or without tokens can't be taken; null languages and sources are a node named ``null``;
    repeated rows and ids are taken one by one; other columns are ignored; no documents give none."""
    taken = mix(docs, domain_of("source"), F.col("lang"), F.col("source"), MIX_WEIGHTS, share=MIX_SHARE)
    return taken.select("doc_id", "epoch", "domain", F.col("language").alias("lang"), "source", "n_tokens", "n_taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The language stage and its learned profiles have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Which edition of the terms applies: interval join, as-of join with deferred starts, drift and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covers_product(product: Column, included: str = "included", excluded: str = "excluded") -> Column:
    """Exclusions win; an empty list of included products means all."""
    return ~F.array_contains(excluded, product) & ((F.size(included) == 0) | F.array_contains(included, product))


def valid_on(facts: DataFrame, versions: DataFrame, day: str) -> DataFrame:
    """Adds the ``version`` whose half-open interval holds ``day`` (YYYYMMDD text, compared as text).

    Editions are few and go to all tasks; without that, facts are read once for each partition of editions, or broadcast themselves.
    """
    spans = F.broadcast(versions.select("version", "effective_to"))
    return facts.join(spans, (F.col("version") <= F.col(day)) & (F.col(day) < F.col("effective_to"))).drop("effective_to")


def starts_by_product(versions: DataFrame, products: DataFrame) -> DataFrame:
    """(product, starts): the starts of all versions for each product, in order. A version starts on its
    deferred date for the products of its provision and on its effective date for the others."""
    start = F.when(F.col("applies_from").isNotNull() & covers_product(F.col("product")), F.col("applies_from")).otherwise(F.col("version"))
    rows = products.select("product").distinct().crossJoin(versions).select("product", F.struct(start.alias("start"), "version").alias("s"))
    return rows.groupBy("product").agg(F.sort_array(F.collect_list("s")).alias("starts"))


def valid_for(facts: DataFrame, versions: DataFrame, product: str, day: str) -> DataFrame:
    """Adds the last ``version`` that had started for ``product`` on ``day``, null where none had.

    The editions travel as one array in one row, so the facts are read once and not shuffled.
    """
    edition = F.struct("version", "applies_from", "included", "excluded")
    editions = versions.agg(F.collect_list(edition).alias("editions"))
    deferred = lambda v: v["applies_from"].isNotNull() & ~F.array_contains(v["excluded"], F.col(product)) & ((F.size(v["included"]) == 0) | F.array_contains(v["included"], F.col(product)))
    starts = F.transform("editions", lambda v: F.struct(F.when(deferred(v), v["applies_from"]).otherwise(v["version"]).alias("start"), v["version"].alias("version")))
    last = F.array_max(F.filter(starts, lambda s: s["start"] <= F.col(day)))
    return facts.crossJoin(editions).withColumn("version", last["version"]).drop("editions")


def version_drift(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """(product, day, calendar, for_product): pairs (product, day) where the calendar picks another version than the product."""
    both = valid_for(pairs, versions, "product", "day").withColumnRenamed("version", "for_product")
    both = valid_on(both, versions, "day").withColumnRenamed("version", "calendar")
    return both.where(~F.col("calendar").eqNullSafe(F.col("for_product"))).select("product", "day", "calendar", "for_product")


def content_islands(revisions: DataFrame, key: list[str], order: list[str], content: str, revision: str) -> DataFrame:
    """Folds consecutive revisions of equal content: (key, content, effective_from, effective_to, revisions).

    effective_to is the next island's start; the last island is open (99991231)."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.coalesce((F.lag(content).over(w) != F.col(content)).cast("int"), F.lit(1))
    rows = revisions.withColumn("changed", changed)
    rows = rows.withColumn("island", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    folded = rows.groupBy(*key, "island", content).agg(F.min(order[0]).alias("effective_from"), F.sort_array(F.collect_list(revision)).alias("revisions"))
    after = F.lead("effective_from").over(Window.partitionBy(*key).orderBy("island"))
    return folded.withColumn("effective_to", F.coalesce(after, F.lit("99991231"))).drop("island")


def lineage(rows: DataFrame, key: list[str], order: str, uid: str) -> DataFrame:
    """Adds ``supersedes``: the uid of the row before in the order of its key."""
    return rows.withColumn("supersedes", F.lag(uid).over(Window.partitionBy(*key).orderBy(order)))


def changed_texts(articles: DataFrame, key: list[str], order: str) -> DataFrame:
    """Articles whose text differs from that of the version before, with both lengths."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = articles.withColumn("old", F.lag("text").over(w)).where("old is not null and text <> old")
    return rows.select(*key, order, F.length("old").alias("old_length"), F.length("text").alias("new_length"))


def page_spans(starts: DataFrame, group: str, order: str, page: str, last: int) -> DataFrame:
    """Adds ``page_end``: the page on which the next one of the group starts, its own at least; ``last`` for the last."""
    after = F.lead(page).over(Window.partitionBy(group).orderBy(page, order))
    return starts.withColumn("page_end", F.greatest(F.col(page), F.coalesce(after, F.lit(last).cast("long"))))

"""Mixing sources to target weights: budgets down a domain-language-source tree, then token prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.llm.common import settle

#: Leading hexadecimal digits of the order key that make a bucket: 4,096 prefix sums a leaf and epoch.
_DIGITS = 3


def count_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("long")


def _filled(children: DataFrame, parent: list[str]) -> DataFrame:
    """Splits each parent's ``budget`` among its children by ``weight``, none above its ``capacity``.

    What a full child can't take goes to its siblings by weight. In order of capacity a weight, the
    tokens a unit of weight that are left for a child and those after it rise while children are full
    and fall from there on, so their maximum is the level that all get. ``weight`` and ``capacity`` are
    whole numbers, so the sums don't depend on their order.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "name")
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(done), F.lit(0))) / F.sum("weight").over(rest)
    told = children.withColumn("level", F.greatest(level, F.lit(0.0)))
    share = F.floor(F.max("level").over(Window.partitionBy(*parent)) * F.col("weight")).cast("long")
    return told.withColumn("budget", F.least(share, F.col("capacity"))).drop("level")


def _weighted(nodes: DataFrame, names: list[str], weights: dict[tuple, int]) -> Column:
    """The weight of a node by its path, 1 where none is given."""
    column = F.lit(1)
    for path, w in weights.items():
        if len(path) == len(names):
            column = F.when(F.concat_ws("\x1f", *names) == "\x1f".join(path), w).otherwise(column)
    return column.cast("long")


def leaf_budgets(leaves: DataFrame, total: int | None, share: float, epochs: int, weights: dict[tuple, int]) -> DataFrame:
    """(domain, language, source, tokens, budget) from the tokens of each leaf.

    The tree's root gets ``total`` tokens, or ``share`` of all there are. Each level splits what a node
    got by the weights of its children; a node can take ``epochs`` times its tokens at most. A leaf's
    shortage is made up by its siblings, and only what they all can't take moves to the siblings of the
    parent, since a parent's capacity is the sum of its children's.
    """
    paths = ["domain", "language", "source"]
    leaves = settle(leaves.groupBy(*paths).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    level = leaves.groupBy().agg(F.sum("tokens").alias("all"))
    budget = F.lit(total).cast("long") if total is not None else F.floor(F.col("all") * share).cast("long")
    above = level.select(F.lit(0).alias("root"), budget.alias("budget"))
    for depth in range(1, 4):
        own, up = paths[:depth], paths[: depth - 1] or ["root"]
        nodes = leaves.withColumn("root", F.lit(0)).groupBy("root", *own).agg((F.sum("tokens") * epochs).cast("long").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("name", F.col(own[-1])).withColumn("weight", _weighted(nodes, own, weights))
        above = _filled(nodes.join(above.select(*up, "budget"), up), up).select(*own, "tokens", "budget")
    return above.select(*paths, "tokens", "budget")


def mix(docs: DataFrame, domain: Column, language: Column, source: Column, weights: dict[tuple, int] | None = None, total: int | None = None, share: float = 0.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, domain, language, source, epoch, n_tokens, n_taken, row): what of ``docs`` (doc_id, text) is taken.

    Each leaf's documents are put into a seeded random order, anew in every epoch; its budget takes whole
    epochs first and then the prefix of the next one in tokens: the last document is cut where the budget
    ends (n_taken < n_tokens). ``weights`` gives whole numbers by path, such as {("web",): 3, ("web", "en"): 2};
    other nodes weigh 1. Null domains, languages and sources are a node named ``null``. Documents without
    tokens or with a null id can't be taken; repeated rows are taken one by one. No leaf, no row.
    The order is by a digest of (seed, epoch, doc_id, row), and its sums go by buckets of the digest first, so
    a leaf with most of all documents needs no task of its own.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    mine = docs.select("doc_id", named(domain).alias("domain"), named(language).alias("language"), named(source).alias("source"), count_tokens(F.col("text").cast("string")).alias("n_tokens"))
    mine = settle(mine.where("doc_id is not null and n_tokens > 0"))
    budgets = settle(leaf_budgets(mine.select("domain", "language", "source", F.col("n_tokens").alias("tokens")), total, share, epochs, weights or {}))
    paths = ["domain", "language", "source"]
    twin = F.row_number().over(Window.partitionBy("doc_id", *paths, "n_tokens").orderBy("doc_id"))
    # A leaf's whole epochs, and what is left of its budget in the next.
    turns = budgets.where("budget > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.expr("(budget - 1) div tokens"), F.lit(epochs - 1)).cast("int"))))
    turns = turns.withColumn("left", F.col("budget") - F.col("epoch") * F.col("tokens"))
    rows = mine.withColumn("row", twin).join(turns.drop("tokens", "budget"), paths)
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id", "row").cast("binary")))
    rows = settle(rows.withColumn("bucket", F.substring("digest", 1, _DIGITS)))
    group = [*paths, "epoch"]
    sums = rows.groupBy(*group, "bucket").agg(F.sum("n_tokens").alias("size"))
    sums = sums.withColumn("ahead", F.coalesce(F.sum("size").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    inside = Window.partitionBy(*group, "bucket").orderBy("digest", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, [*group, "bucket"])
    taken = F.least(F.col("n_tokens"), F.col("left") - F.col("ahead") - F.col("within"))
    return placed.withColumn("n_taken", taken).where("n_taken > 0").select("doc_id", *paths, "epoch", "n_tokens", "n_taken", "row")

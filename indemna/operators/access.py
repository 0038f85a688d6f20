"""Product scopes: what a principal may see, applied before any limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def permitted(principals: DataFrame, scopes: DataFrame, products: DataFrame) -> DataFrame:
    """(principal, product): the pairs of ``products`` (product) that each principal may see. An empty scope
    sees nothing; an unrestricted principal sees all."""
    every = principals.where("unrestricted").select("principal").crossJoin(products.select("product").distinct())
    own = principals.where("not unrestricted").select("principal").join(scopes, "principal").join(products.select("product").distinct(), "product", "left_semi")
    return every.unionByName(own.select("principal", "product")).distinct()


def visible_to(rows: DataFrame, principals: DataFrame, scopes: DataFrame, product: str) -> DataFrame:
    """Every row once for each principal that may see its product; rows outside every scope are dropped silently.

    The gate is a join below whatever limit follows."""
    allowed = permitted(principals, scopes, rows.select(F.col(product).alias("product"))).withColumnRenamed("product", product)
    return rows.join(allowed, product)


def gate(rows: DataFrame, principals: DataFrame, scopes: DataFrame, principal: str, product: str) -> DataFrame:
    """The rows (with their asking ``principal``) whose product is in that principal's scope: a semi join."""
    free = principals.where("unrestricted").select(F.col("principal").alias(principal))
    named = scopes.select(F.col("principal").alias(principal), F.col("product").alias(product))
    rows = rows.join(free.withColumn("free", F.lit(True)), principal, "left")
    rows = rows.join(named.distinct().withColumn("named", F.lit(True)), [principal, product], "left")
    return rows.where("free or named").drop("free", "named")


def refuse(requests: DataFrame, principals: DataFrame, scopes: DataFrame, principal: str, product: str) -> DataFrame:
    """Adds ``access``: a product asked for by name outside the scope is refused, not dropped."""
    free = principals.where("unrestricted").select(F.col("principal").alias(principal), F.lit(True).alias("free"))
    named = scopes.select(F.col("principal").alias(principal), F.col("product").alias(product)).distinct().withColumn("named", F.lit(True))
    rows = requests.join(free, principal, "left").join(named, [principal, product], "left")
    return rows.withColumn("access", F.when(F.col("free") | F.col("named"), "GRANTED").otherwise("ACCESS_DENIED")).drop("free", "named")

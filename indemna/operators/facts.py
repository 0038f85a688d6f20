"""Facts of a claim from what was given, written and guessed; triage of disputed terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(claims: DataFrame, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds codes, weak_codes and amount, and drops the institution of treatment abroad.

    ``given`` codes (null if none were) make the ``guessed`` ones weak; ``written`` ones are always kept. Without
    given codes guesses count in full. An amount of 0 or less counts as not given. ``enrich`` adds ``guessed`` to the
    claims, by a dictionary join or a model; without it claims have that column.
    """
    claims = claims if enrich is None else enrich(claims)
    none = F.array().cast("array<string>")
    given = F.coalesce(F.size("given"), F.lit(0)) > 0
    sure = F.array_union(F.coalesce("given", none), "written")
    rows = claims.withColumn("codes", F.when(given, sure).otherwise(F.array_union(sure, "guessed")))
    rows = rows.withColumn("weak_codes", F.when(given, F.array_except("guessed", sure)).otherwise(none))
    rows = rows.withColumn("amount", F.when(F.col("given_amount") > 0, F.col("given_amount")))
    return rows.withColumn("institution", F.when(F.coalesce("abroad", F.lit(False)), None).otherwise(F.col("institution")))


def triage(asked: DataFrame, known: DataFrame, hollow: int) -> DataFrame:
    """Adds ``verdict`` to disputed terms: defined, hollow (known in ``hollow`` places at most), missing or no term."""
    rows = asked.join(known.select("term", "n"), "term", "left")
    return rows.withColumn("verdict", F.when(F.col("term").isNull(), "no term").when(F.col("n").isNull(), "missing").when(F.col("n") <= hollow, "hollow").otherwise("defined"))

"""Amounts of money: literals in texts, and two ways of cutting a product to whole units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of amounts and the least that counts as an amount.
UNITS = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000}
LEAST = 1000


def trunc_double(amount: Column, rate: Column) -> Column:
    """Whole part of the product in doubles."""
    return F.floor(amount.cast("double") * rate).cast("long")


def trunc_exact(amount: Column, rate: Column) -> Column:
    """Whole part of the exact product of a whole amount and a decimal rate."""
    return F.floor(amount.cast("decimal(18,0)") * rate.cast("decimal(9,6)")).cast("long")


def amounts_in(text: Column, pattern: str | None = None, units: dict[str, int] | None = None) -> Column:
    """The amounts written in a text, in order; digits with commas and a unit, ``LEAST`` at least."""
    units = UNITS if units is None else units
    pattern = pattern or f"([0-9,]+)\\s*({'|'.join(units)})?\\s*원"
    digits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda d: F.replace(d, F.lit(","), F.lit("")).try_cast("long"))
    scale = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda u: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), u), F.lit(1)).cast("long"))
    return F.filter(F.zip_with(digits, scale, lambda a, b: F.try_multiply(a, b)), lambda x: x >= LEAST)

"""Keys of the property graph's vertices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_uid(product: str, version: str, number: str) -> Column:
    return F.concat_ws("|", version, product, number)


def item_uid(article: str, item: str) -> Column:
    return F.concat(F.col(article), F.lit("#"), F.col(item).cast("string"))


def coverage_uid(article: str, coverage: str) -> Column:
    return F.concat(F.col(article), F.lit("#"), F.col(coverage))


def provision_uid(version: str, ordinal: str) -> Column:
    return F.concat(F.col(version), F.lit("|provision|"), F.col(ordinal).cast("string"))


def table_item_uid(article: str, coverage: str, paragraph: str, number: str) -> Column:
    return F.concat(coverage_uid(article, coverage), F.lit("-"), F.col(paragraph).cast("string"), F.lit("-"), F.col(number).cast("string"))


def number_order(number: str) -> list[Column]:
    """Sort keys of an article number such as ``5`` or ``5의2``: by the number before the suffix, then as text."""
    return [F.split(number, "의")[0].try_cast("int"), F.col(number)]

"""What a turn of a conversation says that the claim, as it stood then, doesn't know yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.functions import benefits, codes, receipts
from indemna.functions.money import amounts_in

#: Forms of days in hospital and of dates, and words that speak of what was paid before.
DAYS = "([0-9]{1,3})\\s*일\\s*(?:간\\s*)?입원"
DATE = "([0-9]{4})[.\\-/년]\\s*([0-9]{1,2})[.\\-/월]\\s*([0-9]{1,2})"
HISTORY = ("이미 받", "기지급", "작년", "올해", "지난번", "전에 받", "누적")


def as_it_stood(turns: DataFrame, revisions: DataFrame, key: str, order: str, to: str = "claim") -> DataFrame:
    """``turns`` with the last of ``revisions`` (key, order, ...) at or before each, as a struct; null before the first.

    Both are put in one order for each key, and the last revision is carried forward, so no turn is compared with every revision.
    """
    fields = [c for c in revisions.columns if c not in (key, order)]
    stood = revisions.select(key, order, F.lit(0).alias("is_turn"), F.struct(*fields).alias("r"), F.lit(None).cast(turns.select(F.struct("*").alias("t")).schema["t"].dataType).alias("t"))
    said = turns.select(key, order, F.lit(1).alias("is_turn"), F.lit(None).cast(stood.schema["r"].dataType).alias("r"), F.struct("*").alias("t"))
    w = Window.partitionBy(key).orderBy(order, "is_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = stood.unionByName(said).withColumn("r", F.last("r", ignorenulls=True).over(w))
    return both.where("is_turn = 1").select("t.*", F.col("r").alias(to))


def carved_kinds(rows: DataFrame, text: str, to: str, product: str = "product") -> DataFrame:
    """Adds ``to``: the items of ``text`` that the row's product deals with elsewhere or not at all. Every distinct text is read once."""
    told = benefits.treatment_items(rows.select(F.col(text).alias("_of")).distinct(), "_of", "_items").select("_of", F.transform("_items", lambda x: x["item"]).alias("_items"))
    rules = {}
    for name, item, _, _ in benefits.CARVED:
        rules.setdefault(name, []).append(item)
    mine = F.lit(None).cast("array<string>")
    for name, items in rules.items():
        mine = F.when(F.col(product) == name, F.array(*map(F.lit, items))).otherwise(mine)
    rows = rows.join(told, F.col(text).eqNullSafe(F.col("_of")), "left")
    return rows.withColumn(to, F.coalesce(F.array_intersect("_items", mine), F.array().cast("array<string>"))).drop("_of", "_items")


def new_facts(turns: DataFrame, text: str = "text", claim: str = "claim", to: str = "facts") -> DataFrame:
    """Adds ``to``: the kinds of facts of a turn that would change what its ``claim`` was judged by, in this order: "paid this year" or
    "amount", "code", "days", "date", "treatment", "noncovered", "covered", "institution", "copay".

    Only what differs from what the claim knew counts, so asking back after a known value is none. Known amounts are those claimed and
    paid and all that its narrative has. Institutions count only where the claim has one from a receipt and wasn't treated abroad. ``claim`` is a struct of product,
    claimed_amount, room_charge, paid_this_year, self_paid_this_year, narrative, treatment, codes, hospital_days, enrolled_on, incident_on
    (yyyyMMdd), institution, abroad, copay_rate; without a claim, or a text, no fact is new.
    """
    c = lambda name: F.col(f"{claim}.{name}")
    rows = turns.withColumn("_product", c("product")).withColumn("_known", c("treatment"))
    rows = carved_kinds(carved_kinds(rows, text, "_now", "_product"), "_known", "_before", "_product")
    said = F.col(text)
    known = F.array_union(F.array(c("claimed_amount"), c("room_charge"), c("paid_this_year"), c("self_paid_this_year"), F.lit(0).cast("long")), F.coalesce(amounts_in(c("narrative")), F.array().cast("array<bigint>")))
    fresh = F.size(F.array_except(amounts_in(said), known)) > 0
    history = F.lit(False)
    for word in HISTORY:
        history = history | F.contains(said, F.lit(word))
    days = F.regexp_extract(said, DAYS, 1)
    part = lambda i, n: F.lpad(F.regexp_extract(said, DATE, i), n, "0")
    date = F.concat(part(1, 4), part(2, 2), part(3, 2))
    items = F.array_except("_now", "_before")
    by_receipt = c("institution").isNotNull() & ~F.coalesce(c("abroad"), F.lit(False))
    rates = F.exists(receipts.copay_rates_in(said), lambda x: c("copay_rate").isNull() | (F.abs(x - c("copay_rate").cast("double")) > 1e-9))
    kinds: list[tuple[str, Column]] = [
        ("paid this year", fresh & history),
        ("amount", fresh & ~history),
        ("code", F.size(F.array_except(codes.codes_in(said), c("codes"))) > 0),
        ("days", (days != "") & (days.try_cast("int") != c("hospital_days"))),
        ("date", F.rlike(said, F.lit(DATE)) & ~F.coalesce(date == c("enrolled_on"), F.lit(False)) & ~F.coalesce(date == c("incident_on"), F.lit(False))),
        ("treatment", F.size(F.array_except(items, F.array(F.lit(benefits.NONCOVERED), F.lit(benefits.COVERED)))) > 0),
        ("noncovered", F.array_contains(items, benefits.NONCOVERED)),
        ("covered", F.array_contains(items, benefits.COVERED)),
        ("institution", by_receipt & (F.size(F.array_except(receipts.institutions_in(said), F.array(c("institution")))) > 0)),
        ("copay", rates),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.lit(kind)) for kind, when in kinds]))
    return rows.withColumn(to, F.when(F.col(claim).isNotNull() & said.isNotNull(), found).otherwise(F.array().cast("array<string>"))).drop("_product", "_known", "_now", "_before")


def followup_scores(told: DataFrame, gold: str = "gold", facts: str = "facts", kind: str = "kind") -> DataFrame:
    """(fact, hit, missed, false): how often each kind of facts was found where ``gold`` (array) has it, not found, and found where it hasn't."""
    rows = told.select(F.explode(F.array_union(gold, facts)).alias("fact"), gold, facts)
    has = lambda c: F.array_contains(F.col(c), F.col("fact"))
    return rows.groupBy("fact").agg(F.count_if(has(gold) & has(facts)).alias("hit"), F.count_if(has(gold) & ~has(facts)).alias("missed"), F.count_if(~has(gold) & has(facts)).alias("false"))

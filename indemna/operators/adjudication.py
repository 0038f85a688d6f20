"""From claims to verdicts: screening, rules, amounts with bounds, guardrails, evidence. All set-oriented."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.functions.codes import code_ranges, in_range, stated_reasons
from indemna.functions.money import trunc_double, trunc_exact
from indemna.operators.versions import valid_for

#: Institutions by what their kind decides.
TERTIARY = ("tertiary hospital", "general hospital", "nursing home")
CAP_EXEMPT = ("tertiary hospital", "general hospital")
CAP_UNDECIDABLE = ("nursing home",)
#: Values that may be missing, by the order in which they are named.
INSTITUTION, COPAY, UNDECIDED, VISITS, INSURED, PAID = "institution", "copay rate", "general hospital or not", "visits this year", "sum insured", "paid this year"
SELF_PAID = "self-paid this year"


def _named(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs])).cast("array<string>")


def rule_completeness(rules: DataFrame) -> DataFrame:
    """Adds whether a rule has all it needs for inpatients and for outpatients."""
    limit = F.col("annual_limit").isNotNull() | F.col("limit_from_policy")
    own = F.col("deductible").isNotNull() & F.col("deductible_rate").isNotNull()
    inpatient = F.col("inpatient_rate").isNotNull() & limit & (~F.col("deductible_inpatient") | own)
    return rules.withColumn("for_inpatient", inpatient).withColumn("for_outpatient", F.col("outpatient_rate").isNotNull() & limit & own)


def why_no_rule(claims: DataFrame, rules: DataFrame, carved: DataFrame | str | None = None) -> DataFrame:
    """Adds ``no_rule``: why no rule may be used for a claim although its product has some; null where one may.

    In this order: treated abroad under a product without rules for abroad; diagnoses of injury and of disease together where a rule takes its limit
    from the policy, which states one for each; a treatment that the product deals with elsewhere or not at all (``carved``: claim_id, item, word,
    place, excluded; or the name of a column of ``claims``, an array of item, place, excluded), all of them named by item. ``claims`` has product, abroad, kinds (array).
    """
    elsewhere = lambda excluded, place: F.when(excluded, F.concat(F.lit("not covered by "), place)).otherwise(F.concat(F.lit("dealt with in "), place))
    told = lambda pairs: F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(x["item"], F.lit(": "), x["p"])), "; ")
    about = rules.groupBy("product").agg(F.max("abroad_only").alias("any_abroad"), F.max("limit_from_policy").alias("any_policy"))
    rows = claims.join(F.broadcast(about), "product", "left")
    if carved is None:
        rows = rows.withColumn("carved", F.lit(None).cast("string"))
    elif isinstance(carved, str):
        pairs = F.array_distinct(F.transform(carved, lambda x: F.struct(x["item"].alias("item"), elsewhere(x["excluded"], x["place"]).alias("p"))))
        rows = rows.withColumn("carved", F.when(F.size(carved) > 0, told(pairs)))
    else:
        named = carved.groupBy("claim_id").agg(told(F.collect_set(F.struct("item", elsewhere(F.col("excluded"), F.col("place")).alias("p")))).alias("carved"))
        rows = rows.join(named, "claim_id", "left")
    why = F.when(F.col("abroad") & ~F.col("any_abroad"), "treated abroad").when(F.col("any_policy") & (F.size("kinds") > 1), "injury and disease together").otherwise(F.col("carved"))
    return rows.withColumn("no_rule", why).drop("any_abroad", "any_policy", "carved")


def rule_lookup(claims: DataFrame, rules: DataFrame, hint: str = "hint", kind: str = "kind") -> DataFrame:
    """Adds the columns of the rule that applies, null where none does.

    A claim from abroad takes rules for abroad only, and none where the product has no such rule; other
    claims take the others. Of those that are left: the one that ``hint`` names, else the only one, else the only
    one whose coverage is the claim's ``kind``. A hint that names no coverage says nothing. What can be asked is a small table of its own (product, abroad,
    hint, kind), made once from the rules, so claims are joined by equality and not compared with every rule; it and the rules go to the claims, which aren't shuffled. Where ``claims``
    have ``no_rule`` (see ``why_no_rule``), a reason there keeps every rule away, also the one that is named.
    """
    names = rules.select("coverage").distinct()
    asked = rules.select("product").distinct().crossJoin(claims.sparkSession.createDataFrame([(True,), (False,)], "abroad boolean"))
    asked = asked.crossJoin(names.select(F.col("coverage").alias(hint)).unionAll(names.limit(1).select(F.lit(None).cast("string")))).crossJoin(claims.sparkSession.createDataFrame([("injury",), ("disease",), (None,)], f"{kind} string"))
    usable = asked.join(rules.select("product", "coverage", "abroad_only"), "product").where(F.col("abroad") == F.col("abroad_only"))
    by = ["product", "abroad", hint, kind]
    exact = F.max(F.when(F.col(hint) == F.col("coverage"), F.col("coverage")))
    same = F.col("coverage") == F.col(kind)
    only = F.when(F.count("*") == 1, F.max("coverage")).when(F.count_if(same) == 1, F.max(F.when(same, F.col("coverage"))))
    chosen = usable.groupBy(*by).agg(F.coalesce(exact, only).alias("coverage"))
    known = claims.join(F.broadcast(names.select(F.col("coverage").alias("named"))), F.col(hint) == F.col("named"), "left").drop(hint).withColumnRenamed("named", hint)
    left, right = known.alias("c"), F.broadcast(chosen).alias("r")
    match = (F.col("c.product") == F.col("r.product")) & (F.coalesce("c.abroad", F.lit(False)) == F.col("r.abroad")) & F.col(f"c.{hint}").eqNullSafe(F.col(f"r.{hint}")) & F.col(f"c.{kind}").eqNullSafe(F.col(f"r.{kind}"))
    if "no_rule" in claims.columns:
        match = match & F.col("c.no_rule").isNull()
    found = left.join(right, match, "left").select("c.*", "r.coverage")
    return found.join(F.broadcast(rules), ["product", "coverage"], "left")


def deductible(claims: DataFrame) -> DataFrame:
    """Adds ``off`` and ``off_missing``: the greatest of the flat term by kind of institution, the amount's share and
    the share by the co-payment rate. What isn't known is left out and named: the amount is then an upper bound."""
    flat = F.when(F.col("deductible_tertiary").isNotNull() & F.col("institution").isin(*TERTIARY), F.col("deductible_tertiary")).otherwise(F.coalesce("deductible", F.lit(0)))
    share = trunc_exact(F.col("claimed_amount"), F.coalesce("deductible_rate", F.lit(0)))
    copay = F.when(F.col("uses_copay") & F.col("copay_rate").isNotNull(), trunc_exact(F.col("claimed_amount"), F.col("copay_rate"))).otherwise(0)
    missing = _named((F.col("deductible_tertiary").isNotNull() & F.col("institution").isNull(), INSTITUTION), (F.col("uses_copay") & F.col("copay_rate").isNull(), COPAY))
    return claims.withColumn("off", F.greatest(flat.cast("long"), share, copay.cast("long"))).withColumn("off_missing", missing)


def room_charge_paid() -> Column:
    """The extra charge for a room, up to a daily cap, times its rate."""
    days = F.greatest(F.lit(1), "hospital_days")
    recognised = F.when(F.col("room_daily_cap").isNull(), F.col("room_charge")).otherwise(F.least(F.col("room_charge"), F.col("room_daily_cap") * days))
    return trunc_double(recognised, F.coalesce("room_rate", F.lit(0.0)))


def amounts(claims: DataFrame) -> DataFrame:
    """Adds ``payable``, ``computed``, ``missing`` and ``missing_down`` to claims with their rule.

    In order: deductible, rate, cap of a visit, cap of a clinic, room charge, reduction period, number of visits,
    refund beyond the yearly own payment, yearly or policy limit. An unknown value never counts as 0: it leaves its
    term out and makes the amount an upper bound (``missing``) or a lower bound (``missing_down``). Claims
    without amount, date or complete rule aren't computed.
    """
    rows = rule_completeness(claims)
    known = F.col("paid_this_year").isNotNull()
    ready = F.when(F.col("inpatient"), F.col("for_inpatient")).otherwise(F.col("for_outpatient"))
    computed = (F.col("claimed_amount") > 0) & F.col("days_since").isNotNull() & F.col("coverage").isNotNull() & F.coalesce(ready, F.lit(False))
    rows = deductible(rows).withColumn("computed", computed)
    applies = ~F.col("inpatient") | F.col("deductible_inpatient")
    step = F.when(applies, F.greatest(F.lit(0).cast("long"), F.col("claimed_amount") - F.col("off"))).otherwise(F.greatest(F.lit(0).cast("long"), F.col("claimed_amount")))
    rate = F.coalesce(F.when(F.col("inpatient"), F.col("inpatient_rate")).otherwise(F.col("outpatient_rate")), F.lit(0.0))
    rows = rows.withColumn("after_rate", trunc_double(step, rate))
    rows = rows.withColumn("after_visit", F.when(~F.col("inpatient") & (F.col("after_rate") > F.col("visit_limit")), F.col("visit_limit")).otherwise(F.col("after_rate")))
    capped = F.col("inpatient") & F.col("clinic_cap").isNotNull()
    over = F.col("after_visit") > F.col("clinic_cap")
    undecided = F.col("institution").isin(*CAP_UNDECIDABLE)
    rows = rows.withColumn("after_clinic", F.when(capped & F.col("institution").isNotNull() & ~undecided & ~F.col("institution").isin(*CAP_EXEMPT) & over, F.col("clinic_cap")).otherwise(F.col("after_visit")))
    rows = rows.withColumn("after_room", F.col("after_clinic") + F.when(F.col("inpatient") & (F.col("room_charge") > 0) & F.col("room_rate").isNotNull(), room_charge_paid()).otherwise(0))
    reduced = F.col("reduction_days").isNotNull() & F.col("reduction_rate").isNotNull() & (F.col("days_since") < F.col("reduction_days"))
    rows = rows.withColumn("after_period", F.when(reduced, trunc_double(F.col("after_room"), F.col("reduction_rate"))).otherwise(F.col("after_room")))
    counted = ~F.col("inpatient") & F.col("annual_visits").isNotNull()
    rows = rows.withColumn("after_visits", F.when(counted & known & (F.col("visits_this_year") >= F.col("annual_visits")), 0).otherwise(F.col("after_period")).cast("long"))
    refunding = F.col("inpatient") & F.col("self_pay_cap").isNotNull()
    own = F.col("claimed_amount") - F.col("after_visits")
    refund = F.greatest(F.lit(0).cast("long"), F.least(own, F.col("self_paid_this_year") + own - F.col("self_pay_cap")))
    own_known = known & F.col("self_paid_this_year").isNotNull()
    rows = rows.withColumn("after_refund", F.col("after_visits") + F.when(refunding & own_known, refund).otherwise(0))
    from_policy = F.col("limit_from_policy") & F.col("annual_limit").isNull()
    insured = F.col("sum_insured") > 0
    limit = F.when(from_policy, F.when(insured, F.col("sum_insured"))).otherwise(F.col("annual_limit"))
    left = F.greatest(F.lit(0).cast("long"), limit - F.coalesce("paid_this_year", F.lit(0)))
    rows = rows.withColumn("limited", F.when(limit.isNull(), F.col("after_refund")).otherwise(F.least("after_refund", left)))
    first = F.when(applies, F.col("off_missing")).otherwise(F.array().cast("array<string>"))
    later = _named(
        (capped & F.col("institution").isNull() & ~F.array_contains(first, INSTITUTION), INSTITUTION),
        (capped & undecided & over, UNDECIDED),
        (counted & ~known, VISITS),
        (from_policy & ~F.coalesce(insured, F.lit(False)), INSURED),
        (~known, PAID),
    )
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "payable": F.when(computed, F.col("limited")).otherwise(0).cast("long"),
            "missing": F.when(computed, F.concat(first, later)).otherwise(none),
            "missing_down": F.when(computed, _named((refunding & ~own_known, SELF_PAID))).otherwise(none),
        }
    )


#: Ways in which a clause is met, by rank.
WAYS = ("code", "weak", "reason", "word")
#: Least letters of a word of a clause that is looked for.
_LEAST = 4


def _outside_words(content: str, least: int) -> Column:
    outside = F.regexp_replace(F.lower(content), "[(][^()]*(unless|but only|except)[^()]*[)]", " ")
    return F.array_distinct(F.regexp_extract_all(outside, F.lit("[a-z]{%d,}" % least), F.lit(0)))


def clause_words(clauses: DataFrame, on: list[str], distinctive: DataFrame | None = None, least: int = _LEAST) -> DataFrame:
    """(on, clause_uid, word): the words of each clause outside its provisos, of ``least`` letters or more; of these only
    the ``distinctive`` (term) ones, if given."""
    words = clauses.select(*on, "clause_uid", F.explode(_outside_words("content", least)).alias("word"))
    return words if distinctive is None else words.join(distinctive.select(F.col("term").alias("word")).distinct(), "word", "left_semi")


def _said(claims: DataFrame, words: DataFrame, on: list[str], text: str) -> DataFrame:
    """(claim_id, clause_uid, word): the words (on, clause_uid, word) of a claim's ``on`` that its text holds.

    What the clauses of one ``on``, an edition of a product, say is one array; a claim meets it once and keeps what it holds, so its text is neither copied nor shuffled
    for each word.
    """
    listed = words.groupBy(*on).agg(F.collect_list(F.struct("clause_uid", "word")).alias("words"))
    rows = claims.select("claim_id", *on, F.lower(text).alias("said")).where("said is not null").join(F.broadcast(listed), on)
    return rows.select("claim_id", F.explode(F.filter("words", lambda w: F.contains(F.col("said"), w["word"]))).alias("w")).select("claim_id", "w.clause_uid", "w.word")


def listed_clauses(clauses: DataFrame, on: list[str], distinctive: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(on, listed): of every ``on``, an edition of a product, an array of its clauses in order of their uid, each with the ranges, reasons and words by which a claim
    may meet it, and what the ``exceptions`` (clause_uid, exception_uid) of its provisos are."""
    words = _outside_words("content", _LEAST) if distinctive is None else F.array().cast("array<string>")
    told = clauses.select(*on, "clause_uid", code_ranges("content").alias("ranges"), stated_reasons(F.col("content")).alias("reasons"), words.alias("words"))
    if distinctive is not None:
        own = clause_words(clauses, on, distinctive).groupBy(*on, "clause_uid").agg(F.collect_set("word").alias("own"))
        told = told.join(own, [*on, "clause_uid"], "left").withColumn("words", F.coalesce("own", "words")).drop("own")
    all_ = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    told = told.groupBy(*on, "clause_uid").agg(all_("ranges"), all_("reasons"), all_("words"))
    if exceptions is None:
        told = told.withColumn("exceptions", F.array().cast("array<string>"))
    else:
        opened = exceptions.groupBy("clause_uid").agg(F.sort_array(F.collect_set("exception_uid")).alias("exceptions"))
        told = told.join(opened, "clause_uid", "left").withColumn("exceptions", F.coalesce("exceptions", F.array().cast("array<string>")))
    return told.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("clause_uid", "ranges", "reasons", "words", "exceptions"))).alias("listed"))


def with_clauses_met(claims: DataFrame, clauses: DataFrame, distinctive: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """Adds ``met``, an array of (clause_uid, way, exceptions) in order of the uid: every clause of the claim's product and version that it meets, by its first way (see
    ``screen``). The clauses of an edition are one array that comes to the claim, so nothing of a claim is copied or shuffled; the work
    for a claim grows with the clauses of one edition."""
    on = ["product", "version"]
    none = F.array().cast("array<string>")
    sure, weak = F.coalesce("codes", none), F.coalesce("weak_codes", none)

    def way(c: Column, said: Column) -> Column:
        whole = lambda x: F.substring(x, 2, 2) == F.lpad(F.substring(x, 2, 2).try_cast("int").cast("string"), 2, "0")
        coded = lambda own: F.exists(own, lambda x: F.exists(c["ranges"], lambda r: in_range(x, r)) & whole(x))
        stated = lambda own: F.exists(own, lambda x: F.exists(c["reasons"], lambda r: (F.substring(x, 1, 1) == r["letter"]) & F.substring(x, 2, 2).try_cast("int").between(r["lo"], r["hi"])) & whole(x))
        return F.when(coded(sure), 0).when(coded(weak), 1).when(stated(F.concat(sure, weak)), 2).when(F.exists(c["words"], lambda w: F.contains(said, w)), 3)

    asked = lambda said: F.filter(F.transform("listed", lambda c: F.struct(c["clause_uid"].alias("clause_uid"), way(c, said).alias("way"), c["exceptions"].alias("exceptions"))), lambda m: m["way"].isNotNull())
    # An array of one text, so that it is lower-cased once for all clauses.
    met = F.flatten(F.transform(F.array(F.lower("narrative")), asked))
    rows = claims.join(F.broadcast(listed_clauses(clauses, on, distinctive, exceptions)), on, "left")
    return rows.withColumn("met", F.coalesce(met, F.array().cast("array<struct<clause_uid:string,way:int,exceptions:array<string>>>"))).drop("listed")


def screen(claims: DataFrame, clauses: DataFrame, distinctive: DataFrame | None = None) -> DataFrame:
    """(claim_id, clause_uid, certain, via): every clause of the claim's product and version that it meets.

    Of each clause the first that holds: a documented code in its ranges (certain), a code that was only read
    (weak), a code that states the clause's reason (reason), a word of it that the narrative holds
    (word). ``claims`` has claim_id, product, version, codes, weak_codes, narrative; ``distinctive`` limits the words.
    Rows of one claim_id are one claim, which meets what any of them does.
    """
    hits = with_clauses_met(claims, clauses, distinctive).select("claim_id", F.explode("met").alias("m")).select("claim_id", "m.clause_uid", "m.way")
    best = hits.groupBy("claim_id", "clause_uid").agg(F.min("way").alias("way"))
    return best.select("claim_id", "clause_uid", (F.col("way") == 0).alias("certain"), F.element_at(F.array(*map(F.lit, WAYS)), F.col("way") + 1).alias("via"))


def word_overlap(claims: DataFrame, clauses: DataFrame, on: list[str], text: str = "narrative", distinctive: DataFrame | None = None) -> DataFrame:
    """(claim_id, clause_uid, word): for every clause of a claim's ``on`` the longest word outside its provisos that
    occurs in the claim's text, the first in alphabetical order of equal ones; none, no row."""
    best = F.min(F.struct((-F.length("word")).alias("n"), "word"))["word"]
    return _said(claims, clause_words(clauses, on, distinctive), on, text).groupBy("claim_id", "clause_uid").agg(best.alias("word"))


def guardrails(drafts: DataFrame) -> DataFrame:
    """Demotes ``decision`` and sets ``amount`` to 0 where a verdict may not stand; names what fired.

    ``drafts`` has decision, amount, grounded, computed, uncertain, is_upper, is_lower, pii. Each rule sees the
    decision that the ones before have left; a demoted verdict is never raised again. Drafts with a ``reason`` (and ``missing``,
    ``missing_down``) get the guardrail's in its place.
    """
    reasons = {}
    if "reason" in drafts.columns:
        named = lambda c: F.concat_ws(", ", c)
        reasons = {
            "grounding_gate": F.lit("no clause to point at"),
            "amount_not_computed": F.concat(F.lit("amount not computed: "), "reason"),
            "uncertain_exclusion": F.lit("an exclusion may apply"),
            "amount_upper_bound": F.concat(F.lit("an upper bound without "), named("missing")),
            "amount_lower_bound": F.concat(F.lit("a lower bound without "), named("missing_down")),
        }
    rows = drafts.withColumn("fired", F.when(F.col("pii"), F.array(F.lit("pii_masked"))).otherwise(F.array()).cast("array<string>"))
    pays = F.col("decision").isin("PAID", "PARTIAL")
    for name, when, to in (
        ("grounding_gate", F.col("decision").isin("PAID", "PARTIAL", "DENIED") & ~F.col("grounded"), "NEEDS_DOCS"),
        ("amount_not_computed", pays & ~F.col("computed"), "HUMAN_REVIEW"),
        ("uncertain_exclusion", pays & F.col("uncertain"), "HUMAN_REVIEW"),
        ("amount_upper_bound", pays & F.col("is_upper"), "HUMAN_REVIEW"),
        ("amount_lower_bound", pays & F.col("is_lower"), "HUMAN_REVIEW"),
    ):
        rows = rows.withColumn("now", F.coalesce(when, F.lit(False)))
        rows = rows.withColumns(
            {
                "fired": F.when(F.col("now"), F.array_append("fired", F.lit(name))).otherwise(F.col("fired")),
                "amount": F.when(F.col("now"), 0).otherwise(F.col("amount")).cast("long"),
                "decision": F.when(F.col("now"), to).otherwise(F.col("decision")),
                **({"reason": F.when(F.col("now"), reasons[name]).otherwise(F.col("reason"))} if reasons else {}),
            }
        ).drop("now")
    return rows


#: What a verdict shows: so many coverage articles and uncertain clauses, and so many in all.
SHOWN, MOST = 2, 6


def _first(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def _gathered(rows: DataFrame, by: list[str]) -> DataFrame:
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "role", "uid"))).alias("e"))
    return listed.select(*by, F.transform("e", lambda x: F.struct(x["role"].alias("role"), x["uid"].alias("uid"))).alias("evidence"))


def evidence_rows(hits: DataFrame, coverages: DataFrame, exceptions: DataFrame, shown: int = SHOWN, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """What verdicts point at, as two tables of (uid, role) arrays in order: by claim_id what was hit, by (product, version) what covers.

    Of a claim with certain ``hits`` (claim_id, clause_uid, certain): these, then the ``exceptions`` (clause_uid, exception_uid) of their
    provisos. Of others: the first ``shown`` uncertain ones, then their exceptions. Of an edition: its first ``shown`` ``coverages``. Each by uid;
    none keeps more than ``most``, so however many clauses meet, what is gathered for a claim is small.
    """
    some = hits.groupBy("claim_id").agg(F.max("certain").alias("any_certain"))
    used = hits.join(some, "claim_id").where(F.col("certain") == F.col("any_certain"))
    used = _first(used, ["claim_id"], ["clause_uid"], most).where(F.col("certain") | (F.col("place") <= shown))
    own = used.select("claim_id", F.col("place").alias("nth"), F.lit(0).alias("turn"), F.col("clause_uid").alias("uid"), F.when(F.col("certain"), "exclusion").otherwise("uncertain").alias("role"))
    open_ = used.join(exceptions, "clause_uid").groupBy("claim_id", F.col("exception_uid").alias("uid")).agg(F.min("place").alias("nth")).withColumns({"turn": F.lit(1), "role": F.lit("exception")})
    both = _first(own.unionByName(open_), ["claim_id"], ["turn", "nth", "uid"], most)
    return _gathered(both, ["claim_id"]), covering(coverages, shown)


def covering(coverages: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(product, version, evidence): of each edition of a product its first ``shown`` coverage articles."""
    rows = coverages.select("product", "version", F.col("article_uid").alias("uid"), F.lit("coverage").alias("role"))
    return _gathered(_first(rows, ["product", "version"], ["uid"], shown), ["product", "version"])


def evidence_met(met: str, shown: int = SHOWN, most: int = MOST) -> Column:
    """The (role, uid) array that ``evidence_rows`` has for a claim, from the clauses that it has ``met`` (see ``with_clauses_met``)."""
    certain = F.filter(met, lambda m: m["way"] == 0)
    used = F.when(F.size(certain) > 0, F.slice(certain, 1, most)).otherwise(F.slice(met, 1, shown))
    own = F.transform(used, lambda m: F.struct(F.when(m["way"] == 0, "exclusion").otherwise("uncertain").alias("role"), m["clause_uid"].alias("uid")))
    opened = F.transform(F.array_distinct(F.flatten(F.transform(used, lambda m: m["exceptions"]))), lambda e: F.struct(F.lit("exception").alias("role"), e.alias("uid")))
    return F.slice(F.concat(own, opened), 1, most)


def draft(claims: DataFrame, versions: DataFrame, coverages: DataFrame, clauses: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, carved: DataFrame | str | None = None) -> DataFrame:
    """Claims with version, what screening found of how many clauses, rule or why none, amount, evidence, and the decision with its reason before the
    guardrails. ``exceptions`` (clause_uid, exception_uid) are what the provisos of clauses point at, ``carved`` treatments that products deal with elsewhere
    (see ``why_no_rule``)."""
    rows = with_clauses_met(valid_for(claims, versions, "product", "enrolled_on"), clauses, exceptions=exceptions)
    covered = coverages.groupBy("product", "version").agg(F.count("*").alias("n_coverages")).join(covering(coverages).withColumnRenamed("evidence", "covers"), ["product", "version"])
    considered = clauses.groupBy("product", "version").agg(F.count("*").alias("considered"))
    rows = rows.join(F.broadcast(covered), ["product", "version"], "left").join(F.broadcast(considered), ["product", "version"], "left").fillna(0, ["n_coverages", "considered"])
    unsure = F.filter("met", lambda m: m["way"] != 0)
    rows = rows.withColumns(
        {
            "n_certain": F.size(F.filter("met", lambda m: m["way"] == 0)).cast("long"),
            "n_uncertain": F.size(unsure).cast("long"),
            "first_uncertain": F.get(unsure, F.lit(0))["clause_uid"],
            "evidence": evidence_met("met"),
        }
    ).drop("met")
    rows = rows.withColumn("hint", F.split("first_uncertain", "#")[1])
    rows = amounts(rule_lookup(why_no_rule(rows, rules, carved), rules))
    # The cases in their order; what an earlier one ends is neither screened nor computed.
    no_version, no_cover = F.col("version").isNull(), F.col("n_coverages") == 0
    denied = ~no_version & ~no_cover & (F.col("n_certain") > 0)
    judged = ~no_version & ~no_cover & ~denied
    decision = F.when(no_version | no_cover, "NEEDS_DOCS").when(denied, "DENIED").when(F.col("payable") < F.col("claimed_amount"), "PARTIAL").otherwise("PAID")
    basis = F.when(F.col("computed"), F.concat_ws("/", "product", "coverage")).otherwise(F.coalesce("no_rule", F.lit("no complete rule")))
    none = F.array().cast("array<struct<role:string,uid:string>>")
    hit = F.coalesce("evidence", none)
    shown = F.slice(F.when(denied, hit).when(judged, F.concat(F.coalesce("covers", none), hit)).otherwise(none), 1, MOST)
    rows = rows.withColumns(
        {
            "decision": decision,
            "evidence": shown,
            "reason": F.when(no_version, "no edition applies").when(no_cover, "no coverage article").when(denied, F.concat(F.lit("excluded by "), hit[0]["uid"])).otherwise(basis),
        }
    )
    return rows.withColumns(
        {
            "amount": F.when(judged, F.col("payable")).otherwise(0).cast("long"),
            "grounded": F.exists("evidence", lambda e: F.coalesce(e["uid"], F.lit("")) != ""),
            "computed": F.col("computed") | denied,
            "uncertain": judged & (F.col("n_uncertain") > 0),
            "is_upper": judged & (F.size("missing") > 0),
            "is_lower": judged & (F.size("missing_down") > 0),
            "pii": F.rlike(F.coalesce("narrative", F.lit("")), F.lit("[0-9]{6}-[1-4][0-9]{6}")),
        }
    )


def adjudicate(claims: DataFrame, versions: DataFrame, coverages: DataFrame, clauses: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, carved: DataFrame | str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(claim_id, product, version, decision, amount, fired, reason, evidence, considered, keep): one verdict for each claim, through all guardrails once, and columns of
    the claims to ``keep``. Terms, rules and coverages go to the claims; no claim is shuffled, unless ``carved`` is a table."""
    rows = guardrails(draft(claims, versions, coverages, clauses, rules, exceptions, carved))
    return rows.select("claim_id", "product", "version", "decision", "amount", "fired", "reason", "evidence", "considered", *keep)


def answer_material(verdicts: DataFrame, limit: int = 3) -> DataFrame:
    """(claim_id, decision, clauses, coverages, exceptions, missing): what an answer to a question about a verdict may be made of.

    Up to ``limit`` uids of each role of its evidence, in its order: clauses that exclude or might, coverage articles, and the exceptions that may open the cover again. missing:
    why nothing is paid, the reason and the guardrails that fired; null for a verdict that pays.
    """
    of = lambda *roles: F.transform(F.slice(F.filter("evidence", lambda e: e["role"].isin(*roles)), 1, limit), lambda e: e["uid"])
    why = F.concat_ws("; ", "reason", F.when(F.size("fired") > 0, F.concat(F.lit("guardrails: "), F.concat_ws(", ", "fired"))))
    return verdicts.select("claim_id", "decision", of("exclusion", "uncertain").alias("clauses"), of("coverage").alias("coverages"), of("exception").alias("exceptions"), F.when(~F.col("decision").isin("PAID", "PARTIAL"), why).alias("missing"))


def verdict_agreement(left: DataFrame, right: DataFrame, fields: list[str], key: str = "claim_id") -> DataFrame:
    """(key, differs): the first field in which two runs differ, null where they agree."""
    both = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields]).join(right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields]), key)
    return both.select(key, first_difference({f: (F.col(f"l_{f}"), F.col(f"r_{f}")) for f in fields}).alias("differs"))


def first_difference(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """The first name whose two columns differ, null where all agree; for two runs that stand in one row."""
    out = F.lit(None).cast("string")
    for name, (left, right) in reversed(pairs.items()):
        out = F.when(~left.eqNullSafe(right), name).otherwise(out)
    return out


def contract_history(claims: DataFrame, contract: str, year: Column, order: list[str], amount: str, visit: Column) -> DataFrame:
    """Adds what the contract had before in the year of the claim: paid, visits; null for the first (not 0: unknown)."""
    w = Window.partitionBy(contract, "year").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = claims.withColumn("year", year)
    return rows.withColumn("paid_before", F.sum(amount).over(w)).withColumn("visits_before", F.sum(visit.cast("int")).over(w).cast("long"))


def revise(changes: DataFrame, key: str, order: str, columns: list[str], readjudicated: Column) -> DataFrame:
    """Folds partial updates into the claim as it stands after each: the last given value of every column, and a
    revision number that rises only where the claim is adjudicated anew."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = changes.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return rows.withColumn("revision", F.sum(readjudicated.cast("int")).over(w).cast("long"))

"""Labels, scores, latencies and gates: how well the rest does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (name, pattern) that the text matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def snippet(text: Column, rules: list[tuple[str, str]], around: int = 20) -> Column:
    """The text round the match of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for _, pattern in reversed(rules):
        at = F.regexp_instr(text, F.lit(pattern))
        out = F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - around), F.lit(2 * around))).otherwise(out)
    return out


def outcome_signal(text: Column, predicate: str, positive: str, negation: str, within: int = 30) -> Column:
    """granted, refused or null by the last predicate of a text: what it says, and whether a negation follows it."""
    parts = F.split(text, predicate)
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(f"({predicate})"), F.lit(1)), F.lit(-1))
    after = F.substring(F.element_at(parts, -1), 1, within)
    good = F.rlike(last, F.lit(positive))
    negated = F.rlike(after, F.lit(negation))
    return F.when(last.isNull(), None).when(good != negated, "granted").otherwise("refused")


def combine_signals(title: Column, outcome: Column) -> tuple[Column, Column]:
    """(label, confidence): both agree: high; one alone: medium; they differ: the outcome, low; none: unknown."""
    label = F.coalesce(outcome, title, F.lit("unknown"))
    confidence = F.when(title.isNull() & outcome.isNull(), "none").when(title == outcome, "high").when(title.isNull() | outcome.isNull(), "medium").otherwise("low")
    return label, confidence


def label_accuracy(labels: DataFrame, reference: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, n, right, accuracy) over the rows that both have, by group and in all (null)."""
    both = labels.join(reference.select(key, F.col("label").alias("true")), key)
    right = F.count_if(F.col("label") == F.col("true"))
    return both.rollup(*by).agg(F.count("*").alias("n"), right.alias("right"), F.round(right / F.count("*"), 6).alias("accuracy"))


def confusion(labels: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(true, label, n): pairs of the reference's label and the one given; null on the side that lacks a row."""
    both = labels.join(reference.select(key, F.col("label").alias("true")), key, "full_outer")
    return both.groupBy("true", "label").agg(F.count("*").alias("n"))


def multilabel_scores(predicted: DataFrame, true: DataFrame, key: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall) from tables of (key, label)."""
    p, t = predicted.select(key, "label").distinct().withColumn("p", F.lit(1)), true.select(key, "label").distinct().withColumn("t", F.lit(1))
    both = p.join(t, [key, "label"], "full_outer").fillna(0, ["p", "t"])
    tp, fp, fn = F.sum(F.col("p") * F.col("t")), F.sum(F.col("p") * (1 - F.col("t"))), F.sum((1 - F.col("p")) * F.col("t"))
    rows = both.groupBy("label").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    share = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 6))
    return rows.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn")))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, share, majority): how often each value is, its share, and whether it is the most frequent."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return n.crossJoin(total).select(column, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") == F.col("most")).alias("majority"))


def latency(spans: DataFrame, name: str, ms: str) -> DataFrame:
    """(name, n, p50, p95, p99, total): the interpolated median, nearest ranks (round half even, less one, clamped)."""
    order = Window.partitionBy(name).orderBy(ms)
    rows = spans.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(name)))
    at = lambda p: F.least(F.greatest(F.bround(F.lit(p) / 100 * F.col("n"), 0).cast("long") - 1, F.lit(0)), F.col("n") - 1) + 1
    pick = lambda p: F.max(F.when(F.col("place") == at(p), F.col(ms))).alias(f"p{p}")
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.round(F.median(ms), 6).alias("p50"), pick(95), pick(99), F.round(F.sum(ms), 2).alias("total"))


def regression_gate(baseline: DataFrame, measured: DataFrame, strict: bool = False) -> DataFrame:
    """(metric, base, value, status): PASS or FAIL by direction and tolerance of the baseline, SKIP where nothing was
    measured; a skip isn't a pass, and fails in strict mode."""
    rows = baseline.join(measured, "metric", "left")
    worse = F.when(F.col("higher_is_better"), F.col("base") - F.col("value")).otherwise(F.col("value") - F.col("base"))
    status = F.when(F.col("value").isNull(), "FAIL" if strict else "SKIP").when(worse <= F.col("tolerance"), "PASS").otherwise("FAIL")
    return rows.select("metric", "base", "value", status.alias("status"))


def record(baseline: DataFrame, measured: DataFrame) -> DataFrame:
    """The baseline with what was measured in place; metrics that weren't measured stay."""
    rows = baseline.select("metric", "base").join(measured, "metric", "full_outer")
    return rows.select("metric", F.coalesce("value", "base").alias("base"))


def band_score(predictions: DataFrame) -> DataFrame:
    """(band, n, hit, miss, false_code, correct_none, errors) from (band, true, predicted, failed): arrays of codes."""
    none, said = F.size("true") == 0, F.size("predicted") > 0
    ok = ~F.col("failed")
    hit = F.arrays_overlap("true", "predicted")
    return predictions.groupBy("band").agg(
        F.count("*").alias("n"),
        F.count_if(ok & ~none & hit).alias("hit"),
        F.count_if(ok & ~none & ~hit).alias("miss"),
        F.count_if(ok & none & said).alias("false_code"),
        F.count_if(ok & none & ~said).alias("correct_none"),
        F.count_if("failed").alias("errors"),
    )


def screening_score(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(with_gold, found, false_alarms, mean_hits) in one row from (case_id, uid) and (case_id, gold)."""
    per = hits.groupBy("case_id").agg(F.collect_list("uid").alias("uids"))
    return screened_score(cases.join(per, "case_id", "left"))


def screened_score(cases: DataFrame) -> DataFrame:
    """``screening_score`` of cases (gold, uids) that hold what was found for them as an array."""
    found = F.coalesce(F.array_contains("uids", F.col("gold")), F.lit(False))
    n = F.when(F.col("uids").isNull(), 0).otherwise(F.size("uids")).cast("long")
    gold = F.col("gold").isNotNull()
    return cases.agg(F.count_if(gold).alias("with_gold"), F.count_if(gold & found).alias("found"), F.count_if(~gold & (n > 0)).alias("false_alarms"), F.round(F.avg(n), 6).alias("mean_hits"))


def capped(rows: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group and how many more there are."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.lit(0).cast("long"), F.count("*").over(w) - cap))
    return ranked.where(F.col("rank") <= cap)


def even_sample(rows: DataFrame, by: str, order: str, skip: int, n: int) -> DataFrame:
    """``n`` rows of each group in even steps, after the first ``skip``."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(order)) - 1 - skip).withColumn("size", F.count("*").over(w) - skip)
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"size div {n}"))
    return ranked.where((F.col("place") >= 0) & (F.col("place") % step == 0) & (F.col("place") < step * n)).drop("place", "size")


def seeded_sample(rows: DataFrame, exclude: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows that aren't among the excluded ones, by a hash of key and seed, in the order of the key."""
    left = rows.join(exclude.select(key), key, "left_anti")
    return left.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary")), key).limit(n).orderBy(key)


def synthetic_claims(spark, products: DataFrame, days: int, cases: int, first_day: str) -> DataFrame:
    """products x days x cases claims for benches; every fourth one without history."""
    grid = products.select("product").crossJoin(spark.range(days).withColumnRenamed("id", "day")).crossJoin(spark.range(cases).withColumnRenamed("id", "case"))
    rows = grid.withColumn("claim_id", F.concat_ws("-", "product", "day", "case"))
    draw = F.pmod(F.conv(F.substring(F.md5(F.col("claim_id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100000))
    return rows.select("claim_id", "product", F.date_format(F.date_add(F.to_date(F.lit(first_day)), F.col("day").cast("int")), "yyyyMMdd").alias("enrolled_on"), draw.alias("claimed_amount"), ((F.col("day") * cases + F.col("case")) % 4 != 3).alias("has_history"))

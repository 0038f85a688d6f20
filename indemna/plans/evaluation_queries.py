"""Queries of labels, conversations, scores, latencies, samples and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.operators import evaluation as ev
from indemna.operators import followup
from indemna.plans.claim_queries import VIEWS as CLAIM_VIEWS
from indemna.plans.views import NAMED, Tables, query
from indemna.streaming import events as streams

#: Kinds of documents by what they look like, first match first.
TYPES = [("shouting", "!! "), ("table", " [|] "), ("marked", "[*#%&$]{3}"), ("licensed", "(?i)licen[sc]ed"), ("plain", "[a-z]")]


def _case(rules: list[tuple[str, str]], column: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


TYPED = {"v_typed": f"SELECT doc_id, lang, source, {_case(TYPES, 'text', 'none')} AS kind FROM documents"}


def typed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", ev.first_rule(F.col("text"), TYPES, "none").alias("kind"))


@query("dispute_type", "SELECT doc_id, kind FROM v_typed", TYPED)
def dispute_type(t: Tables) -> DataFrame:
    return typed(t).select("doc_id", "kind")


@query("type_distribution", "SELECT lang, kind, count(*) AS n FROM v_typed GROUP BY ROLLUP (lang, kind)", TYPED)
def type_distribution(t: Tables) -> DataFrame:
    return typed(t).rollup("lang", "kind").agg(F.count("*").alias("n"))


@query("class_skew", "SELECT kind, n, round(n / sum(n) OVER (), 6) AS share, n = max(n) OVER () AS majority FROM (SELECT kind, count(*) AS n FROM v_typed GROUP BY 1)", TYPED)
def class_skew(t: Tables) -> DataFrame:
    return ev.distribution(typed(t), "kind")


@query("in_scope", "SELECT doc_id, kind FROM v_typed WHERE regexp_matches(kind, '^(plain|licensed)') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", TYPED)
def in_scope(t: Tables) -> DataFrame:
    good = t.labels.where("quality = 1").select("doc_id")
    return typed(t).where(F.rlike("kind", F.lit("^(plain|licensed)"))).join(good, "doc_id", "left_semi").select("doc_id", "kind")


@query(
    "label_signals",
    """SELECT doc_id, coalesce(outcome, title, 'unknown') AS label, CASE WHEN title IS NULL AND outcome IS NULL THEN 'none' WHEN title = outcome THEN 'high' WHEN title IS NULL OR outcome IS NULL THEN 'medium' ELSE 'low' END AS confidence FROM (
      SELECT doc_id, CASE WHEN contains(lower(split_part(text, chr(10), 1)), 'and') THEN 'granted' WHEN contains(lower(split_part(text, chr(10), 1)), 'th') THEN 'refused' END AS title,
        CASE WHEN len(found) = 0 THEN NULL WHEN (found[-1] = 'that') <> regexp_matches(substr(string_split_regex(text, 'this|that')[-1], 1, 30), 'not|no|in') THEN 'granted' ELSE 'refused' END AS outcome
      FROM (SELECT *, regexp_extract_all(text, '(this|that)', 1) AS found FROM documents))""",
)
def label_signals(t: Tables) -> DataFrame:
    """A label from what the title says and from the last predicate of the text with its negation."""
    head = F.lower(F.substring_index("text", "\n", 1))
    title = F.when(head.contains("and"), "granted").when(head.contains("th"), "refused")
    outcome = ev.outcome_signal(F.col("text"), "this|that", "^that$", "not|no|in")
    label, confidence = ev.combine_signals(title, outcome)
    return t.documents.select("doc_id", label.alias("label"), confidence.alias("confidence"))


@query(
    "label_accuracy",
    "SELECT lang, count(*) AS n, count(*) FILTER (guess = quality) AS right, round(count(*) FILTER (guess = quality) / count(*), 6) AS accuracy FROM (SELECT lang, quality, (kind IN ('plain', 'licensed'))::INT AS guess FROM v_typed JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang)".replace(" AS right", ' AS "right"'),
    TYPED,
)
def label_accuracy(t: Tables) -> DataFrame:
    """The kinds as a guess of the quality, against the labels, by language and in all."""
    guess = typed(t).select("doc_id", "lang", F.col("kind").isin("plain", "licensed").cast("int").alias("label"))
    return ev.label_accuracy(guess, t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id", "lang")


@query(
    "label_confusion",
    'SELECT "true", label, n FROM (SELECT quality AS "true", guess AS label, count(*) AS n FROM v_guess JOIN labels USING (doc_id) GROUP BY ALL UNION ALL SELECT NULL, guess, count(*) FROM v_guess WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL UNION ALL SELECT quality, NULL, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM v_guess) GROUP BY ALL)',
    TYPED | {"v_guess": "SELECT doc_id, (kind IN ('plain', 'licensed'))::INT AS guess FROM v_typed WHERE doc_id % 3 <> 0"},
)
def label_confusion(t: Tables) -> DataFrame:
    """Pairs of label and guess, and what only one side has."""
    guess = typed(t).where("doc_id % 3 <> 0").select("doc_id", F.col("kind").isin("plain", "licensed").cast("int").alias("label"))
    return ev.confusion(guess, t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(
    "multilabel_pr",
    """SELECT label, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND t IS NULL) AS fp, count(*) FILTER (t AND p IS NULL) AS fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM (
      SELECT coalesce(a.label, b.label) AS label, a.p, b.t FROM (SELECT doc_id, unnest(list_filter([CASE WHEN kind NOT IN ('plain', 'licensed') THEN 'junk' END, CASE WHEN lang = 'en' THEN 'toxic' END], lambda x: x IS NOT NULL)) AS label, true AS p FROM v_typed JOIN labels USING (doc_id)) a
      FULL JOIN (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'junk' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS label, true AS t FROM labels) b ON a.doc_id = b.doc_id AND a.label = b.label) GROUP BY 1""",
    TYPED,
)
def multilabel_pr(t: Tables) -> DataFrame:
    named = lambda df, a, b: df.select("doc_id", F.explode(F.array_compact(F.array(F.when(a, F.lit("junk")), F.when(b, F.lit("toxic"))))).alias("label"))
    guess = typed(t).join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return ev.multilabel_scores(named(guess, ~F.col("kind").isin("plain", "licensed"), F.col("lang") == "en"), named(t.labels, F.col("quality") == 0, F.col("toxic") == 1), "doc_id")


@query("mention_counts", "SELECT source, sum(len(regexp_extract_all(text, 'the')))::BIGINT AS mentions, count(*) FILTER (contains(split_part(text, chr(10), 1), 'the')) AS titles FROM documents GROUP BY 1")
def mention_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("the"))).alias("mentions"), F.count_if(F.substring_index("text", "\n", 1).contains("the")).alias("titles"))


@query(
    "band_score",
    """SELECT band, count(*) AS n, count(*) FILTER (ok AND has AND hit) AS hit, count(*) FILTER (ok AND has AND NOT hit) AS miss, count(*) FILTER (ok AND NOT has AND said) AS false_code, count(*) FILTER (ok AND NOT has AND NOT said) AS correct_none, count(*) FILTER (NOT ok) AS errors
    FROM (SELECT product AS band, hospital_days <> 9 AS ok, documented AS has, code_number % 3 <> 0 AS said, documented AND code_number % 3 = 1 AS hit FROM v_claims) GROUP BY 1""",
)
def band_score(t: Tables) -> DataFrame:
    """Predicted codes: right for some numbers, wrong for others, none for the rest."""
    none = F.array().cast("array<string>")
    kind = F.col("code_number") % 3
    rows = t.claims().select(F.col("product").alias("band"), F.when(F.col("documented"), F.array("code")).otherwise(none).alias("true"), F.when(kind == 0, none).when(kind == 1, F.array("code")).otherwise(F.array(F.lit("Z99"))).alias("predicted"), (F.col("hospital_days") == 9).alias("failed"))
    return ev.band_score(rows)


@query(
    "screen_eval",
    """SELECT count(gold) AS with_gold, count(*) FILTER (gold IS NOT NULL AND found) AS found, count(*) FILTER (gold IS NULL AND n > 0) AS false_alarms, round(avg(n), 6) AS mean_hits FROM (
      SELECT a.claim_id, any_value(gold) AS gold, count(h.clause_uid) AS n, coalesce(bool_or(h.clause_uid = gold), false) AS found FROM (SELECT claim_id, CASE WHEN hospital_days % 2 = 0 THEN version || '|' || product || '|0#0' END AS gold FROM v_asof) a LEFT JOIN v_hits h USING (claim_id) GROUP BY 1)""",
    CLAIM_VIEWS,
)
def screen_eval(t: Tables) -> DataFrame:
    """Screening against a gold clause for every second claim."""
    from indemna.operators.adjudication import with_clauses_met
    from indemna.plans.claim_queries import dated

    rows = dated(t)
    gold = F.when(F.col("hospital_days") % 2 == 0, F.when(F.col("version").isNotNull(), F.concat("version", F.lit("|"), "product", F.lit("|0#0"))))
    return ev.screened_score(with_clauses_met(rows, t.clauses()).select(gold.alias("gold"), F.transform("met", lambda m: m["clause_uid"]).alias("uids")))


TURNS = [("CLAUSE", "(?i)clause|licen"), ("DOCS", "(?i)edst|papier|document"), ("AMOUNT", "(?i)thont|montant"), ("WHY", "(?i)\\bwh|warum|why")]
_FACTS = {
    "v_turns": f"""SELECT *, {_case(TURNS, 'text', 'UNKNOWN')} AS kind, list_distinct(regexp_extract_all(lower(text), '[a-z]{{2,}}tion')) AS facts FROM conversations""",
    "v_new": """SELECT conv_id, turn, kind, len(list_filter(facts, lambda f: NOT list_contains(coalesce(known, []), f))) AS fresh FROM (SELECT *, flatten(list(facts) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS known FROM v_turns)""",
}


def turns(t: Tables) -> DataFrame:
    """Turns with their kind, their facts (words of one ending), and how many of these weren't known before.

    A fact is new in the first turn that has it, so known facts need no growing list."""
    facts = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}tion"), F.lit(0)))
    rows = t.conversations.select("conv_id", "turn", "role", ev.first_rule(F.col("text"), TURNS, "UNKNOWN").alias("kind"), facts.alias("facts"))
    first = rows.select("conv_id", "turn", F.explode("facts").alias("fact")).groupBy("conv_id", "fact").agg(F.min("turn").alias("turn"))
    fresh = first.groupBy("conv_id", "turn").agg(F.count("*").alias("fresh"))
    return rows.join(fresh, ["conv_id", "turn"], "left").fillna(0, ["fresh"])


@query("turn_class", "SELECT conv_id, turn, kind FROM v_turns", _FACTS)
def turn_class(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", ev.first_rule(F.col("text"), TURNS, "UNKNOWN").alias("kind"))


#: Turns of users say something of a claim by a digit of their digest; from the fifth turn on the claim stands otherwise.
_SAID = {
    "v_talk": """SELECT conv_id, turn, role, md5(coalesce(text, ''))[1] AS d, c.*, turn >= 4 AS later FROM conversations JOIN (SELECT split_part(claim_id, '-', 1)::BIGINT AS o, product, claimed_amount AS claimed, hospital_days AS days, abroad, treatment, institution FROM v_claims
        WHERE split_part(claim_id, '-', 2) = '1' QUALIFY row_number() OVER (PARTITION BY o ORDER BY claim_id) = 1) c ON c.o = conv_id + 1""",
    "v_news": """SELECT conv_id, turn, CASE WHEN role <> 'user' OR role IS NULL THEN '' WHEN d = '0' THEN 'paid this year' WHEN d = '1' AND later AND claimed >= 1000 THEN 'amount' WHEN d = '2' THEN 'code' WHEN d = '4' AND CASE WHEN later THEN 5 ELSE days END <> 5 THEN 'days' WHEN d = '5' THEN 'date'
        WHEN d = '7' AND product IN ('AUTOMOBILE', 'BUILDING') AND NOT later AND treatment NOT IN (0, 6) THEN 'treatment' WHEN d = '8' AND product = 'FURNITURE' AND (later OR treatment <> 3) THEN 'noncovered'
        WHEN d = '9' AND product IN ('AUTOMOBILE', 'BUILDING') AND (later OR treatment NOT IN (6, 9)) THEN 'covered' WHEN d = 'a' AND NOT abroad AND CASE WHEN later THEN false ELSE institution <> 'general hospital' END THEN 'institution'
        WHEN d = 'b' AND NOT later THEN 'copay' ELSE '' END AS facts FROM v_talk""",
}


def talk(t: Tables):
    """Turns with their claim as it stood, and the facts in them that it didn't know."""
    tier = F.when(F.col("institution") == "tertiary hospital", "상급종합병원").when(F.col("institution") == "general hospital", "종합병원").when(F.col("institution") == "nursing home", "요양병원").when(F.col("institution") == "clinic", "의원")
    rows = t.claims().where(F.split("claim_id", "-")[1] == "1").withColumn("conv_id", F.split("claim_id", "-")[0].cast("long") - 1)
    rows = rows.groupBy("conv_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "conv_id"]), "claim_id").alias("c")).select("conv_id", "c.*")  # some numbers of lines repeat
    rows = rows.join(F.broadcast(t.spark.createDataFrame(list(NAMED), "product string, name string")), "product", "left")
    about = rows.select("conv_id", F.col("name").alias("product"), "claimed_amount", "room_charge", "paid_this_year", "self_paid_this_year", "narrative", "treatment", F.array("code").alias("codes"), "hospital_days", "enrolled_on", "incident_on", tier.alias("institution"), "abroad", F.lit(0.2).alias("copay_rate"))
    later = about.withColumns({"claimed_amount": F.col("claimed_amount") * 2, "hospital_days": F.lit(5), "institution": F.lit("종합병원"), "treatment": F.lit("도수치료 3회"), "copay_rate": F.lit(0.3)})
    stood = about.withColumn("turn", F.lit(0).cast("long")).unionByName(later.withColumn("turn", F.lit(4).cast("long")))
    d = F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 1)
    said = F.when(d == "0", "이미 받은 돈이 7,777,777원이에요").when(d == "1", F.concat(F.lit("실은 "), (F.col("first.claimed_amount")).cast("string"), F.lit("원을 청구했어요"))).when(d == "2", "Z99로 진단받았어요")
    said = said.when(d == "3", F.concat("first.code", F.lit("로 진단"))).when(d == "4", "5일간 입원했어요").when(d == "5", "2031년 3월 1일에요").when(d == "6", F.concat_ws(".", F.substring("first.incident_on", 1, 4), F.substring("first.incident_on", 5, 2), F.substring("first.incident_on", 7, 2)))
    said = said.when(d == "7", "사실 도수치료 받았어요").when(d == "8", "사실 비급여였어요").when(d == "9", "급여 진료였어요").when(d == "a", "종합병원이었어요").when(d == "b", "본인부담률 30%래요").otherwise("왜 그런가요")
    first = about.select("conv_id", F.struct("claimed_amount", F.col("codes")[0].alias("code"), "incident_on").alias("first"))
    turns = t.conversations.join(first, "conv_id").select("conv_id", "turn", d.alias("d"), F.when(F.col("role") == "user", said).alias("said"))
    return followup.new_facts(followup.as_it_stood(turns, stood, "conv_id", "turn"), "said")


@query("new_facts", "SELECT conv_id, turn, facts FROM v_news", _SAID)
def new_facts(t: Tables) -> DataFrame:
    """What each turn says that the claim, as it stood at that turn, doesn't know."""
    return talk(t).select("conv_id", "turn", F.array_join("facts", ",").alias("facts"))


@query(
    "followup_facts",
    """SELECT fact, count(*) FILTER (g AND f) AS hit, count(*) FILTER (g AND NOT f) AS missed, count(*) FILTER (f AND NOT g) AS false FROM (SELECT unnest(['paid this year', 'amount', 'code', 'days', 'date', 'treatment', 'noncovered', 'covered', 'institution', 'copay']) AS fact) k,
      LATERAL (SELECT facts = fact AS f, CASE WHEN conv_id % 5 = 0 AND fact = 'date' THEN false WHEN conv_id % 5 = 1 AND fact = 'code' THEN true ELSE facts = fact END AS g FROM v_news) x WHERE f OR g GROUP BY fact""",
    _SAID,
)
def followup_facts(t: Tables) -> DataFrame:
    """Found facts by kind against marks that lack some and have some more."""
    gold = F.when(F.col("conv_id") % 5 == 0, F.array_remove("facts", "date")).when(F.col("conv_id") % 5 == 1, F.array_union("facts", F.array(F.lit("code")))).otherwise(F.col("facts"))
    return followup.followup_scores(talk(t).withColumn("gold", gold))


@query("followup_eval", "SELECT kind, count(*) AS n, count(*) FILTER (fresh > 0) AS with_news, count(*) FILTER (fresh = 0 AND turn > 0) AS clean, round(count(*) FILTER (fresh = 0) / count(*), 6) AS clean_rate FROM v_new GROUP BY 1", _FACTS)
def followup_eval(t: Tables) -> DataFrame:
    clean = F.col("fresh") == 0
    return turns(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~clean).alias("with_news"), F.count_if(clean & (F.col("turn") > 0)).alias("clean"), F.round(F.count_if(clean) / F.count("*"), 6).alias("clean_rate"))


@query("session_summary", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, arg_max(kind, turn) AS last_kind, array_to_string(list_sort(list(DISTINCT role)), ',') AS known FROM v_turns GROUP BY 1", _FACTS)
def session_summary(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", ev.first_rule(F.col("text"), TURNS, "UNKNOWN").alias("kind"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max_by("kind", "turn").alias("last_kind"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("known"))


@query(
    "sessions",
    """SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, epoch_us(max(ts))::BIGINT AS end_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000)::INT, 1) AS new FROM events)) GROUP BY user_id, s""",
)
def sessions(t: Tables) -> DataFrame:
    rows = streams.sessions(streams.timed(t.events), "user_id", "ts")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    "session_turns",
    """SELECT user_id, event_id, epoch_us(ts)::BIGINT AS us, epoch_us(max(ts) OVER (PARTITION BY user_id, s))::BIGINT AS end_us FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 1800000000)::INT, 1) AS new FROM events)) QUALIFY row_number() OVER (PARTITION BY user_id, s ORDER BY ts DESC, event_id DESC) <= 40""",
)
def session_turns(t: Tables) -> DataFrame:
    """The last forty events of each session."""
    rows = streams.session_turns(streams.timed(t.events), "user_id", "ts", "event_id")
    return rows.select("user_id", "event_id", F.unix_micros("ts").alias("us"), F.unix_micros("end").alias("end_us"))


@query("windowed_counters", "SELECT epoch_us(date_trunc('hour', ts))::BIGINT AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counters(t: Tables) -> DataFrame:
    rows = streams.counters(streams.timed(t.events), "event_type", "ts")
    return rows.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("trace_totals", "SELECT user_id, count(*) AS spans, round(sum(CASE WHEN event_type IN ('view', 'purchase') THEN value ELSE 0 END), 2) AS total_ms, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def trace_totals(t: Tables) -> DataFrame:
    spans = t.events.select("user_id", "value", (~F.col("event_type").isin("view", "purchase")).cast("int").alias("depth"), (F.col("event_type") != "error").alias("ok"))
    return streams.trace_totals(spans, "user_id", "depth", "value")


def _pick(p: int) -> str:
    return f"max(value) FILTER (place = least(greatest(round_even({p}::DOUBLE / 100 * n, 0)::BIGINT - 1, 0), n - 1) + 1) AS p{p}"


@query(
    "step_latency",
    f"""SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, {_pick(95)}, {_pick(99)}, round(sum(value), 2) AS total FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""",
)
def step_latency(t: Tables) -> DataFrame:
    return ev.latency(t.events, "event_type", "value")


@query(
    "regression_gate",
    """SELECT b.metric, base, value, CASE WHEN value IS NULL THEN 'SKIP' WHEN CASE WHEN up THEN base - value ELSE value - base END <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status FROM (VALUES ('documents', 100.0::DOUBLE, true, 0.0::DOUBLE), ('mean_words', 1.0, false, 0.5), ('good_share', 0.8, true, 0.1), ('unmeasured', 1.0, true, 0.0)) b(metric, base, up, tolerance)
    LEFT JOIN (SELECT 'documents' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'mean_words', round(avg(n_chars), 6) FROM documents UNION ALL SELECT 'good_share', round(avg(quality), 6) FROM labels) m ON m.metric = b.metric""",
)
def regression_gate(t: Tables) -> DataFrame:
    return ev.regression_gate(*measured(t))


def measured(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A baseline of the tables and what they measure now."""
    base = t.spark.createDataFrame([("documents", 100.0, True, 0.0), ("mean_words", 1.0, False, 0.5), ("good_share", 0.8, True, 0.1), ("unmeasured", 1.0, True, 0.0)], "metric string, base double, higher_is_better boolean, tolerance double")
    one = lambda df, name, value: df.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value")
    now = one(t.documents, "documents", F.count("*").cast("double")).unionByName(one(t.documents, "mean_words", F.round(F.avg("n_chars"), 6))).unionByName(one(t.labels, "good_share", F.round(F.avg("quality"), 6)))
    return base, now


@query(
    "regression_record",
    """SELECT metric, coalesce(value, base) AS base, value IS NOT NULL AS measured, coalesce(strict, 'NEW') AS strict FROM (SELECT * FROM (VALUES ('documents', 100.0::DOUBLE, true, 0.0::DOUBLE), ('mean_words', 1.0, false, 0.5), ('good_share', 0.8, true, 0.1), ('unmeasured', 1.0, true, 0.0)) b(metric, base, up, tolerance)
      FULL JOIN (SELECT 'documents' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'mean_words', round(avg(n_chars), 6) FROM documents UNION ALL SELECT 'good_share', round(avg(quality), 6) FROM labels UNION ALL SELECT 'toxic_share', round(avg(toxic), 6) FROM labels) m USING (metric)),
      LATERAL (SELECT CASE WHEN base IS NULL THEN NULL WHEN value IS NULL THEN 'FAIL' WHEN CASE WHEN up THEN base - value ELSE value - base END <= tolerance THEN 'PASS' ELSE 'FAIL' END AS strict) s""",
)
def regression_record(t: Tables) -> DataFrame:
    """The baseline with what was measured in place, new metrics too, and the verdict of the strict gate on the old one."""
    base, now = measured(t)
    now = now.unionByName(t.labels.agg(F.round(F.avg("toxic"), 6).alias("value")).select(F.lit("toxic_share").alias("metric"), "value"))
    strict = ev.regression_gate(base, now, strict=True).select("metric", F.col("status").alias("strict"))
    rows = ev.record(base, now).join(now.select("metric", F.lit(True).alias("measured")), "metric", "left").join(strict, "metric", "left")
    return rows.select("metric", "base", F.coalesce("measured", F.lit(False)).alias("measured"), F.coalesce("strict", F.lit("NEW")).alias("strict"))


@query("set_difference", "SELECT doc_id, lang FROM documents EXCEPT ALL SELECT doc_id, lang FROM documents JOIN labels USING (doc_id)")
def set_difference(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang")
    return rows.exceptAll(rows.join(t.labels, "doc_id").select("doc_id", "lang"))


@query("capped_listing", "SELECT source, doc_id, rank, more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank, greatest(0, count(*) OVER (PARTITION BY source) - 40) AS more FROM documents) WHERE rank <= 40")
def capped_listing(t: Tables) -> DataFrame:
    return ev.capped(t.documents.select("source", "doc_id"), "source", ["doc_id"], 40)


@query("even_sample", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 3 AS place, greatest(1, (count(*) OVER (PARTITION BY source) - 2) // 5) AS step FROM documents) WHERE place >= 0 AND place % step = 0 AND place < step * 5")
def even_sample(t: Tables) -> DataFrame:
    """Five documents of each source in even steps, after the first two."""
    return ev.even_sample(t.documents.select("source", "doc_id"), "source", "doc_id", skip=2, n=5)


@query("seeded_sample", "SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('42:' || doc_id), doc_id LIMIT 50) ORDER BY doc_id")
def seeded_sample(t: Tables) -> DataFrame:
    """A worksheet of 50 documents that have no label yet."""
    return ev.seeded_sample(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id", 50, 42)


@query(
    "synthetic_claims",
    """SELECT product, enrolled_on, count(*) AS n, count(*) FILTER (has) AS with_history FROM (SELECT product, strftime(DATE '1995-01-01' + d::INT, '%Y%m%d') AS enrolled_on, (d * 6 + k) % 4 <> 3 AS has FROM (SELECT DISTINCT c_mktsegment AS product FROM customer), range(480) r(d), range(6) s(k)) GROUP BY ALL""",
)
def synthetic_claims(t: Tables) -> DataFrame:
    """Claims for benches: every product of the customers on 480 days, six cases each."""
    rows = ev.synthetic_claims(t.spark, t.customer.select(F.col("c_mktsegment").alias("product")).distinct(), 480, 6, "1995-01-01")
    return rows.groupBy("product", "enrolled_on").agg(F.count("*").alias("n"), F.count_if("has_history").alias("with_history"))

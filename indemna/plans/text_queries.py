"""Queries over texts: structure, extraction, dictionaries, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.functions import codes, money, text
from indemna.operators import dictionary, fusion, structure
from indemna.plans.views import Tables, query

PERSONAL = (("([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@", "$1***@"), ("([0-9]{4})([ -]?)[0-9]{4}[ -]?[0-9]{4}[ -]?([0-9]{4})", "$1$2****$2$3"))


@query("code_lists", None)
def code_lists(t: Tables) -> DataFrame:
    """All codes that are written in the documents, cleaned first."""
    return t.documents.select("doc_id", F.array_join(codes.codes_in(text.clean("text")), ",").alias("codes"))


@query("codes_in_text", """SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS codes FROM (SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(f, lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS list_distinct_ordered
    FROM (SELECT doc_id, list_transform(regexp_extract_all(' ' || replace(url, '.', ' ') || ' ', '[^A-Za-z0-9]([A-Za-z][0-9]{2})', 1), lambda x: upper(x)) AS f FROM (SELECT page_id AS doc_id, 'K' || (10 + page_id % 90) || ' and i' || (10 + page_id % 7) || '으로 K' || (10 + page_id % 90) AS url FROM pages)))""")  # fmt: skip
def codes_in_text(t: Tables) -> DataFrame:
    two = lambda n: (F.lit(10) + F.col("page_id") % n).cast("string")
    said = F.concat(F.lit("K"), two(90), F.lit(" and i"), two(7), F.lit("으로 K"), two(90))
    return t.pages.select(F.col("page_id").alias("doc_id"), F.array_join(codes.codes_in(said), ",").alias("codes"))


@query("codes_strict", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type[1] || lpad(p_size::VARCHAR, 2, '0') || '.' || (p_partkey % 9) || ',Z' || (10 + p_partkey % 80) END AS codes, CASE WHEN p_partkey % 5 = 0 THEN 'BOLT' ELSE '' END AS invalid FROM part""")
def codes_strict(t: Tables) -> DataFrame:
    raw = F.concat(F.substring("p_type", 1, 1), F.lpad(F.col("p_size").cast("string"), 2, "0"), (F.col("p_partkey") % 9).cast("string"), F.lit("; Z"), (F.lit(10) + F.col("p_partkey") % 80).cast("string"), F.when(F.col("p_partkey") % 5 == 0, " bolt").otherwise(""))
    rows = t.part.select("p_partkey", codes.codes_strict(raw).alias("c"))
    return rows.select("p_partkey", F.array_join("c.codes", ",").alias("codes"), F.array_join("c.invalid", ",").alias("invalid"))


@query(
    "pii_masked",
    r"""SELECT doc_id, md5(m) AS masked_md5, m <> text AS changed FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@', '\1***@', 'g'),
      '([0-9]{4})([ -]?)[0-9]{4}[ -]?[0-9]{4}[ -]?([0-9]{4})', '\1\2****\2\3', 'g') AS m FROM documents)""",
)
def pii_masked(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.mask(F.col("text"), PERSONAL).alias("m"))
    return rows.select("doc_id", F.md5(F.col("m.masked").cast("binary")).alias("masked_md5"), "m.changed")


@query(
    "money_literals",
    """SELECT c_custkey, array_to_string(list_filter([c_custkey * 1000 + 12, floor(c_acctbal)::BIGINT * CASE WHEN c_acctbal < 0 THEN -10000 ELSE 10000 END, 999], lambda x: x >= 1000), ',') AS amounts FROM customer""",
)
def money_literals(t: Tables) -> DataFrame:
    said = F.concat(F.format_number(F.col("c_custkey") * 1000 + 12, 0), F.lit("원, "), F.regexp_replace(F.format_number(F.floor("c_acctbal"), 0), "-", ""), F.lit("만원과 999원"))
    return t.customer.select("c_custkey", F.array_join(F.transform(money.amounts_in(said), lambda x: x.cast("string")), ",").alias("amounts"))


@query(
    "prose_quotes",
    r"""SELECT doc_id, CASE WHEN flat = '' THEN '' WHEN length(flat) > 60 THEN rtrim(substr(flat, 1, 60)) || '…' ELSE flat END AS quote FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)""",
)
def prose_quotes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.prose_quote(F.col("text"), 60).alias("quote"))


@query(
    "stemmed_tokens",
    """SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]{2,}'), lambda w: CASE WHEN suffix(w, 'tion') AND length(w) >= 6 THEN w[:-5] WHEN suffix(w, 'ing') AND length(w) >= 5 THEN w[:-4]
      WHEN suffix(w, 'ed') AND length(w) >= 4 THEN w[:-3] WHEN suffix(w, 'es') AND length(w) >= 4 THEN w[:-3] WHEN suffix(w, 'ly') AND length(w) >= 4 THEN w[:-3] WHEN suffix(w, 'er') AND length(w) >= 4 THEN w[:-3] ELSE w END), ' ')) AS stems_md5 FROM documents""",
)
def stemmed_tokens(t: Tables) -> DataFrame:
    stems = text.stemmed_tokens(F.lower("text"), text.PARTICLES_EN, "[a-z]{2,}")
    return t.documents.select("doc_id", F.md5(F.array_join(stems, " ").cast("binary")).alias("stems_md5"))


@query("proviso_stripped", """SELECT p_partkey, 'covers ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (all sizes)' ELSE ' ' END || ' for ' || p_type AS clause FROM part""")
def proviso_stripped(t: Tables) -> DataFrame:
    clause = F.concat(F.lit("covers "), "p_name", F.when(F.col("p_size") % 2 == 0, " (all sizes)").otherwise(" (but only small, 다만 no others)"), F.lit(" for "), "p_type")
    return t.part.select("p_partkey", F.regexp_replace(text.without_provisos(clause), " +(?=  )", "").alias("clause"))


@query(
    "fact_dates",
    """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d') AS day, (o_orderkey % 90)::INT AS days FROM orders""",
)
def fact_dates(t: Tables) -> DataFrame:
    """The first real date of a sentence, and the days in hospital."""
    day = F.to_date("o_orderdate")
    said = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2020.13.45, then "), F.date_format(F.date_add(day, 1), "yyyy/M/d"), F.lit(" and "))).otherwise(""), F.date_format(day, "yyyy년 M월 d"), F.lit("일에 "), (F.col("o_orderkey") % 90).cast("string"), F.lit("일간 입원"))
    days = F.regexp_extract(said, "(\\d{1,3})\\s*일\\s*(?:간\\s*)?입원", 1).try_cast("int")
    return t.orders.select("o_orderkey", text.first_date(said).cast("string").alias("day"), days.alias("days"))


@query(
    "claim_facts",
    """SELECT claim_id, CASE WHEN documented THEN code ELSE code || ',' || letter || '99' END AS codes, CASE WHEN documented THEN letter || '99' ELSE '' END AS weak, nullif(greatest(claimed_amount - 5000, 0), 0) AS amount,
      CASE WHEN abroad THEN NULL ELSE institution END AS institution FROM v_claims""",
)
def claim_facts(t: Tables) -> DataFrame:
    """Documented codes make guesses from the dictionary weak; written codes always stay; amounts of 0 aren't given."""
    from indemna.operators.facts import assemble

    rows = t.claims().withColumns({"given": F.when(F.col("documented"), F.array("code")), "written": F.array("code"), "guessed": F.array(F.concat("letter", F.lit("99"))), "given_amount": F.col("claimed_amount") - 5000})
    rows = assemble(rows)
    return rows.select("claim_id", F.array_join("codes", ",").alias("codes"), F.array_join("weak_codes", ",").alias("weak"), "amount", "institution")


@query(
    "product_resolve",
    """SELECT asked, CASE WHEN len(c) = 1 THEN c[1] END AS resolved, tier, coalesce(len(c), 0)::INT AS candidates FROM (SELECT DISTINCT split_part(p_name, ' ', 1 + (p_partkey % 2)::INT) AS asked FROM part UNION SELECT DISTINCT upper(p_name) FROM part WHERE p_size = 7) LEFT JOIN (
      SELECT asked, arg_min(c, tier) AS c, min(tier) AS tier FROM (SELECT asked, tier, list_sort(list(DISTINCT product)) AS c FROM (
        SELECT asked, product, CASE WHEN asked = product THEN 0 WHEN replace(lower(asked), ' ', '') = replace(lower(product), ' ', '') THEN 1 WHEN starts_with(replace(lower(product), ' ', ''), replace(lower(asked), ' ', '')) THEN 2
          WHEN contains(replace(lower(product), ' ', ''), replace(lower(asked), ' ', '')) THEN 3 END AS tier
        FROM (SELECT DISTINCT split_part(p_name, ' ', 1 + (p_partkey % 2)::INT) AS asked FROM part UNION SELECT DISTINCT upper(p_name) FROM part WHERE p_size = 7), (SELECT DISTINCT p_name AS product FROM part)) WHERE tier IS NOT NULL GROUP BY ALL) GROUP BY 1) USING (asked)""",
)
def product_resolve(t: Tables) -> DataFrame:
    word = F.element_at(F.split("p_name", " "), (F.col("p_partkey") % 2 + 1).cast("int"))
    asked = t.part.select(word.alias("asked")).union(t.part.where("p_size = 7").select(F.upper("p_name")))
    return structure.resolve_name(asked, t.part.select(F.col("p_name").alias("product")))


@query(
    "same_product",
    """SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name
      AND (contains(x(a.p_name), x(b.p_name)) OR contains(x(b.p_name), x(a.p_name)))""".replace("x(a.p_name)", "regexp_replace(a.p_name, 'small|big|red|blue|[ ]+', '', 'g')").replace("x(b.p_name)", "regexp_replace(b.p_name, 'small|big|red|blue|[ ]+', '', 'g')"),
)
def same_product(t: Tables) -> DataFrame:
    return structure.same_products(t.part, "p_name", "small|big|red|blue")


@query(
    "provision_scope",
    "SELECT c_custkey, version FROM customer, v_versions WHERE NOT list_contains(excluded, c_mktsegment) AND (len(included) = 0 OR list_contains(included, c_mktsegment))",
)
def provision_scope(t: Tables) -> DataFrame:
    from indemna.operators.versions import covers_product

    return t.customer.crossJoin(t.versions()).where(covers_product(F.col("c_mktsegment"))).select("c_custkey", "version")


@query(
    "line_sections",
    """SELECT doc_id, pos, section, last_value(CASE WHEN is_c THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chapter, md5(line) AS line_md5 FROM (
      SELECT *, sum(is_s::INT) OVER w AS n, last_value(CASE WHEN is_s THEN line END IGNORE NULLS) OVER w AS section FROM (
        SELECT doc_id, pos - 1 AS pos, line, NOT regexp_matches(line, '[│┃|┏┗]') AND regexp_matches(line, '^.{1,12}$') AS is_s, NOT regexp_matches(line, '[│┃|┏┗]') AND NOT regexp_matches(line, '^.{1,12}$') AND regexp_matches(line, '^.{13,30}$') AS is_c
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))""",
)
def line_sections(t: Tables) -> DataFrame:
    """Lines of up to 12 characters head sections, of up to 30 chapters."""
    rows = structure.line_sections(t.documents, "doc_id", "text", "^.{1,12}$", "^.{13,30}$")
    return rows.withColumn("line_md5", F.md5(F.col("line").cast("binary"))).drop("line")


@query(
    "document_sections",
    """SELECT doc_id, cardinality(m)::BIGINT AS n, md5(array_to_string(list_sort(list_transform(map_entries(m), lambda e: e.key || '=' || e.value)), ';')) AS digest FROM (
      SELECT doc_id, map_from_entries(list((name, body))) AS m FROM (SELECT doc_id, name, string_agg(body, chr(10) ORDER BY pos) AS body FROM (
        SELECT doc_id, pos, split_part(part, chr(31), 1) AS name, trim(regexp_extract(part, '(?s)\x1f(.*)$', 1)) AS body FROM (
          SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '(?:^|\\n)([A-Z][a-z]{1,3})[.] ', chr(30) || '\\1' || chr(31), 'g'), chr(30)) AS p FROM documents)) WHERE pos > 1) GROUP BY ALL) GROUP BY 1)""",
)
def document_sections(t: Tables) -> DataFrame:
    """Sections headed by a short word with a full stop at the start of a line."""
    rows = structure.sections(t.documents, "doc_id", "text", "(?:^|\\n)([A-Z][a-z]{1,3})[.] ")
    entries = F.array_sort(F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("doc_id", F.size("sections").cast("long").alias("n"), F.md5(F.array_join(entries, ";").cast("binary")).alias("digest"))


#: The corpus' substrings: of its words, and of the ends and beginnings at both sides of a blank.
EVIDENCE = {
    "v_words": """SELECT DISTINCT w FROM (SELECT unnest(string_split(line, ' ')) AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(w) > 1""",
    "v_inside": """SELECT DISTINCT substr(w, i, n) AS s FROM (SELECT w, i, unnest(range(2, length(w) - i + 2)) AS n FROM (SELECT w, unnest(range(1, length(w))) AS i FROM v_words))""",
    "v_blanks": """SELECT DISTINCT x.a AS a, x.b AS b FROM (SELECT unnest(list_zip(w, w[2:])) AS z, z[1] AS a0 FROM (SELECT string_split(line, ' ') AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))), LATERAL (SELECT z[1] AS a, z[2] AS b) x
      WHERE x.a <> '' AND x.b <> ''""",
    "v_apart": """SELECT DISTINCT a[-i:] AS l, b[:j] AS r FROM (SELECT a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM v_blanks))""",
    "v_asks": """SELECT DISTINCT "left", "right", turn, l, r FROM (
      SELECT "left", "right", 0 AS turn, "left" AS l, "right" AS r FROM v_cuts UNION ALL SELECT "left", "right", 1, "left", "right" FROM v_cuts UNION ALL
      SELECT "left", "right", 2 * (7 - w) + k, "left"[-w:], "right"[:w] FROM v_cuts, (SELECT unnest([6, 5, 4, 3, 2]) AS w), (SELECT unnest([0, 1]) AS k) WHERE length("left"[-w:]) + length("right"[:w]) >= 4)""",
    "v_told": """SELECT "left", "right", min(turn) % 2 = 0 AS fused FROM v_asks q LEFT JOIN v_inside i ON q.turn % 2 = 0 AND i.s = q.l || q.r LEFT JOIN v_apart p ON q.turn % 2 = 1 AND p.l = q.l AND p.r = q.r
      WHERE i.s IS NOT NULL OR p.l IS NOT NULL GROUP BY ALL""",
}


@query(
    "fusion_evidence",
    """SELECT c."left", c."right", coalesce(fused, false) AS fused FROM v_cuts c LEFT JOIN v_told t ON t."left" = c."left" AND t."right" = c."right" """,
    EVIDENCE
    | {
        "v_cuts": r"""SELECT DISTINCT regexp_extract(line, '(\S+)$', 1) AS "left", regexp_extract(after, '^(\S+)', 1) AS "right" FROM (
      SELECT trim(l[i]) AS line, trim(l[i + 1]) AS after FROM (SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT string_split(text, chr(10)) AS l FROM documents))) WHERE line <> '' AND after <> ''""",
    },
)
def fusion_evidence(t: Tables) -> DataFrame:
    """The last word of every line of the documents and the first of the next: one word, by what all documents have?"""
    lines = t.documents.select(F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("l"))
    pairs = lines.select(F.explode(F.arrays_zip(F.col("l").alias("a"), F.slice("l", 2, F.size("l")).alias("b"))).alias("p")).where("p.a <> '' and p.b <> ''")
    return fusion.fusion_evidence(pairs.select(F.regexp_extract("p.a", "(\\S+)$", 1).alias("left"), F.regexp_extract("p.b", "^(\\S+)", 1).alias("right")), t.documents)


@query("chunk_rows", "SELECT node_uid, node_kind, md5(content) AS content_md5 FROM (SELECT article_uid AS node_uid, 'article' AS node_kind, title || chr(10) || text AS content FROM v_articles UNION ALL SELECT item_uid, 'item', content FROM v_items)")
def chunk_rows(t: Tables) -> DataFrame:
    rows = structure.chunk_rows(t.articles(), t.items())
    return rows.select("node_uid", "node_kind", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("chunk_windows")
def chunk_windows(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(structure.split_lines(F.col("text"))).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", "content")


_PAGE_LINK = '<a href="([^"]*)"[^>]*>([^<]*)</a>'


@query("page_links", f"SELECT page_id, pos, href, label FROM (SELECT page_id, unnest(h) AS href, unnest(l) AS label, (generate_subscripts(h, 1) - 1)::INT AS pos FROM (SELECT page_id, regexp_extract_all(html, '{_PAGE_LINK}', 1) AS h, regexp_extract_all(html, '{_PAGE_LINK}', 2) AS l FROM pages))")
def page_links(t: Tables) -> DataFrame:
    return structure.links(t.pages, "page_id", "html")


def _page_sql() -> str:
    out = "regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    out = f"regexp_replace({out}, '(?i)<br[^>]*>|</(p|div|li|h[1-6]|tr)>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return f"trim(regexp_replace({out}, '\\n+', chr(10), 'g'), ' ' || chr(10))"


@query("page_text", f"SELECT page_id, md5({_page_sql()}) AS text_md5 FROM pages")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(structure.html_text(F.col("html")).cast("binary")).alias("text_md5"))


TERMS = {
    "v_names": "SELECT p_type[1] || lpad(p_size::VARCHAR, 2, '0') AS category, p_name AS full_name, split_part(p_name, ' ', 2) AS tail FROM part",
    "v_keys": """SELECT key, kind, array_to_string(c, ',') AS categories FROM (
      SELECT full_name AS key, 'full' AS kind, list_sort(list(DISTINCT category)) AS c FROM v_names GROUP BY 1 HAVING count(DISTINCT category) <= 40 UNION ALL
      SELECT tail, 'tail', list_sort(list(DISTINCT category)) FROM v_names WHERE tail NOT IN (SELECT full_name FROM v_names) GROUP BY 1 HAVING count(DISTINCT category) <= 300)""",
}


def part_keys(t: Tables) -> DataFrame:
    rows = t.part.select(F.concat(F.substring("p_type", 1, 1), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("code"), "p_name")
    return structure.term_keys(rows, "code", "p_name", most=40, tail_most=300)


@query("term_keys", "SELECT key, kind, categories FROM v_keys", TERMS)
def term_keys(t: Tables) -> DataFrame:
    return part_keys(t).withColumn("categories", F.array_join("categories", ","))


@query(
    "dictionary_match",
    """SELECT claim_id, key FROM (SELECT claim_id, key, said FROM (SELECT claim_id, 'the ' || narrative || ' near a ' || lower(product) || ' ring' AS said FROM v_claims) JOIN v_keys ON contains(' ' || said || ' ', ' ' || key || ' ')) m
    WHERE NOT EXISTS (SELECT 1 FROM v_keys k WHERE contains(' ' || m.said || ' ', ' ' || k.key || ' ') AND k.key <> m.key AND contains(' ' || k.key || ' ', ' ' || m.key || ' '))""",
    TERMS,
)
def dictionary_match(t: Tables) -> DataFrame:
    said = t.claims().select("claim_id", F.concat(F.lit("the "), "narrative", F.lit(" near a "), F.lower("product"), F.lit(" ring")).alias("said"))
    return dictionary.dictionary_match(said, "claim_id", "said", part_keys(t))


_LETTERS, _SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"
_RED_RING = "red ring".translate(str.maketrans(_LETTERS, _SYLLABLES))
_KOREAN = {
    "v_korean": f"SELECT claim_id, hospital_days % 6 AS form, translate(narrative, '{_LETTERS}', '{_SYLLABLES}') AS f FROM v_claims",
    "v_korean_keys": f"""SELECT DISTINCT unnest([f, split_part(f, ' ', 2), substr(split_part(f, ' ', 2), 1, 2)]) AS key FROM (SELECT translate(p_name, '{_LETTERS}', '{_SYLLABLES}') AS f FROM part)""",
    "v_korean_said": f"""SELECT claim_id, CASE WHEN contains(said, '충치') THEN said || ' {_RED_RING}' ELSE said END AS said FROM (SELECT claim_id, CASE form WHEN 0 THEN '급성' || w WHEN 1 THEN '검사' || w || ' 후' WHEN 2 THEN '문화 ' || w || ', ' || f
      WHEN 3 THEN '충치 ' || w WHEN 4 THEN w || ' 과 ' || f ELSE '문화 ' || t END AS said FROM (SELECT *, split_part(f, ' ', 2) AS t, substr(split_part(f, ' ', 2), 1, 2) AS w FROM v_korean))""",
    "v_korean_met": """SELECT said, key, CASE WHEN length(key) > 2 THEN contains(bare, key) ELSE regexp_matches(bare, '(^|[^가-힣]|급성|만성)' || key) END AS strong
      FROM (SELECT DISTINCT said, regexp_replace(said, '문화 [가-힣]+', '#', 'g') AS bare FROM v_korean_said) JOIN v_korean_keys ON contains(said, key)""",
}


@query(
    "dictionary_entities",
    """SELECT s.claim_id, m.key, m.strong FROM v_korean_said s JOIN v_korean_met m ON m.said = s.said
    WHERE NOT EXISTS (SELECT 1 FROM v_korean_met l WHERE l.said = m.said AND l.strong AND l.key <> m.key AND contains(l.key, m.key))""",
    _KOREAN,
)
def dictionary_entities(t: Tables) -> DataFrame:
    """Terms in narratives of claims, written in syllables, some of them glued to other words or inside homonyms."""
    korean = lambda c: F.translate(c, _LETTERS, _SYLLABLES)
    last = lambda f: F.split_part(f, F.lit(" "), F.lit(2))
    keys = t.part.select(korean("p_name").alias("f")).distinct()
    keys = keys.select(F.explode(F.array("f", last(F.col("f")), F.substring(last(F.col("f")), 1, 2))).alias("key")).distinct()
    rows = t.claims().select("claim_id", (F.col("hospital_days") % 6).alias("form"), korean("narrative").alias("f"))
    rows = rows.withColumn("t", last(F.col("f"))).withColumn("w", F.substring("t", 1, 2))
    form, said = F.col("form"), lambda *parts: F.concat(*[F.col(p) if len(p) == 1 else F.lit(p) for p in parts])
    text_ = F.when(form == 0, said("급성", "w")).when(form == 1, said("검사", "w", " 후")).when(form == 2, said("문화 ", "w", ", ", "f"))
    text_ = text_.when(form == 3, said("충치 ", "w")).when(form == 4, said("w", " 과 ", "f")).otherwise(said("문화 ", "t"))
    return dictionary.entity_match(rows.select("claim_id", text_.alias("said")), "claim_id", "said", keys, {"충치": _RED_RING}, ("문화 [가-힣]+",))


@query(
    "term_triage",
    """SELECT item_id, term, CASE WHEN term IS NULL THEN 'no term' WHEN n IS NULL THEN 'missing' WHEN n <= 2 THEN 'hollow' ELSE 'defined' END AS verdict FROM (SELECT item_id, nullif(regexp_extract(lower(text), '([a-z]{6,})', 1), '') AS term FROM benchmark)
    LEFT JOIN (SELECT term AS known, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents) GROUP BY 1) ON known = term""",
)
def term_triage(t: Tables) -> DataFrame:
    """The first long word of a passage as the disputed term: how many documents know it."""
    from indemna.operators.facts import triage

    asked = t.benchmark.select("item_id", F.nullif(F.regexp_extract(F.lower("text"), "([a-z]{6,})", 1), F.lit("")).alias("term"))
    known = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return triage(asked, known, hollow=2).select("item_id", "term", "verdict")


_COPY = "SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN replace(text, ' the ', ' The ') WHEN doc_id % 7 = 0 THEN substr(text, 1, length(text) // 2) WHEN doc_id % 11 = 0 THEN replace(text, ' ', '') ELSE text END AS text, n_chars + (doc_id % 13 = 0)::INT AS n_chars FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id + 1000000, lang, text, n_chars FROM documents WHERE doc_id % 97 = 0"


def changed_copy(t: Tables) -> DataFrame:
    """The documents with some texts changed, some left out and some added."""
    d = t.documents.select("doc_id", "lang", "text", "n_chars")
    of = F.col("doc_id")
    changed = F.when(of % 5 == 0, F.replace("text", F.lit(" the "), F.lit(" The "))).when(of % 7 == 0, F.substring("text", F.lit(1), F.expr("length(text) div 2").cast("int"))).when(of % 11 == 0, F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text"))
    rows = d.where(of % 17 != 0).select("doc_id", "lang", changed.alias("text"), (F.col("n_chars") + (of % 13 == 0).cast("int")).alias("n_chars"))
    return rows.unionByName(d.where(of % 97 == 0).withColumn("doc_id", of + 1000000))


@query(
    "source_compare",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS status,
      CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN array_to_string(list_filter([CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.text IS DISTINCT FROM b.text THEN 'text' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') END AS differs
    FROM documents a FULL JOIN v_copy b ON a.doc_id = b.doc_id""",
    {"v_copy": _COPY},
)
def source_compare(t: Tables) -> DataFrame:
    rows = structure.compare_sources(t.documents, changed_copy(t), "doc_id", ["lang", "text", "n_chars"], "doc_id")
    return rows.withColumn("differs", F.array_join("differs", ","))


@query(
    "set_compare",
    """SELECT lang, count(*) FILTER (l AND r) AS shared, count(*) FILTER (l AND r IS NULL) AS left_only, count(*) FILTER (r AND l IS NULL) AS right_only, round(count(*) FILTER (l AND r) / count(*) FILTER (l), 6) AS recall FROM (
      SELECT coalesce(a.lang, b.lang) AS lang, a.l, b.r FROM (SELECT DISTINCT lang, regexp_replace(text, '\\s', '', 'g') AS key, true AS l FROM documents) a FULL JOIN (SELECT DISTINCT lang, regexp_replace(text, '\\s', '', 'g') AS key, true AS r FROM v_copy) b ON a.lang = b.lang AND a.key = b.key) GROUP BY 1""",
    {"v_copy": _COPY},
)
def set_compare(t: Tables) -> DataFrame:
    """Texts of both sources by language, blind to white space."""
    key = lambda df, name: df.select("lang", F.md5(F.regexp_replace("text", "\\s", "").cast("binary")).alias("key")).distinct().withColumn(name, F.lit(True))
    both = key(t.documents, "l").join(key(changed_copy(t), "r"), ["lang", "key"], "full_outer")
    shared = F.count_if(F.col("l") & F.col("r"))
    return both.groupBy("lang").agg(
        shared.alias("shared"),
        F.count_if(F.col("l") & F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("r") & F.col("l").isNull()).alias("right_only"),
        F.round(shared / F.count_if("l"), 6).alias("recall"),
    )


@query(
    "divergence_class",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.text = b.text THEN 'equal' WHEN length(a.text) < p OR length(b.text) < p THEN 'cut' WHEN a.text[p] = ' ' OR b.text[p] = ' ' OR a.text[p] = chr(10) OR b.text[p] = chr(10) THEN 'space'
      WHEN lower(a.text[p]) = lower(b.text[p]) THEN 'case' WHEN regexp_matches(a.text[p], '[0-9]') OR regexp_matches(b.text[p], '[0-9]') THEN 'digit' ELSE 'character' END AS kind
      FROM documents a JOIN v_copy b USING (doc_id), LATERAL (SELECT coalesce(min(i), least(length(a.text), length(b.text)) + 1) AS p FROM range(1, least(length(a.text), length(b.text)) + 1) r(i) WHERE substr(a.text, i, 1) <> substr(b.text, i, 1))) GROUP BY 1""",
    {"v_copy": _COPY},
)
def divergence_class(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", F.col("text").alias("a")).join(changed_copy(t).select("doc_id", F.col("text").alias("b")), "doc_id")
    return both.groupBy(structure.divergence_class(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "cer",
    r"""SELECT page, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS characters, round(sum(e) / sum(n), 6) AS cer FROM (SELECT item_id % 8 AS page, levenshtein(regexp_replace(text, '\s', '', 'g'), regexp_replace(read, '\s', '', 'g')) AS e, length(regexp_replace(text, '\s', '', 'g')) AS n
      FROM (SELECT item_id, text, replace(replace(text, 'th', 't'), 'e', CASE WHEN item_id % 3 = 0 THEN 'c' ELSE 'e' END) AS read FROM benchmark)) GROUP BY ROLLUP (page)""",
)
def cer(t: Tables) -> DataFrame:
    """Character errors of passages as a bad scan would read them, by page and in all."""
    read = F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("e"), F.when(F.col("item_id") % 3 == 0, "c").otherwise("e"))
    errors, length = structure.character_error(F.col("text"), read)
    rows = t.benchmark.select((F.col("item_id") % 8).alias("page"), errors.alias("e"), length.alias("n"))
    return rows.rollup("page").agg(F.sum("e").alias("errors"), F.sum("n").alias("characters"), F.round(F.sum("e") / F.sum("n"), 6).alias("cer"))

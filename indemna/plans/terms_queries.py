"""The structure of terms, provisions and receipts, on Korean texts written around the lines and keys of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indemna.functions import benefits, receipts
from indemna.operators import pages, provisions, terms
from indemna.plans.text_queries import EVIDENCE
from indemna.plans.views import Tables, query

_MARKS = terms.CIRCLED[:10]
VIEWS = {
    "v_lines": """SELECT doc_id, md5(line) AS m, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS i FROM documents)""",
}


def written(t: Tables, line, before: str = "", after: str = "", between: str = "\n") -> DataFrame:
    """(doc_id, text): every document with each of its lines written anew by ``line`` (digest of the line, its number)."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: line(F.md5(x.cast("binary")), i)), between)
    return t.documents.select("doc_id", F.concat(F.lit(before), body, F.lit(after)).alias("text"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    "terms_articles",
    """SELECT doc_id, CASE WHEN i % 2 = 0 THEN (i + 1)::VARCHAR ELSE (i + 1) || '의2' END AS number, CASE WHEN i % 5 = 4 THEN '보상하지 않는 사항' ELSE '가(나) ' || i END AS title, m AS body,
      '20' || (10 + doc_id % 20) || '-' || lpad((i % 12 + 1)::VARCHAR, 2, '0') || '-03' AS revised_on, i % 5 = 4 AS is_exclusion, '제1관 총칙' AS chapter FROM v_lines""",
    VIEWS,
)
def terms_articles(t: Tables) -> DataFrame:
    """Articles, their titles with brackets inside, and their revision dates, from the lines of all documents."""
    year = F.lit(10) + F.col("doc_id") % 20
    line = lambda m, i: _text("제 ", i + 1, F.when(i % 2 == 0, "조").otherwise("조의2"), "(", F.when(i % 5 == 4, "보상하지 않는 사항").otherwise(_text("가(나) ", i)), ") ", m, " <개정 20", year, ". ", i % 12 + 1, ". 3.>")
    rows = terms.articles(written(t, line, "앞의 말\n□ 실손의료보험\n제1관 총칙\n"), "doc_id")
    return rows.select("doc_id", "number", "title", F.substring_index("text", " ", 1).alias("body"), F.array_join("revised_on", ",").alias("revised_on"), "is_exclusion", "chapter")


@query("terms_paragraphs", "SELECT doc_id, i % 10 + 1 AS number, m AS text, false AS implicit, i % 10 = 7 AS recovered FROM v_lines", VIEWS)
def terms_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs by circled digits; every tenth mark is damaged and read from the one before."""
    line = lambda m, i: _text(F.when(i % 10 == 7, "?").otherwise(F.element_at(F.array(*map(F.lit, _MARKS)), i % 10 + 1)), " ", m)
    return terms.paragraphs(written(t, line), "doc_id", "text").select("doc_id", "number", "text", "implicit", "recovered")


@query("terms_items", "SELECT doc_id, i // 30 AS part, i % 30 + 1 AS number, unnest(['가', '나']) AS label, unnest([m, i || ' 끝']) AS text FROM v_lines", VIEWS)
def terms_items(t: Tables) -> DataFrame:
    """Items and the two subitems that each has; every thirty lines of a document make a list."""
    lines = F.split("text", "\n")
    blocks = t.documents.select("doc_id", lines.alias("lines"), F.explode(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 30).cast("int"))).alias("part"))
    line = lambda x, i: _text(i + 1, ". 항목\n가. ", F.md5(x.cast("binary")), "\n나. ", F.col("part") * 30 + i, " 끝")
    texts = blocks.select("doc_id", "part", F.array_join(F.transform(F.slice("lines", F.col("part") * 30 + 1, 30), line), "\n").alias("text"))
    items = terms.items(texts, ["doc_id", "part"], "text")
    return terms.subitems(items, ["doc_id", "part", "number"], "text").select("doc_id", "part", "number", "label", "text")


@query("terms_table_rows", "SELECT doc_id, i::VARCHAR || '|' || m AS cells FROM v_lines", VIEWS)
def terms_table_rows(t: Tables) -> DataFrame:
    """The rows of a drawn table with a cell for the number and one for the digest of each line."""
    line = lambda m, i: _text("┃ ", i, " ┃ ", m, " ┃")
    rows = terms.table_rows(written(t, line, "앞\n┏━━┳━━┓\n", "\n┗━━┻━━┛\n뒤", "\n┣━━╋━━┫\n"), "doc_id", "text")
    return rows.select("doc_id", F.array_join("cells", "|").alias("cells"))


_HALVES = {
    "v_halves": r"""SELECT doc_id, i, regexp_replace(line[:length(line) // 2], '^\s+|\s+$', '', 'g') AS a, regexp_replace(line[length(line) // 2 + 1:], '^\s+|\s+$', '', 'g') AS b
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS i FROM documents)""",
    "v_cuts": r"""SELECT DISTINCT regexp_extract(a, '(\S+)$', 1) AS "left", regexp_extract(b, '^(\S+)', 1) AS "right" FROM v_halves WHERE a <> '' AND b <> '' """,
}


@query(
    "terms_table_cells",
    r"""SELECT doc_id, i::VARCHAR AS number, a || CASE WHEN a = '' OR b = '' OR fused THEN '' ELSE ' ' END || b AS content
      FROM v_halves LEFT JOIN v_told ON "left" = regexp_extract(a, '(\S+)$', 1) AND "right" = regexp_extract(b, '^(\S+)', 1)""".replace("OR fused", "OR coalesce(fused, false)"),
    EVIDENCE | _HALVES,
)
def terms_table_cells(t: Tables) -> DataFrame:
    """Every line of the documents, cut in the middle by a narrow cell of a drawn table, put together by what all documents have."""
    half = lambda x: F.floor(F.length(x) / 2).cast("int")
    row = lambda x, i: _text("┃ ", i, " ┃", F.substring(x, F.lit(1), half(x)), "┃\n┃ ┃", F.substring(x, half(x) + 1, F.length(x)), "┃")
    drawn = F.array_join(F.transform(F.split("text", "\n"), row), "\n┣━━╋━━┫\n")
    tables = t.documents.select("doc_id", F.concat(F.lit("┏━━┳━━┓\n"), drawn, F.lit("\n┗━━┻━━┛")).alias("text"))
    rows = terms.table_rows(tables, "doc_id", "text", corpus=t.documents)
    return rows.select("doc_id", F.col("cells")[0].alias("number"), F.col("cells")[1].alias("content"))


@query("terms_table_exclusions", "SELECT doc_id, '(1)상해' AS coverage, 1 AS paragraph, number, text FROM (SELECT doc_id, unnest([1, 2]) AS number, unnest([md5(text) || ' 경우', doc_id || ' 번의 사유']) AS text FROM documents)")
def terms_table_exclusions(t: Tables) -> DataFrame:
    """The numbered exclusions in the last cell of a coverage row."""
    said = _text("┏━┳━┓\n┃ (1)상해 ┃ ① 회사는 다음을 보상하지 않습니다. 1. ", F.md5(F.col("text").cast("binary")), " 경우 2. ", F.col("doc_id"), " 번의 사유 ┃\n┗━┻━┛")
    rows = terms.table_rows(t.documents.select("doc_id", said.alias("text")), "doc_id", "text")
    return terms.table_exclusions(rows, ["doc_id"]).select("doc_id", "coverage", "paragraph", "number", "text")


@query("terms_stitched", "SELECT doc_id, 'k' || (i // 3) AS label, string_agg(m, ' ' ORDER BY i) AS content FROM v_lines GROUP BY doc_id, i // 3", VIEWS)
def terms_stitched(t: Tables) -> DataFrame:
    """Rows that a page break has cut into three are put together again."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.select("doc_id", "n", F.array(F.when(F.col("n") % 3 == 0, _text("k", F.floor(F.col("n") / 3))).otherwise(""), F.md5(F.col("line").cast("binary"))).alias("cells"))
    return terms.stitched(rows, "doc_id", "n").select("doc_id", "label", "content")


#: Printed lines: headings whole, wrapped, and inside tables, brackets that close them sooner or later; before the first
#: section a table of contents names the whole ones.
_PRINTED = {
    "v_printed": r"""SELECT doc_id, i AS pos, CASE WHEN i % 13 = 0 THEN NULL ELSE i // 5 + 1 END AS page, i % 11 = 3 AS in_table, m[1] AS d, CASE WHEN m[1] IN ('0', '1', '2', '3') THEN '제 ' || (i + 1) || '조(' || m || ')'
        WHEN m[1] IN ('4', '5') THEN '제 ' || (i + 1) || '조(' || m WHEN m[1] = '6' THEN '제 ' || (i + 1) || '조의2[' || m || ' [가' WHEN m[1] IN ('7', '8', '9') THEN m || ') 끝' WHEN m[1] IN ('a', 'b') THEN m || '] 끝'
        WHEN m[1] = 'c' THEN m || ' (나' ELSE m END AS line FROM v_lines""",
    "v_marked": """SELECT doc_id, pos, page, CASE WHEN in_table THEN '│' || line ELSE line END AS line, CASE WHEN NOT in_table AND d IN ('4', '5') THEN '(' WHEN NOT in_table AND d = '6' THEN '[' END AS opens, CASE WHEN d = '6' THEN 2 ELSE 1 END AS depth,
        len(line) - len(replace(line, '(', '')) - len(line) + len(replace(line, ')', '')) AS rounds, len(line) - len(replace(line, '[', '')) - len(line) + len(replace(line, ']', '')) AS squares FROM v_printed""",
    "v_fold": """SELECT doc_id, pos, page, line, pos AS first, opens AS kind, depth FROM v_marked WHERE pos = 0 UNION ALL
      SELECT m.doc_id, m.pos, m.page, m.line, CASE WHEN f.kind IS NULL THEN m.pos ELSE f.first END, CASE WHEN f.kind IS NULL THEN m.opens WHEN f.depth + CASE WHEN f.kind = '(' THEN m.rounds ELSE m.squares END <= 0 THEN NULL ELSE f.kind END,
        CASE WHEN f.kind IS NULL THEN m.depth ELSE f.depth + CASE WHEN f.kind = '(' THEN m.rounds ELSE m.squares END END FROM v_fold f JOIN v_marked m ON m.doc_id = f.doc_id AND m.pos = f.pos + 1""",
    "v_whole": "SELECT doc_id, first AS pos, string_agg(line, ' ' ORDER BY pos) AS line, arg_min(coalesce(page, -1), pos) AS page, arg_max(kind IS NULL, pos) AS shut FROM v_fold GROUP BY ALL",
    "v_titled": r"""SELECT *, regexp_extract(line, '^제 ([0-9]+조(?:의2)?)[(\[]', 1) AS number, regexp_extract(line, CASE WHEN contains(split_part(line, '조', 2)[:4], '[') THEN '^[^\[]*\[(.*)\]' ELSE '^[^(]*\((.*)\)' END, 1) AS title FROM v_whole
      WHERE shut AND regexp_matches(line, '^제 [0-9]+조(의2)?[(\[]') AND regexp_matches(line, CASE WHEN contains(split_part(line, '조', 2)[:4], '[') THEN '\[.*\]' ELSE '\(.*\)' END)""",
}


def printed(t: Tables) -> DataFrame:
    """(doc_id, pos, page, in_table, line)."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "x")).withColumn("m", F.md5(F.col("x").cast("binary")))
    d = F.substring("m", 1, 1)
    n = F.col("pos") + 1
    line = F.when(d.isin(*"0123"), _text("제 ", n, "조(", F.col("m"), ")")).when(d.isin(*"45"), _text("제 ", n, "조(", F.col("m"))).when(d == "6", _text("제 ", n, "조의2[", F.col("m"), " [가"))
    line = line.when(d.isin(*"789"), _text(F.col("m"), ") 끝")).when(d.isin(*"ab"), _text(F.col("m"), "] 끝")).when(d == "c", _text(F.col("m"), " (나")).otherwise(F.col("m"))
    page = F.when(F.col("pos") % 13 != 0, F.floor(F.col("pos") / 5) + 1)
    return rows.select("doc_id", "pos", page.alias("page"), (F.col("pos") % 11 == 3).alias("in_table"), line.alias("line"))


@query("terms_rejoined", "SELECT doc_id, pos, md5(line) AS line_md5, nullif(page, -1) AS page FROM v_whole", VIEWS | _PRINTED)
def terms_rejoined(t: Tables) -> DataFrame:
    """Printed lines with wrapped titles of articles in one."""
    rows = pages.rejoined_lines(printed(t), "doc_id", "pos", "line", "page", "in_table")
    return rows.select("doc_id", "pos", F.md5(F.col("line").cast("binary")).alias("line_md5"), "page")


@query(
    "terms_page_map",
    """SELECT doc_id, replace(number, '조', '') AS number, title, place AS pos, page FROM v_cursor WHERE place IS NOT NULL AND page <> -1""",
    VIEWS
    | _PRINTED
    | {
        "v_contents": "SELECT doc_id, pos - 1000000 AS pos, 900 + pos % 7 AS page, number, title FROM v_titled WHERE NOT contains(line, '│') AND pos % 3 = 1 AND regexp_matches(line, '[)]$') AND length(title) = 32",
        "v_wanted": """SELECT a.*, c.pos AS early, c.page AS early_page, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.pos) AS k FROM v_titled a
          LEFT JOIN v_contents c ON c.doc_id = a.doc_id AND c.number = a.number AND c.title = a.title WHERE NOT contains(a.line, '│')""",
        "v_cursor": """SELECT doc_id, k, number, title, coalesce(early, pos) AS place, CASE WHEN early IS NULL THEN page ELSE early_page END AS page, coalesce(early, pos) AS last FROM v_wanted WHERE k = 1 UNION ALL
          SELECT w.doc_id, w.k, w.number, w.title, CASE WHEN w.early > c.last THEN w.early WHEN w.pos > c.last THEN w.pos END, CASE WHEN w.early > c.last THEN w.early_page WHEN w.pos > c.last THEN w.page END,
            CASE WHEN w.early > c.last THEN w.early WHEN w.pos > c.last THEN w.pos ELSE c.last END FROM v_cursor c JOIN v_wanted w ON w.doc_id = c.doc_id AND w.k = c.k + 1""",
    },
)
def terms_page_map(t: Tables) -> DataFrame:
    """The page of every article, by a cursor over the printed lines; the table of contents in front names some articles first."""
    rows = pages.rejoined_lines(printed(t), "doc_id", "pos", "line", "page", "in_table")
    whole = rows.groupBy("doc_id").agg(F.concat(F.lit("□ 약관\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    found = terms.articles(whole, "doc_id").select("doc_id", F.col("block").alias("k"), "number", "title")
    head = terms.article_head(F.col("line"))
    contents = rows.where((F.col("pos") % 3 == 1) & F.endswith("line", F.lit(")")) & (F.length(head["title"]) == 32) & ~F.contains("line", F.lit("│")))
    contents = contents.select("doc_id", (F.col("pos") - 1000000).alias("pos"), "line", (F.lit(900) + F.col("pos") % 7).cast("long").alias("page"))
    found = pages.article_pages(found, contents.unionByName(rows), "doc_id", "k", "pos", "page")
    return found.select("doc_id", "number", "title", "pos", "page")


@query("terms_references", "SELECT page_id, unnest([(page_id % 50 + 20)::VARCHAR, (page_id % 50 + 20) || '의2', '3']) AS number, unnest([false, false, true]) AS in_proviso FROM pages")
def terms_references(t: Tables) -> DataFrame:
    """Articles that a text names; those of a law, and what is listed after it, are none."""
    n = F.col("page_id") % 50 + 20
    said = _text("민법 제", F.col("page_id") % 9 + 700, "조 및 제769조에 따르고, 이 약관의 제", n, "조 및 제", n, "조의2에 따른다. 다만, 제3조 및 제", n, "조는 뺀다.")
    return terms.find_references(t.pages.select("page_id", said.alias("text")), "page_id", "text").select("page_id", "number", "in_proviso")


_KINDS = (("종합 병원", "종합병원", False), ("의원급", "의원", False), ("병원", None, True), ("[ ]종합병원", None, True), ("보건 소", "보건기관", False), ("[]", None, False), (None, None, False))


def _pick(values: tuple, by: str) -> Column:
    """The value whose place is ``by`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple, by: str) -> str:
    named = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in values)
    return f"list_extract([{named}], ({by} % {len(values)} + 1)::INT)"


@query("receipt_institutions", f"SELECT p_partkey, {_pick_sql(tuple(k[1] for k in _KINDS), 'p_partkey')} AS institution, {_pick_sql(tuple(k[2] for k in _KINDS), 'p_partkey')} AS rejected FROM part")
def receipt_institutions(t: Tables) -> DataFrame:
    """Kinds of institutions on receipts, by the name that the rules use."""
    raw = _pick(tuple(k[0] for k in _KINDS), "p_partkey")
    return t.part.select("p_partkey", receipts.institution(raw).alias("i")).select("p_partkey", "i.institution", "i.rejected")


@query(
    "receipt_mentions",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '상급종합병원,의원' ELSE '의원,종합병원' END AS institutions, round(p_size / 100.0::DOUBLE, 4) AS first, CASE WHEN p_partkey % 3 = 0 THEN 0.25::DOUBLE END AS second FROM part",
)
def receipt_mentions(t: Tables) -> DataFrame:
    """Institutions and co-payment rates that a question mentions."""
    said = _text(F.when(F.col("p_partkey") % 2 == 0, "상급 종합병원").otherwise("종합 병원"), " 다음 내과의원, 국회의원은 아님. 본인부담률 ", F.col("p_size"), "%, ", F.when(F.col("p_partkey") % 3 == 0, "환자부담 0.25 ").otherwise(""), "보상비율 80%, 본인부담금 13,500원")
    rates = receipts.copay_rates_in(said)
    return t.part.select("p_partkey", F.array_join(receipts.institutions_in(said), ",").alias("institutions"), F.round(F.get(rates, 0), 4).alias("first"), F.get(rates, 1).alias("second"))


@query(
    "model_answers",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_size = 20 AND p_type[1] = 'F' THEN 'F20' ELSE upper(p_type[1]) || lpad(p_size::VARCHAR, 2, '0') || ',F20' END AS codes,
      CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'AND,MAYBE' END AS dropped, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '2,4' END AS choices FROM part""",
)
def model_answers(t: Tables) -> DataFrame:
    """Answers of a model that are held in a table: distinct codes and choices that exist, and what was said beside them."""
    none = F.col("p_partkey") % 7 == 0
    code = _text(F.lower(F.substring("p_type", 1, 1)), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    said = F.when(none, " none ").otherwise(_text(code, ", F20 and ", code, " maybe"))
    choice = F.when(none, "None").otherwise("2, 4, 9, 2 and 0")
    rows = t.part.select("p_partkey", receipts.model_codes(said).alias("c"), receipts.model_choices(choice, F.lit(5)).alias("n"))
    return rows.select("p_partkey", F.array_join("c.codes", ",").alias("codes"), F.array_join("c.dropped", ",").alias("dropped"), F.array_join(F.col("n").cast("array<string>"), ",").alias("choices"))


@query(
    "tail_codes",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN o WHEN 1 THEN i WHEN 2 THEN '' ELSE i END AS sure, CASE p_partkey % 4 WHEN 0 THEN i WHEN 1 THEN o WHEN 2 THEN s || ',' || i ELSE '' END AS weak
    FROM (SELECT p_partkey, 'O' || lpad(p_size::VARCHAR, 2, '0') AS o, 'I' || lpad(p_size::VARCHAR, 2, '0') AS i, 'S' || lpad(p_size::VARCHAR, 2, '0') AS s FROM part)""",
)
def tail_codes(t: Tables) -> DataFrame:
    """Codes of a dictionary's tail key: those of pregnancy need its context, others must be of one chapter."""
    code = lambda letter: _text(letter, F.lpad(F.col("p_size").cast("string"), 2, "0"))
    kind = F.col("p_partkey") % 4
    codes = F.when(kind < 2, F.array(code("O"), code("I"))).when(kind == 2, F.array(code("S"), code("I"))).otherwise(F.array(code("I")))
    rows = t.part.select("p_partkey", receipts.split_tail(codes, F.when(kind == 0, "임신 중 고혈압").otherwise("고혈압")).alias("s"))
    return rows.select("p_partkey", F.array_join("s.sure", ",").alias("sure"), F.array_join("s.weak", ",").alias("weak"))


def _provisions(t: Tables) -> DataFrame:
    when = F.when(F.col("doc_id") % 3 == 0, F.col("version")).otherwise(_text("19", F.col("doc_id") % 90 + 10, "0101"))
    return t.articles().select("version", F.col("article_uid").alias("provision_uid"), when.alias("promulgated_on"))


_PROVISIONS = "SELECT version, article_uid AS provision_uid, CASE WHEN doc_id % 3 = 0 THEN version ELSE '19' || (doc_id % 90 + 10) || '0101' END AS promulgated_on FROM v_articles"


@query("own_provisions", "SELECT version, provision_uid, promulgated_on = version AS is_own FROM v_provisions", {"v_provisions": _PROVISIONS})
def own_provisions(t: Tables) -> DataFrame:
    """Whether a provision was promulgated with the edition that lists it."""
    return terms.own_provisions(t.versions().select("version", F.col("version").alias("promulgated_on")), _provisions(t))


@query("recent_provisions", "SELECT provision_uid, promulgated_on FROM v_provisions ORDER BY promulgated_on DESC, provision_uid LIMIT 5", {"v_provisions": _PROVISIONS})
def recent_provisions(t: Tables) -> DataFrame:
    return terms.recent(_provisions(t)).select("provision_uid", "promulgated_on")


@query("scope_applies", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN d >= '19961001' ELSE d >= '19980401' END AS applies FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders)")
def scope_applies(t: Tables) -> DataFrame:
    """Whether a provision applies to a date of enrolment: not known without one scope for the whole version."""
    scope = F.when(F.col("o_orderkey") % 3 == 1, "19961001").when(F.col("o_orderkey") % 3 == 2, "19980401")
    return t.orders.select("o_orderkey", terms.applies_to(F.date_format("o_orderdate", "yyyyMMdd"), scope).alias("applies"))


@query(
    "scoped_notes",
    """SELECT contract, count(*) AS n_notes, min(note) AS first_note FROM (
      SELECT s_suppkey AS contract, list_extract(['19950101', '19961001', '19980401', '20000101'], (s_suppkey % 4 + 1)::INT) AS version, 'src' || (s_suppkey % 20) AS product FROM supplier) c
      JOIN (SELECT version, product AS p, article_uid AS note, doc_id % 5 = 0 AS for_all FROM v_articles) n USING (version) WHERE for_all OR contains(p, product) OR contains(product, p) GROUP BY contract""",
)
def scoped_notes(t: Tables) -> DataFrame:
    """How many notes of an edition are meant for a contract: those without products are for all."""
    own = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("product"))
    notes = t.articles().select("version", own.alias("products"), F.col("number").alias("article"), F.col("article_uid").alias("note"))
    version = _pick(("19950101", "19961001", "19980401", "20000101"), "s_suppkey")
    contracts = t.supplier.select(F.col("s_suppkey").alias("contract"), version.alias("version"), _text("src", F.col("s_suppkey") % 20).alias("product"))
    # All contracts of a product under an edition have the same notes, so these are counted once.
    meant = terms.scoped_notes(notes, contracts.select("version", "product").distinct())
    meant = meant.groupBy("version", "product").agg(F.count("*").alias("n"), F.min("note").alias("first"))
    return contracts.join(meant, ["version", "product"]).groupBy("contract").agg(F.sum("n").alias("n_notes"), F.min("first").alias("first_note"))


@query(
    "defined_terms",
    """SELECT DISTINCT unnest(['계약' || page_id, '장해' || page_id, '장해' || page_id, '의료비용' || page_id % 9, '별표' || page_id % 7]) AS term, unnest(['defined', 'defined', 'hollow', 'defined', 'deferred']) AS kind FROM pages""",
)
def defined_terms(t: Tables) -> DataFrame:
    """Terms that articles of definitions define in a list or a table, only point at, or leave to a table elsewhere."""
    key = F.col("page_id")
    listed = _text("가. 계약", key, ": 회사와 맺은 것\n나. 장해", key, ": <부표 3> 장해분류표에서 정한 기준\n")
    rows = t.pages.select(F.explode(F.array(F.struct(F.lit("용어의 정의").alias("title"), listed.alias("text")), F.struct(F.lit("정의").alias("title"), _text("┃ 용어 │ 정의 ┃\n┃ 의료비용", key % 9, " │ 비용 ┃").alias("text")), F.struct(F.lit("정의").alias("title"), _text("뜻은 <별표 ", key % 7, ">과 같습니다").alias("text")), F.struct(F.lit("목적").alias("title"), listed.alias("text")))).alias("a"))
    return provisions.defined_terms(rows.select("a.*"))


@query(
    "provision_scopes",
    """SELECT page_id, '202605' || d AS promulgated_on, true AS new_contracts_only, '2026-06-' || d || ',2027-01-01' AS candidate_dates, '2026-06-' || d AS applies_on, '7' AS articles, '3' AS tables
    FROM (SELECT page_id, lpad((page_id % 27 + 1)::VARCHAR, 2, '0') AS d FROM pages)""",
)
def provision_scopes(t: Tables) -> DataFrame:
    """Sentences of provisions that name the standard terms, the scopes that their dates end, and the one for the version."""
    d = F.lpad((F.col("page_id") % 27 + 1).cast("string"), 2, "0")
    xml = _text(
        "<부칙공포일자>202605", d, "</부칙공포일자><부칙공포번호>7</부칙공포번호><부칙내용 ><![CDATA[제1조(시행일) 이 세칙은 2026년 5월 6일부터 시행한다. ",
        "제2조(적용례) ① 별표15. 표준약관(개인실손의료보험은 제외한다) 개정내용은 2026년 6월 ", F.col("page_id") % 27 + 1, "일부터 체결되는 보험계약부터 적용한다. ",
        "② [별표 15] 생명보험 표준약관 제7조 및 별표 3의 개정사항은 2027. 1. 1.부터 적용한다.]]></부칙내용>",
    )
    told = provisions.provisions(t.pages.select(_text(xml, "").alias("value"), "page_id"))
    rows = told.select("promulgated_on", "new_contracts_only", F.array_join("candidate_dates", ",").alias("candidate_dates"), provisions.version_scope(F.col("scopes"))["applies_on"].alias("applies_on"), F.get(provisions.article_scopes(F.col("scopes")), 0).alias("a"))
    rows = rows.select("promulgated_on", "new_contracts_only", "candidate_dates", "applies_on", F.array_join("a.articles", ",").alias("articles"), F.array_join("a.tables", ",").alias("tables"))
    keyed = t.pages.select("page_id", _text("202605", d).alias("promulgated_on"))
    return keyed.join(rows.distinct(), "promulgated_on").select("page_id", *rows.columns)


#: What a claim says, and the items that it names by the words for them.
_SAID = (
    ("도수치료를 받은 통원, 진료비 10만원", ((benefits.MUSCULOSKELETAL, "도수치료"),)),
    ("영양주사를 맞음", ((benefits.INJECTION, "영양주사"),)),
    ("엠알아이 촬영", ((benefits.MRI, "엠알아이"),)),
    ("비-급여 진료", ((benefits.NONCOVERED, "비급여"),)),
    ("비급여 항목 없음, 급여 본인부담금만 100만원", ((benefits.NONCOVERED, "비급여"), (benefits.COVERED, "비급여 항목 없음"))),
    ("진료비 100만원, 비급여 30만원", ((benefits.NONCOVERED, "비급여"), (benefits.COVERED, "비급여 30만원"))),
    ("체외충격파 치료와 급여의 본인부담금", ((benefits.MUSCULOSKELETAL, "체외충격파"), (benefits.COVERED, "급여의 본인부담금"))),
    ("지급 여부와 빈도수 문의, 충격파 쇄석술", ()),
)
_COVERS = (benefits.SEVERE, benefits.MILD, benefits.BENEFIT, "해외여행 실손의료보험", benefits.MILD)


def _treatments(t: Tables) -> DataFrame:
    said = F.concat("p_name", F.lit(". "), _pick(tuple(s for s, _ in _SAID), "p_partkey"))
    rows = t.part.select("p_partkey", _pick(_COVERS, "p_partkey").alias("product"), said.alias("said"))
    return benefits.told_treatments(rows, "said")


@query("treatment_items", f"SELECT p_partkey, {_pick_sql(tuple(';'.join(f'{i}:{w}' for i, w in found) for _, found in _SAID), 'p_partkey')} AS items FROM part")
def treatment_items(t: Tables) -> DataFrame:
    """Treatments that a claim names, and what it says of their cover, by the words for them."""
    rows = _treatments(t)
    return rows.select("p_partkey", F.array_join(F.transform("items", lambda x: F.concat(x["item"], F.lit(":"), x["word"])), ";").alias("items"))


_NAMED = ", ".join(str((k, i, w)) for k, (_, found) in enumerate(_SAID) for i, w in found)


@query(
    "carved_items",
    f"""SELECT p_partkey, item, word, place, excluded FROM (SELECT p_partkey, {_pick_sql(_COVERS, "p_partkey")} AS product FROM part) p
      JOIN (VALUES {_NAMED}) s(k, item, word) ON p_partkey % {len(_SAID)} = k JOIN (VALUES {", ".join(map(str, benefits.CARVED))}) c(product, item, place, excluded) USING (product, item)""",
)
def carved_items(t: Tables) -> DataFrame:
    """Items that the product of a claim deals with elsewhere or not at all."""
    return benefits.carved_out(_treatments(t)).select("p_partkey", "item", "word", "place", "excluded")

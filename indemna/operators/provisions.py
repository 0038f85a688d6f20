"""Transitional provisions: which date an edition starts on, for which products and articles; and defined terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indemna.operators.structure import same_product

#: How provisions name their table, dates, products and articles.
STANDARD = "별표\\s*15"
DATE = "([0-9]{4})\\s*[.년]\\s*([0-9]{1,2})\\s*[.월]\\s*([0-9]{1,2})"
DATE_END = DATE + "\\s*일?\\s*(?:부터|이후|까지)?"
NEW_CONTRACTS = "신계약|신규로\\s*체결|체결되는\\s*보험계약|이후\\s*체결"
EXCLUDED = "표준약관\\s*\\(([^)]{2,40}?)은?\\s*제외한다\\)"
INCLUDED = "별표\\s*15\\s*[\\]>]?\\s*(?:\\.|중)?\\s*(?:표준약관\\s*중\\s*)?(?:<([가-힣ㆍ·\\s]{2,30}?)>|([가-힣ㆍ·\\s]{2,30}?)\\s*표준약관)"
OF_PRODUCT = "([가-힣][가-힣ㆍ·\\s]{1,28}?)\\s*표준약관"
TAGGED = "[<□]\\s*(?!별표|별지|부표|붙임)([가-힣][가-힣ㆍ·\\s]{1,30}?)\\s*[>·]?(?=\\s|$)"
NO_PRODUCTS = ("별표", "별지", "부표", "붙임", "및", "중", "의", "이", "")
LEADING = "^(?:(?:조|항|호|목|및|또는|중|의|이|그)(?:\\s+|$))+"
OWN_ARTICLES = "부칙\\s*제\\s*[0-9]+\\s*조(?:\\s*제\\s*[0-9]+\\s*항)?|제\\s*[0-9]+\\s*조(?:\\s*제\\s*[0-9]+\\s*항)?\\s*에도|제\\s*[0-9]+\\s*조\\s*\\([^)]*(?:적용|경과|시행|특례|조치|규정)[^)]*\\)|제\\s*[0-9]+\\s*-\\s*[0-9]+\\s*조"
ARTICLE = "제\\s*([0-9]+)(?:\\s*의\\s*([0-9]+))?\\s*조(?!\\s*의?\\s*[0-9])"
EXCEPT_ARTICLES = "제외한\\s*(?:개정|나머지|사항)"
OTHER_TABLES = ("4", "13", "14", "15", "18", "23", "27")
APPENDIX = "<부칙공포일자>([0-9]{8})</부칙공포일자><부칙공포번호>[0-9]+</부칙공포번호><부칙내용\\s*><!\\[CDATA\\[([\\s\\S]*?)\\]\\]></부칙내용>"
NOISE = "기본형|개인|단체|특별약관[0-9]*|\\(.*?\\)"


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _zipped(text: Column, pattern: str, n: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)])


def dates(text: Column) -> Column:
    return F.array_distinct(F.transform(_zipped(text, DATE, 3), lambda r: _iso(r["g1"], r["g2"], r["g3"])))


def _names(text: Column, pattern: str, groups: int) -> Column:
    found = F.transform(_zipped(text, pattern, groups), lambda r: F.concat(*[F.coalesce(r[f"g{i}"], F.lit("")) for i in range(1, groups + 1)]))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")))


def products(segment: Column) -> Column:
    """Products that a segment names, in any of three forms, without leading joiners."""
    every = F.concat(_names(segment, INCLUDED, 2), _names(segment, OF_PRODUCT, 1), _names(segment, TAGGED, 1))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(F.regexp_replace(x, LEADING, ""))), lambda x: ~x.isin(*NO_PRODUCTS)))


def articles(segment: Column) -> Column:
    """Articles of the terms that a segment names; those of the provision itself and of the rules are none."""
    rest = F.regexp_replace(segment, OWN_ARTICLES, " ")
    return F.array_distinct(F.transform(_zipped(rest, ARTICLE, 2), lambda r: F.concat(r["g1"], F.when(r["g2"] == "", "").otherwise(F.concat(F.lit("의"), r["g2"])))))


def tables(segment: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(segment, F.lit("별표\\s*([0-9]+)"), F.lit(1)), lambda n: ~n.isin(*OTHER_TABLES)))


def scopes(text: Column) -> Column:
    """array of (applies_on, new_contracts_only, products, articles, tables, excludes_articles, text): one for each date
    that ends a segment naming the standard terms. Whether only new contracts are meant is read after the date."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    parts = F.split(F.regexp_replace(flat, f"({DATE_END})", "$1\x1e"), "\x1e")
    indexed = F.transform(parts, lambda p, i: F.struct(p.alias("text"), F.concat(F.regexp_extract(p, f"({DATE_END})$", 1), F.array_join(F.slice(parts, i + 2, F.size(parts)), "")).alias("after"), (i < F.size(parts) - 1).alias("ends")))
    kept = F.filter(indexed, lambda s: s["ends"] & F.rlike(s["text"], F.lit(STANDARD)))

    def scope(s: Column) -> Column:
        g = [F.regexp_extract(s["text"], DATE_END + "$", i) for i in (1, 2, 3)]
        return F.struct(
            _iso(*g).alias("applies_on"),
            F.rlike(s["after"], F.lit(NEW_CONTRACTS)).alias("new_contracts_only"),
            products(s["text"]).alias("products"),
            articles(s["text"]).alias("articles"),
            tables(s["text"]).alias("tables"),
            F.rlike(s["text"], F.lit(EXCEPT_ARTICLES)).alias("excludes_articles"),
            F.trim(s["text"]).alias("text"),
        )

    return F.transform(kept, scope)


def version_scope(scopes_: Column) -> Column:
    """The only scope for new contracts and the whole version, else null."""
    whole = F.filter(scopes_, lambda s: s["new_contracts_only"] & (F.size(s["articles"]) == 0) & (F.size(s["tables"]) == 0))
    return F.when(F.size(whole) == 1, F.get(whole, 0))


def article_scopes(scopes_: Column) -> Column:
    return F.filter(scopes_, lambda s: (F.size(s["articles"]) > 0) | (F.size(s["tables"]) > 0))


def provisions(raw: DataFrame, xml: str = "value") -> DataFrame:
    """(promulgated_on, text, new_contracts_only, candidate_dates, included, excluded, scopes) of every provision that
    names the standard terms: only the sentences that do are read."""
    rows = raw.select(F.explode(_zipped(F.col(xml), APPENDIX, 2)).alias("a")).select(F.col("a.g1").alias("promulgated_on"), F.split("a.g2", "(?<=다\\.)\\s*").alias("sentences"))
    rows = rows.withColumn("text", F.array_join(F.transform(F.filter("sentences", lambda s: F.rlike(s, F.lit(STANDARD))), lambda s: F.trim(s)), " ")).where("text <> ''")
    return rows.select(
        "promulgated_on",
        F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"),
        F.rlike("text", F.lit(NEW_CONTRACTS)).alias("new_contracts_only"),
        dates(F.col("text")).alias("candidate_dates"),
        F.filter(_names(F.col("text"), INCLUDED, 2), lambda x: x != "").alias("included"),
        F.filter(_names(F.col("text"), EXCLUDED, 1), lambda x: x != "").alias("excluded"),
        scopes(F.col("text")).alias("scopes"),
    )


def provision_covers(product: Column, included: str = "included", excluded: str = "excluded") -> Column:
    """As ``versions.covers_product``, with names compared loosely."""
    alike = lambda p: same_product(p, product, NOISE)
    return ~F.exists(excluded, alike) & ((F.size(included) == 0) | F.exists(included, alike))


#: A term in a list, a pointer to a table, heads of tables of terms.
LISTED = "(?m)^\\s*[가-힣]\\.\\s*([^:：\\n]{1,24})\\s*[:：]"
DEFERRED = "[<〈]\\s*(붙임\\s*[0-9]*|부표\\s*[0-9]*|별표\\s*[0-9]*)\\s*[>〉]"
TABLE_HEADS = ("용 어", "용어", "정 의", "정의", "구 분", "구분")


def defined_terms(articles_: DataFrame, body: int = 200) -> DataFrame:
    """(term, kind) over all versions: ``defined`` by a list or the first cell of a table row, ``hollow`` where the
    definition only points at a table, ``deferred`` where an article of definitions defines nothing itself."""
    rows = articles_.where(F.contains("title", F.lit("정의"))).select("text")
    marked = F.split(F.regexp_replace("text", LISTED, "\x1e$1\x1f"), "\x1e")
    listed = F.transform(F.filter(marked, lambda p: F.contains(p, F.lit("\x1f"))), lambda p: F.struct(F.trim(F.substring_index(p, "\x1f", 1)).alias("term"), F.rlike(F.substring(F.regexp_extract(p, "(?s)\x1f(.*)$", 1), 1, body), F.lit(DEFERRED)).alias("hollow")))
    heads = F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("│"))), lambda x: F.trim(F.regexp_replace(F.substring_index(x, "│", 1), "[┃│┣┫┏┓┗┛━]+", "")))
    hangul = lambda c: F.length(F.regexp_replace(c, "[^가-힣]", ""))
    heads = F.filter(heads, lambda c: ~c.isin(*TABLE_HEADS) & F.length(c).between(2, 14) & ~F.rlike(c, F.lit("[「」『』]|^[·・]|[·・]$")) & (hangul(c) * 2 >= F.length(c)))
    rows = rows.select("text", listed.alias("listed"), F.array_distinct(heads).alias("heads"))
    some = (F.size("listed") > 0) | (F.size("heads") > 0)
    deferred = F.when(~some, F.transform(F.regexp_extract_all("text", F.lit(DEFERRED), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit(""))))
    named = lambda terms, kind: rows.select(F.explode(terms).alias("term"), F.lit(kind).alias("kind"))
    every = named(F.transform("listed", lambda x: x["term"]), "defined").union(named("heads", "defined")).union(named(F.transform(F.filter("listed", lambda x: x["hollow"]), lambda x: x["term"]), "hollow")).union(named(deferred, "deferred"))
    return every.where("term <> ''").distinct()
